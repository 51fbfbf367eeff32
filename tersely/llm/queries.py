"""The ten queries of the training-data operators, with DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, fingerprints, mixing, packing, pii, repeats, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_only(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_packing, op3_repeats, op4_simhash, op5_toxicity, op6_sharding,
                                    op7_fingerprints, op8_neighbours, op9_surrogates, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": CHAT_SQL, "op10_mixing": MIXING_SQL}


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '<' || chr(8288) || '|') AS text,
         coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS block
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL),
v AS (
  SELECT t.conv_id, s.speaker, t.block, t.turn, t.role, t.text, coalesce(t.role = s.speaker, false) AS own,
         CASE WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || coalesce(t.role, 'unknown') || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (
  SELECT *, length(head) + length(text) + 11 AS len,
         coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, block ORDER BY turn NULLS FIRST, role NULLS FIRST, text
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM v)
SELECT conv_id, speaker, block, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY start) AS rendered,
       coalesce(list(CAST(start + length(head) AS BIGINT) ORDER BY start) FILTER (WHERE own), []) AS mask_from,
       coalesce(list(CAST(start + len - 1 AS BIGINT) ORDER BY start) FILTER (WHERE own), []) AS mask_to
FROM w GROUP BY conv_id, speaker, block
"""

MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
rows_ AS (SELECT *, strpos('0123456789abcdef', substr(h, 1, 1)) AS shard FROM d),
src AS (
  SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source)),
fill AS (
  SELECT *, source_size * 2 AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS wall,
         coalesce(sum(source_size * 2) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
  FROM src
  WINDOW o AS (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flag AS (SELECT *, cap * free * 2 <= w * (total * 3 - capped * 2) AS is_full FROM fill),
lev AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS fullsum,
         sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS rest FROM flag),
tgt AS (
  SELECT source, source_size, total,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(w * (total * 3 - fullsum * 2) AS DOUBLE) / CAST(rest * 2 AS DOUBLE) END AS target
  FROM lev),
quotients AS (
  SELECT source, target / (2 * k + 1) AS q, k
  FROM tgt, LATERAL (SELECT unnest(range(CAST(ceil(target / 8) + 2 AS BIGINT))) AS k) WHERE target > 0),
seated AS (
  SELECT source, count(*) AS n FROM (
    SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, k) AS r FROM quotients)
  WHERE r <= (SELECT CAST(floor(max(total) * 3 / 16 + 0.5) AS BIGINT) FROM tgt) GROUP BY source),
cells AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cell FROM rows_ GROUP BY source, shard),
cq AS (
  SELECT c.source, c.shard, cell, k, cell / (2 * k + 1) AS q, n
  FROM cells c JOIN seated s ON c.source IS NOT DISTINCT FROM s.source,
       LATERAL (SELECT unnest(range(CAST(ceil(cell * 2 / 8) + 3 AS BIGINT))) AS k) WHERE cell > 0),
cs AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard, k) AS r FROM cq) WHERE r <= n GROUP BY source, shard),
take AS (
  SELECT c.source, c.shard, c.cell, least(coalesce(quota, 0) * 8, cell * 2) AS take
  FROM cells c LEFT JOIN cs ON c.source IS NOT DISTINCT FROM cs.source AND c.shard = cs.shard),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY substr(h, 2, 2), h, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows_)
SELECT p.doc_id, p.size, p.source, t.source_size, t.target,
       CAST(CASE WHEN k.cell > 0 THEN (k.take // k.cell) * p.size + greatest(0, least(p.size, k.take % k.cell - p.start)) ELSE 0 END AS BIGINT) AS taken
FROM placed p JOIN tgt t ON p.source IS NOT DISTINCT FROM t.source
JOIN take k ON p.source IS NOT DISTINCT FROM k.source AND p.shard = k.shard
"""
