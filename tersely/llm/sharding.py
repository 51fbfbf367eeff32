"""Jump consistent hashing (operator 6), DataFrame expressions only.

Nulls and edge cases: a null key is hashed like any other value (one stable shard); null text counts
as no bytes, a very long one is only measured; ties and repeated rows each get a slot; an empty table gives an
empty result; extra columns of the input are left out of the result, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless


def next_bucket(key: Column, bucket: Column) -> Column:
    """Where the key leaves ``bucket`` to, once that many shards exist (Lamping and Veach's step).

    The step's random draw is XXH64 of the key and the bucket, so the chain needs no state and no
    64-bit product that overflows.
    """
    draw = F.shiftrightunsigned(F.xxhash64(key, bucket), 33)
    jump = (bucket + F.lit(1)).cast("double") * (F.lit(2.0**31) / (draw + F.lit(1)).cast("double"))
    return F.floor(jump).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1. Every step goes to a higher bucket, so ``shards`` - 1 steps are enough."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if shards == 1:
        return F.lit(0)

    def step(bucket: Column, _: Column) -> Column:
        to = next_bucket(key, bucket)
        return F.when(to < F.lit(shards), to).otherwise(bucket)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards - 1)), F.lit(0).cast("long"), step).cast("int")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16,
                    rows_a_group: int = 1 << 20) -> DataFrame:
    """Every row's shard, its slot there (gapless from 0) and its shard once one more is appended.

    Only the key, the size and the checksum are kept, in a checkpoint, never the text, which is read once. Slots
    are dealt in sub-groups of a shard by the rows' places in that checkpoint, about ``rows_a_group`` in each even
    if one shard has all rows, so no task sorts a whole shard, and many rows of one key are many sub-groups.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard")))
    salts = max(256, -(-rows.count() // rows_a_group))
    slotted = gapless(rows, ["shard"], F.xxhash64(F.monotonically_increasing_id()), salts, ["doc_id", "text_crc32", "size"], "slot")
    to = next_bucket(F.col("doc_id"), F.col("shard").cast("long"))
    grown = F.when(to < F.lit(shards + 1), to).otherwise(F.col("shard")).cast("int")
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", grown.alias("grown_shard"))
