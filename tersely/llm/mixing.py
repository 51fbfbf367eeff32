"""Sainte-Lague mixing of sources to target weights (operator 10), DataFrame expressions only.

Targets: the sources, by code point with null last, weigh 5, 2, 1, repeating, and share ``share`` of all
words; no target is above ``repeats`` times its source's words, the excess going to the others by weight.
The level at which that settles is found by one pass over the sources in the order of cap to weight.

Apportionment: equal blocks of ``block`` words go to sources, then within a source to its shards, each to
the highest quotient votes / (2 seats + 1). Any divisor that seats them all lies between
V / (n + k/2) and V / (n - k/2) for k parties and n seats, so at most 3k quotients are ranked, not n.

Selection: the documents of a (source, shard) cell stand in seeded order; a quota of q blocks takes the
whole line as often as it fits and then the line's first blocks.

The sources themselves are few: their targets and quotas are windows over one row for each source (and 16 cells
of it), in one task, which millions of sources would make slow.

Edge cases: null text has no words and is never taken; an empty table gives an empty result; ties in a line go by
id, then text; repeated rows are taken one by one; a source without words has target 0; a very long text is only
counted, and cut between words; extra columns are left out of ``mix`` and kept by ``mix_documents``, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, word_count

HEX = "0123456789abcdef"


def targets(sizes: DataFrame, weights=(5, 2, 1), share=(3, 2), repeats: int = 2) -> DataFrame:
    """(source, source_size) -> (source, source_size, target); a handful of rows, one for each source."""
    num, den = share
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), rank + 1)
    s = (sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * repeats)
         .withColumn("_total", F.sum("source_size").over(every)).withColumn("_wall", F.sum("_w").over(every)))
    fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("_capped", F.coalesce(F.sum("_cap").over(fill), F.lit(0)))
         .withColumn("_free", F.col("_wall") - F.coalesce(F.sum("_w").over(fill), F.lit(0))))
    full = F.col("_cap") * F.col("_free") * den <= F.col("_w") * (F.col("_total") * num - F.col("_capped") * den)
    s = s.withColumn("_full", full)
    s = (s.withColumn("_fullsum", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(every))
         .withColumn("_rest", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every)))
    level = (F.col("_w") * (F.col("_total") * num - F.col("_fullsum") * den)).cast("double") / (F.col("_rest") * den).cast("double")
    return s.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: seats by highest quotients within ``group``; ``seats`` is a column, constant there."""
    w = W.partitionBy(*group)
    p = parties.withColumn("_V", F.sum(votes).over(w)).withColumn("_k", F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(w))
    ratio = F.when(F.col("_V") > 0, F.col(votes) / F.col("_V")).otherwise(F.lit(0.0))
    sure = F.greatest(F.lit(0), F.floor(ratio * (F.col(seats) - F.col("_k") / 2.0) - 0.5) - 1)
    most = F.least(F.col(seats), F.floor(ratio * (F.col(seats) + F.col("_k") / 2.0) + 0.5) + 1)
    p = p.withColumn("_sure", F.when(ratio > 0, sure).otherwise(0).cast("long")).withColumn("_most", F.when(ratio > 0, most).otherwise(0).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    tried = p.where("_most > _sure").select(*group, party, "_left", F.col(votes).alias("_v"),
                                            F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_seat"))
    best = W.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_seat") + 1)).desc(), F.col(party).asc_nulls_last(), "_seat")
    won = (tried.withColumn("_r", F.row_number().over(best)).where("_r <= _left")
           .groupBy(*[F.col(c).alias(f"_j_{c}") for c in [*dict.fromkeys([*group, party])]]).agg(F.count("*").alias("_won")))
    on = [p[c].eqNullSafe(won[f"_j_{c}"]) for c in dict.fromkeys([*group, party])]
    out = p.join(won, on, "left")
    return out.withColumn("quota", (F.col("_sure") + F.coalesce(F.col("_won"), F.lit(0))).cast("long")).select(*parties.columns, "quota")


def mix(docs: DataFrame, weights=(5, 2, 1), share=(3, 2), repeats: int = 2, shards: int = 16, block: int = 8,
        seed: str = "mix-1", payload: list[Column] | None = None, rows_a_group: int = 1 << 20) -> DataFrame:
    """How many words of each document the mix takes, up to ``repeats`` times its size.

    The text is read once, for its words; everything after works on (id, source, size, order) rows. Places in
    a cell come from sub-groups by leading digits of the order's hash, as many digits as keep a sub-group at about
    ``rows_a_group`` rows even if one cell has all, so a hot source is never sorted whole; the places do not depend
    on the number of digits.
    """
    if shards not in (1, 16):
        raise ValueError("shards come from one hexadecimal digit: 1 or 16")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    shard = F.instr(F.lit(HEX), F.lit("0")) if shards == 1 else F.instr(F.lit(HEX), F.substring(order, 1, 1))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("_h"),
                       shard.cast("int").alias("_shard"), F.xxhash64(F.col("text")).alias("_tie"), *(payload or []))
    rows = cut(rows)
    digits, groups = 2, 256
    while groups * rows_a_group < rows.count():
        digits, groups = digits + 1, groups * 16
    rows = rows.withColumn("_sub", F.substring("_h", 2, digits))
    subs = rows.groupBy("source", "_shard", "_sub").agg(F.sum("size").alias("_words"))
    cells = subs.groupBy("source", "_shard").agg(F.sum("_words").alias("_cell"))
    sources = targets(cells.groupBy("source").agg(F.sum("_cell").alias("source_size")), weights, share, repeats)
    num, den = share
    blocks = F.floor(F.sum("source_size").over(W.partitionBy()) * num / (den * block) + 0.5).cast("long")
    by_source = (sainte_lague(sources.withColumn("_one", F.lit(1)).withColumn("_n", blocks), ["_one"], "source", "target", "_n")
                 .select(F.col("source").alias("_src"), "source_size", "target", F.col("quota").alias("_n")))
    cells = cells.join(by_source, cells["source"].eqNullSafe(by_source["_src"])).drop("_src")
    cells = sainte_lague(cells, ["source"], "_shard", "_cell", "_n")
    take = F.least(F.col("quota") * block, F.col("_cell") * repeats)
    cells = cells.select(F.col("source").alias("_cs"), F.col("_shard").alias("_csh"), "source_size", "target",
                         F.when(F.col("_cell") > 0, F.floor(take / F.col("_cell"))).otherwise(0).cast("long").alias("_full"),
                         F.when(F.col("_cell") > 0, take % F.col("_cell")).otherwise(0).cast("long").alias("_rest"))
    before = W.partitionBy("source", "_shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    starts = subs.select("source", "_shard", "_sub", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    starts = (starts.join(cells, starts["source"].eqNullSafe(cells["_cs"]) & (starts["_shard"] == cells["_csh"]))
              .select(F.col("source").alias("_ss"), F.col("_shard").alias("_ssh"), F.col("_sub").alias("_sb"),
                      "_start", "source_size", "target", "_full", "_rest"))
    line = W.partitionBy("source", "_shard", "_sub").orderBy("_h", "doc_id", "_tie", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_own", F.coalesce(F.sum("size").over(line), F.lit(0)))
    on = placed["source"].eqNullSafe(starts["_ss"]) & (placed["_shard"] == starts["_ssh"]) & (placed["_sub"] == starts["_sb"])
    placed = placed.join(starts, on)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start") - F.col("_own")))
    taken = (F.col("_full") * F.col("size") + part).cast("long")
    kept = [c for c in rows.columns if c not in ("_h", "_shard", "_sub", "_tie")]
    return placed.select(*kept, "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken whole, and the first words of a rest.

    Only narrow rows go through the mixing; the texts meet their counts in one join. A document keeps its columns;
    ``n_chars``, if there, is the length of the text that is returned.
    """
    tie = F.xxhash64("text")
    narrow = mix(docs, payload=[tie.alias("_t")], **options).where("taken > 0")
    narrow = (narrow.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("_t").alias("tie"))
              .agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.count("*").alias("rows")))
    narrow = cut(narrow)
    rows = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
                       docs["doc_id"].alias("id"), docs["source"].alias("src"), docs["text"].alias("body"), tie.alias("tie"))
    if narrow.where("rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["id", "src", "tie"])
    rows, narrow = rows.alias("r"), narrow.alias("n")
    on = F.col("r.id").eqNullSafe(F.col("n.id")) & F.col("r.src").eqNullSafe(F.col("n.src")) & (F.col("r.tie") == F.col("n.tie"))
    rows = rows.join(narrow, on).select("row", "body", F.floor(F.col("taken") / F.col("size")).alias("whole"), (F.col("taken") % F.col("size")).alias("rest"))
    copies = F.sequence(F.lit(1), (F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0)).cast("int"))
    rows = rows.withColumn("copy", F.explode(copies))
    rows = rows.select("row", F.when(F.col("copy") <= F.col("whole"), F.col("body")).otherwise(first_words(F.col("body"), F.col("rest"))).alias("body"))
    new = {"text": F.col("body"), "n_chars": F.length("body").cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, with the white space between as it was."""
    parts = F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), (n + lead).cast("int")), ""), "[\\x20\\x09-\\x0D]+$", "")
