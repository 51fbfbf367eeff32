"""Multi-party perspective rotation (operator 1), DataFrame expressions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and
all others as named users; the mask marks the characters that the speaker wrote, on which a model is trained.
A dialogue is rendered in blocks of 64 turn numbers, so that no task ever holds a whole long conversation; the blocks
of a rendering in order are the rendering. Offsets count characters from the block's start. Where turn numbers are
repeated or null a block may have more rows than turns: it is then cut into parts of as many rows as a block has
turns, part p of block b having the number b + p x 2^40, and beyond 65,536 rows it is first dealt by a hash of role
and text, so no group is ever unbounded.

Edge cases: a null role speaks as ``unknown`` and gets no perspective of its own; null text is an empty turn;
a null turn number stands first, in block -1; a null conversation id is one conversation; equal turns are
ordered by role and text, repeated rows all stay; the opening mark inside a text is broken by a word joiner, so it
opens no turn; a very long text is one turn of its block; extra columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
JOINER = chr(0x2060)
PART = 1 << 40


def perspectives(turns: DataFrame, turns_per_block: int = 64, most_rows: int = 1 << 16) -> DataFrame:
    """(conv_id, turn, role, text) -> one row for each (conversation, speaker, block).

    Two shuffles: turns to their (conversation, block), which moves each text once, and the blocks to the
    conversation's speakers. A conversation with a third of all turns is many blocks. Turn numbers alone are read
    to find blocks of more than ``most_rows`` rows.
    """
    block = F.coalesce(F.floor(F.col("turn") / turns_per_block), F.lit(-1)).cast("long")
    t = turns.select("conv_id", "turn", "role", F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit(f"<{JOINER}|")).alias("text"), block.alias("block"))
    crowded = cut(turns.select("conv_id", block.alias("block")).groupBy("conv_id", "block").agg(F.ceil(F.count("*") / most_rows).alias("salts")).where("salts > 1"))
    n = crowded.count()
    if n:
        crowded = crowded.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "salts")
        t = t.join(F.broadcast(crowded) if n <= 100_000 else crowded, t["conv_id"].eqNullSafe(F.col("_c")) & (t["block"] == F.col("_b")), "left")
        t = t.withColumn("salt", F.pmod(F.xxhash64("role", "text"), F.coalesce("salts", F.lit(1)))).drop("_c", "_b", "salts")
    else:
        t = t.withColumn("salt", F.lit(0).cast("long"))
    # the window's rows are already where the blocks are made: one shuffle, and a sort that may go to disk
    rank = F.row_number().over(W.partitionBy("conv_id", "block", "salt").orderBy("turn", "role", "text")) - 1
    t = t.withColumn("part", F.floor(rank / turns_per_block))
    speakers = turns.where("role is not null").select(F.col("conv_id").alias("_c"), F.col("role").alias("speaker")).distinct()
    blocks = t.groupBy("conv_id", "block", "salt", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    # parts of a block that was dealt lie side by side: salt s of part p is part p x salts + s
    number = F.col("part") if not n else F.col("part") * F.lit(most_rows) + F.col("salt")
    blocks = blocks.select("conv_id", (F.col("block") + number * F.lit(PART)).cast("long").alias("block"), "_turns")
    views = blocks.join(speakers, blocks["conv_id"].eqNullSafe(speakers["_c"])).drop("_c")

    def own(x: Column) -> Column:
        return F.coalesce(x["role"] == F.col("speaker"), F.lit(False))

    def head(x: Column) -> Column:
        name = F.concat(F.lit("user name="), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"))
        return F.concat(F.lit(OPEN), F.when(own(x), F.lit("assistant\n")).otherwise(name))

    views = views.withColumn("_heads", F.transform("_turns", lambda x: F.length(head(x)).cast("long")))
    views = views.withColumn("_lens", F.transform("_turns", lambda x, i: F.element_at("_heads", i + 1) + F.length(x["text"]) + len(CLOSE)))
    start = F.transform("_lens", lambda _, i: F.aggregate(F.slice("_lens", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    views = views.withColumn("_starts", start)
    spans = F.filter(F.transform("_turns", lambda x, i: F.struct(
        own(x).alias("own"), (F.element_at("_starts", i + 1) + F.element_at("_heads", i + 1)).alias("from"),
        (F.element_at("_starts", i + 1) + F.element_at("_lens", i + 1) - 1).alias("to"))), lambda s: s["own"])
    rendered = F.array_join(F.transform("_turns", lambda x: F.concat(head(x), x["text"], F.lit(CLOSE))), "")
    return views.select(
        "conv_id", "speaker", "block", F.size("_turns").cast("long").alias("n_turns"), rendered.alias("rendered"),
        F.transform(spans, lambda s: s["from"]).alias("mask_from"), F.transform(spans, lambda s: s["to"]).alias("mask_to"))
