"""Connected components by alternating large and small stars, on DataFrames.

Every step is a minimum by node and a join with the nodes that it moves; no node's neighbours are ever collected.
The minima are combined before they are shuffled and written to the shared folder, so that the join's two sides
are plain shuffles, of which Spark splits large partitions: a star with very many leaves is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node's larger neighbours go to its smallest one. A node that is the smallest moves nothing. Returns the links
    and the checkpoint they are made of."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = cut(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"))
    up = both.where("v > u").join(moved, "u", "left")
    return up.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).where("u != v").distinct(), moved


def _small(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node and its smaller neighbours go to the smallest of these. A node with one of them stays."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("m != most").drop("most"))
    linked = down.join(moved, "u", "left")
    own = F.col("m").isNull() | (F.col("v") == F.col("m"))
    return linked.select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.coalesce("m", "v").alias("v")).where("u != v").distinct(), moved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (u, label): every linked node but the smallest of its component, with that smallest one."""
    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    now = cut(edges.select("u", "v").where("u != v"))
    seen = None
    for _ in range(most_rounds):
        larger, first = _large(now)
        smaller, second = _small(larger)
        before, now = now, cut(smaller)
        discard(before, first, second)  # the new links are written
        state = mark(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("label"))


def named(nodes: DataFrame, label: DataFrame, key: str, broadcast_rows: int = 500_000, salts: int = 16) -> DataFrame:
    """``nodes`` (``key``, least) with label and component_id, the smallest ``least`` of the component.

    Smallest ids are combined before they are shuffled. Only components of several nodes are met again, by their
    label: as a broadcast if they are few, otherwise spread over ``salts`` places each, as one may hold a third of
    all nodes.
    """
    inside = nodes.join(label.withColumnRenamed("u", key), key, "left").withColumn("label", F.coalesce("label", key))
    several = cut(inside.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if several.count() <= broadcast_rows:
        met = inside.join(F.broadcast(several), "label", "left")
    else:
        inside = inside.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
        several = several.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = inside.join(several, ["label", "_salt"], "left").drop("_salt")
    # a component of several nodes has its id; null where all its ids are null
    alone = F.col("label") == F.col(key)
    return met.withColumn("component_id", F.when(alone, F.coalesce("component_id", "least")).otherwise(F.col("component_id")))
