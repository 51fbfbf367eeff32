"""Helpers shared by the training-data operators: shared storage, lineage cuts, gapless ranks."""

from __future__ import annotations

import gc
import sys
import tempfile
import time

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Word separators of the contracts: space and the ASCII controls tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need no installed copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def worker_cache() -> dict:
    """A dictionary that lasts as long as the Python worker, which runs many tasks: a module's own variables, being
    shipped by value, are new in each."""
    import sys
    import types

    return sys.modules.setdefault("_tersely_worker", types.ModuleType("_tersely_worker")).__dict__


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tersely-checkpoint-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(*frames: DataFrame | None) -> None:
    """Remove the files of checkpoints that nothing reads any more: what was made of them is itself written. Files that
    are not below the checkpoint folder, or cannot be found, are left alone."""
    for df in frames:
        if df is None:
            continue
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.sc()
        plan = df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        path = plan.rdd().getCheckpointFile()
        if path.isDefined() and path.get().startswith(str(jsc.getCheckpointDir().get())):
            place = jvm.org.apache.hadoop.fs.Path(path.get())
            place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ours by the file system that it is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of plans that are done with: Spark removes their shuffle files once the driver has collected them.

    It takes more than one collection: the first lets go of the plan, a later one of the shuffle it held.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def unused(columns: list[str], name: str) -> str:
    """``name``, or one made from it that no column has, whatever its letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column) -> Column:
    """Words of the contracts as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def gapless(df: DataFrame, keys: list[str], salt: Column, salts: int, order: list, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within ``keys`` without sorting a whole key in one task.

    Each key is dealt to ``salts`` sub-groups; a row's number is its place in the sub-group plus the
    rows of the sub-groups before it. The offsets have at most (number of keys) x ``salts`` rows. The salt may be a
    row's place if ``df`` is a checkpoint, which has the same rows in the same places each time it is read.
    """
    df = df.withColumn("_sub", F.pmod(salt, F.lit(salts)).cast("int"))
    before = W.partitionBy(*keys).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, "_sub").count().select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_sub").alias("_s"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_sub").orderBy(*order)) - 1
    ranked = df.withColumn("_own", own)
    on = [ranked[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)] + [ranked["_sub"] == offsets["_s"]]
    return (ranked.join(offsets, on).withColumn(out, (F.col("_own") + F.col("_before")).cast("long"))
            .drop("_sub", "_own", "_s", "_before", *[f"_k{i}" for i in range(len(keys))]))


def meet(rows: DataFrame, one: DataFrame, key: str, total: int, least: int = 256) -> DataFrame:
    """``rows`` with the row of ``one`` that has their key; ``one`` has each key once, with the number ``n`` of its rows.

    Both are checkpoints. A key with many rows is dealt to several places, by the rows' places in the checkpoint, and its
    row of ``one`` is copied to each. Such keys are at most 100,000, whatever ``total``, so their list is a broadcast.
    """
    limit = max(least, total // 100_000)
    crowded = F.broadcast(one.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).alias("_salts")))
    rows = rows.join(crowded, key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    one = one.drop("n").join(crowded, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return rows.join(one, [key, "_salt"]).drop("_salt")
