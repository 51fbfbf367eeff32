"""Extension: the stateless operators on streams, and repeats within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import measure, reduce


def reduce_stream(stream: DataFrame, column: str = "text", level: str = "balanced") -> DataFrame:
    """A stream of documents with their reduced text and its measures; no state."""
    return measure.signals(reduce.reduce_text(stream, column, "reduced", level), column)


def drop_repeats(stream: DataFrame, time: str, column: str = "text", delay: str = "10 minutes") -> DataFrame:
    """The first of equal texts within the watermark; state holds a 256-bit digest for each, not the text."""
    keyed = stream.withColumn("_digest", F.sha2(X.key(F.col(column)).cast("binary"), 256))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def savings_by_window(stream: DataFrame, time: str, column: str = "text", level: str = "balanced", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tokens before and after in each window of event time."""
    d = reduce_stream(stream.withWatermark(time, delay), column, level)
    return d.groupBy(F.window(time, window)).agg(F.sum("before_tokens").alias("before_tokens"), F.sum("after_tokens").alias("after_tokens"), F.count("*").alias("n"))
