"""Reports as rows of text, in order: what a console shows, without collecting more than it shows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import measure


def corpus_lines(rows: DataFrame) -> DataFrame:
    """(ord, line): the samples by name and level, then the means by category, then the guards."""
    sample = F.format_string("%-32s %-10s %-10s %6d -> %6d  %5.1f%%%s", "name", "category", "level", "tokens_before", "tokens_after", "saved_pct",
                             F.when(F.col("is_estimate"), " (estimated)").otherwise(""))
    body = rows.select(F.concat_ws("|", F.lit("1"), "name", "level").alias("ord"), sample.alias("line"))
    means = measure.corpus_means(rows)
    mean = F.format_string("%-10s %-10s mean saved %5.1f%% of %d", "category", F.coalesce("level", F.lit("all")), "mean_saved_pct", "n")
    tail = means.select(F.concat_ws("|", F.lit("2"), "category", F.coalesce("level", F.lit("~"))).alias("ord"), mean.alias("line"))
    kept = rows.agg(F.bool_and("numbers_preserved").alias("ok")).select(F.lit("3").alias("ord"), F.when(F.col("ok"), "every number preserved").otherwise("A NUMBER WAS LOST").alias("line"))
    return body.unionByName(tail).unionByName(kept).orderBy("ord")


def plan_lines(plans: DataFrame, key: str) -> DataFrame:
    """One line for each document's condensing plan."""
    s = F.col("required_spans")
    return plans.select(key, F.format_string("%d chunks; required: %d numbers, %d code spans, %d quotes, %d names", F.size("chunks"), F.size(s["numbers"]),
                                             F.size(s["code"]), F.size(s["quotes"]), F.size(s["proper_nouns"])).alias("line"))


def ledger_lines(df: DataFrame, key: str, before: str = "text", reduced: str = "reduced", condensed: str = "condensed") -> DataFrame:
    """Tokens before, after reduction and after condensing."""
    t = [X.tokens(F.col(c)) for c in (before, reduced, condensed)]
    return df.select(key, F.format_string("raw %d -> reduced %d -> condensed %d tokens (estimated)", *t).alias("line"))


def power_lines(grid: DataFrame) -> DataFrame:
    return grid.orderBy("psi", "d", "power").select(F.format_string("psi %.2f  difference %.0f pp  power %.0f%%: %d pairs", "psi", F.col("d") * 100, F.col("power") * 100, "pairs").alias("line"))
