"""Size before and after, verdicts, task classes and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import constants as K
from ..functions import text as X


def saved_pct(before: Column, after: Column, digits: int) -> Column:
    return F.when(before > 0, F.bround((before - after) / before * 100.0, digits)).otherwise(F.lit(0.0))


def signals(df: DataFrame, before: str = "text", after: str = "reduced") -> DataFrame:
    """``df`` with token counts of both, what was saved, and how that was counted."""
    d = df.withColumn("before_tokens", X.tokens(F.col(before))).withColumn("after_tokens", X.tokens(F.col(after)))
    return (d.withColumn("saved_tokens", F.col("before_tokens") - F.col("after_tokens"))
            .withColumn("saved_pct", saved_pct(F.col("before_tokens"), F.col("after_tokens"), 2))
            .withColumn("method", F.lit(K.METHOD)).withColumn("is_estimate", X.is_estimate(F.col("method"))))


def verdict(pct: Column, before_tokens: Column) -> Column:
    """What the rounded percentage says: done, leave it, think of a model, or in between."""
    return (F.when(pct >= K.HIGH_PCT, "tier1_sufficient").when((pct < K.LOW_PCT) & (before_tokens < K.SMALL_TOKENS), "send_as_is")
            .when(pct < K.LOW_PCT, "consider_semantic").otherwise("modest"))


def advice(code: Column, pct: Column, before_tokens: Column) -> Column:
    p = F.format_string("%.1f", pct)
    return (F.when(code == "tier1_sufficient", F.concat(p, F.lit(" % saved: structural redundancy was high, nothing more is needed.")))
            .when(code == "send_as_is", F.concat(p, F.lit(" % saved on about "), before_tokens.cast("string"), F.lit(" tokens: unique prose, send it as it is.")))
            .when(code == "consider_semantic", F.concat(p, F.lit(" % saved on about "), before_tokens.cast("string"), F.lit(" tokens: a lossy, verified digest pays only when the text is reused or goes to a dearer model.")))
            .otherwise(F.concat(p, F.lit(" % saved: a lossy digest is optional."))))


def low_savings_note(pct: Column, before_tokens: Column) -> Column:
    return (pct < K.LOW_PCT) & (before_tokens >= K.NOTE_TOKENS)


def stats_line(df: DataFrame, before: str = "text", after: str = "reduced") -> DataFrame:
    """One line of statistics for each row of ``signals``, as text and as JSON."""
    estimated = F.when(F.col("is_estimate"), F.lit(" (estimated)")).otherwise(F.lit(""))
    line = F.format_string("[stats]%s tokens: %d -> %d (saved %d, %.1f%%)  chars: %d -> %d  [%s]", estimated, "before_tokens", "after_tokens",
                           "saved_tokens", "saved_pct", F.length(before), F.length(after), "method")
    return df.withColumn("line", line).withColumn("json", F.to_json(F.struct("before_tokens", "after_tokens", "saved_tokens", "saved_pct", "method", "is_estimate")))


def classify(df: DataFrame, text: str | None = None, raw_tokens: str | None = None, files: str | Column = "files", sources: str | Column = "sources",
             most_tokens: int = K.TASK_TOKENS, most_files: int = K.TASK_FILES, most_sources: int = K.TASK_SOURCES) -> DataFrame:
    """Small or large, why, which kind, and where to send it. Given tokens win over counted ones."""
    files, sources = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for c in (files, sources))
    given = F.col(raw_tokens) if raw_tokens else F.lit(None).cast("int")
    counted = X.tokens(F.col(text)) if text else F.lit(None).cast("int")
    tokens = F.coalesce(given, counted, F.lit(0))
    reasons = F.filter(F.array(
        F.when(tokens > most_tokens, F.format_string(f"raw context ~%d tok > {most_tokens} threshold", tokens)),
        F.when(files > most_files, F.format_string(f"%d files > {most_files} threshold", files)),
        F.when(sources > most_sources, F.format_string(f"%d sources > {most_sources} threshold", sources))), lambda r: r.isNotNull())
    large = F.size(reasons) > 0
    refactor = (files > most_files) | ((files > 0) & (sources == 0))
    kind = F.when(~large, F.lit(None)).when(refactor, "refactor").when(sources > 0, "research").otherwise("unknown-large")
    none = F.array().cast("array<string>")
    agents = (F.when(kind == "refactor", F.array(F.lit("context-scout"), F.lit("implementer")))
              .when(kind == "research", F.array(F.lit("research-gatherer"), F.lit("synthesizer")))
              .when(kind == "unknown-large", F.array(F.lit("context-scout / research-gatherer (pick by task type)"))).otherwise(none))
    return df.select("*", F.struct(
        F.when(large, "large").otherwise("small").alias("size"), kind.alias("kind"),
        F.when(large, reasons).otherwise(F.array(F.lit("below all thresholds"))).alias("reasons"), tokens.alias("raw_tokens"),
        F.when(given.isNull() & counted.isNotNull(), F.lit(K.METHOD)).alias("token_method"),
        F.when(large, "workflow-routing").otherwise("single-pass").alias("recommended_route"), agents.alias("suggested_agents"),
        F.struct(F.lit(most_tokens).alias("tokens"), F.lit(most_files).alias("files"), F.lit(most_sources).alias("sources")).alias("thresholds")).alias("task"))


def corpus_rows(df: DataFrame, before: str = "text", after: str = "reduced") -> DataFrame:
    """(name, category, level, text, reduced) -> the report's row for each sample and level."""
    b, a = X.tokens(F.col(before)), X.tokens(F.col(after))
    d = df.withColumn("tokens_before", b).withColumn("tokens_after", a)
    return d.select("name", "category", "level", "tokens_before", "tokens_after", (F.col("tokens_before") - F.col("tokens_after")).alias("saved"),
                    saved_pct(F.col("tokens_before"), F.col("tokens_after"), 1).alias("saved_pct"),
                    F.length(before).alias("chars_before"), F.length(after).alias("chars_after"), F.lit(K.METHOD).alias("method"),
                    F.lit(True).alias("is_estimate"), X.numbers_preserved(F.col(before), F.col(after)).alias("numbers_preserved"))


def corpus_means(rows: DataFrame) -> DataFrame:
    """Mean saving by category and level, and by category (level null): one pass with grouping sets."""
    rows.createOrReplaceTempView("_corpus_rows")
    return rows.sparkSession.sql("""
        SELECT category, level, bround(avg(saved_pct), 1) AS mean_saved_pct, count(*) AS n, bool_or(is_estimate) AS any_estimate,
               bool_and(numbers_preserved) AS all_numbers_preserved
        FROM _corpus_rows GROUP BY GROUPING SETS ((category, level), (category))""")


def diagnostics(df: DataFrame, keep: list[str], before: str = "text", after: str = "reduced", key: str = "id") -> DataFrame:
    """How a level changes texts: counts, mean change in characters and the first changed row; ``examples`` has the
    rows themselves."""
    d = df.withColumn("_lost", X.lost_values(F.col(before), F.col(after))).withColumn("_changed", ~F.col(before).eqNullSafe(F.col(after)))
    pct = F.when(F.length(before) > 0, (F.length(before) - F.length(after)) / F.length(before) * 100.0).otherwise(0.0)
    return d.groupBy(*keep).agg(
        F.count("*").alias("n_items"), F.count_if("_changed").alias("n_changed"),
        F.count_if(F.size("_lost") > 0).alias("n_numeric_fidelity_violations"),
        F.count_if(F.length(before) > K.CONDENSE_CHARS).alias("n_exceeds_tier2_threshold"),
        F.avg(pct).alias("mean_char_delta_pct"),
        F.min(F.when(F.col("_changed"), F.col(key))).alias("first_changed"))


def examples(df: DataFrame, keep: list[str], before: str = "text", after: str = "reduced", key: str = "id", first: int = 3) -> DataFrame:
    """The ``first`` changed rows of each group (kind changed) and all rows that lost a value (kind violation, lost)."""
    d = df.withColumn("lost", X.lost_values(F.col(before), F.col(after)))
    out = [*keep, F.col(key).alias("key"), F.col(before).alias("before"), F.col(after).alias("after"), "lost"]
    w = W.partitionBy(*keep).orderBy(key)
    changed = d.where(~F.col(before).eqNullSafe(F.col(after))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= first)
    return (changed.select(F.lit("changed").alias("kind"), *out)
            .union(d.where(F.size("lost") > 0).select(F.lit("violation").alias("kind"), *out)))
