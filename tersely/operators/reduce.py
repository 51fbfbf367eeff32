"""Reduction as DataFrame operators: single passes as Arrow UDFs, whole levels as one fused UDF.

No operator here shuffles. A level is one Arrow round trip whatever its passes; null text stays null.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, constants as K, kernels


def text_udf(make: Callable[[], Callable[[str], object]], returns: T.DataType | str = "string"):
    """An Arrow UDF of a text function that ``make`` builds once for each task."""
    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else f(t))

    return run


def one_pass(f: Callable[[str], object], returns: str = "string"):
    return text_udf(lambda: f, returns)


def reduced(text: Column, level: str = "balanced", phrase_pairs=K.PHRASES, filler_list=K.FILLERS, condense=None,
            condense_chars: int = K.CONDENSE_CHARS, **overrides) -> Column:
    config = K.level_named(level, **overrides)
    return text_udf(lambda: kernels.reducer(config, tuple(phrase_pairs), tuple(filler_list), condense, condense_chars))(text)


def reduce_text(df: DataFrame, column: str = "text", output: str = "reduced", level: str = "balanced", **options) -> DataFrame:
    """``df`` with ``output``; options: phrase_pairs, filler_list, condense, condense_chars and any field of a level."""
    return df.withColumn(output, reduced(F.col(column), level, **options))


def reduce_levels(df: DataFrame, column: str = "text", levels=tuple(K.LEVELS)) -> DataFrame:
    """A row for each document and level. The plan has one Arrow stage with one UDF a level over the same rows."""
    configs = {name: K.level_named(name) for name in levels}

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("level", T.StringType()), T.StructField("reduced", T.StringType())])))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        all_ = [(name, kernels.reducer(c)) for name, c in configs.items()]
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [{"level": n, "reduced": f(t)} for n, f in all_])

    return df.withColumn("_r", F.explode(run(F.col(column)))).select("*", "_r.level", "_r.reduced").drop("_r")


def code_reduced(src: Column, lang: str | Column = "unknown", **options) -> Column:
    """Source by language; ``lang`` is a name, or a column of names."""
    if isinstance(lang, str):
        return text_udf(lambda: lambda s: codes.reduce_code(s, lang, **options))(src)

    @F.pandas_udf("string")
    def run(sources: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else codes.reduce_code(s, name or "unknown", **options) for s, name in zip(sources, langs)], dtype=object)

    return run(src, lang)


def json_valid(text: Column) -> Column:
    return one_pass(kernels.valid_json, "boolean")(text)


def whole_json(text: Column) -> Column:
    """A whole document of JSON. The first character decides for nearly all rows without leaving the JVM."""
    first = F.regexp_replace(text, "^\\s+", "").rlike("^[\\[{]")
    return F.when(first, one_pass(kernels.whole_json, "boolean")(F.when(first, text))).otherwise(F.lit(False))


def density(text: Column) -> Column:
    return one_pass(kernels.density, "double")(text)


#: Passes by the name under which SQL knows them.
SQL_PASSES = {
    "drop_invisible": kernels.drop_invisible, "squeeze_whitespace": kernels.squeeze_whitespace, "drop_comments": kernels.drop_comments,
    "shorten_phrases": kernels.shorten_phrases, "trim_fillers": kernels.trim_fillers, "minify_json": kernels.minify_json,
    "drop_repeated_paragraphs": kernels.drop_repeated_paragraphs, "drop_repeated_sentences": kernels.drop_repeated_sentences,
    "drop_repeated_items": kernels.drop_repeated_items, "compact_tables": kernels.compact_tables, "tidy_markdown": kernels.tidy_markdown,
    "strip_python": codes.strip_py, "strip_c": codes.strip_c, "python_skeleton": codes.skeleton,
}


def register(spark: SparkSession) -> list[str]:
    """Makes the passes, the levels and the scalar measures SQL functions."""
    names = []
    for name, f in SQL_PASSES.items():
        spark.udf.register(name, one_pass(f))
        names.append(name)
    for name in K.LEVELS:
        spark.udf.register(f"reduce_{name}", text_udf(lambda c=K.LEVELS[name]: kernels.reducer(c)))
        names.append(f"reduce_{name}")
    spark.udf.register("json_valid", one_pass(kernels.valid_json, "boolean"))
    spark.udf.register("text_density", one_pass(kernels.density, "double"))
    return [*names, "json_valid", "text_density"]
