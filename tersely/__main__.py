"""Command line: python -m tersely COMMAND ... (reduce, code, tokens, classify, plan, verify, corpus, power)."""

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .functions import text as X
from .operators import chunks, evaluate, fidelity, measure, reduce, reports
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tersely", description=__doc__)
    c = p.add_subparsers(dest="command", required=True)
    r = c.add_parser("reduce", help="reduce texts")
    r.add_argument("path")
    r.add_argument("--level", default="balanced")
    r.add_argument("--similarity", type=float)
    r.add_argument("--similarity-sent", type=float)
    for name in ("whitespace", "dedup", "near-dedup", "sentence-dedup", "near-dedup-sentences", "dedup-lists", "compact-tables", "filler", "phrases", "json"):
        r.add_argument(f"--no-{name}", action="store_const", const=False, dest=name.replace("-", "_"))
    r.add_argument("--strip-html-comments", action="store_true", default=None)
    r.add_argument("--stats", action="store_true", help="a line of statistics for each text")
    r.add_argument("--auto", action="store_true", help="the verdict for each text")
    r.add_argument("-o", "--output")
    k = c.add_parser("code", help="reduce source code")
    k.add_argument("path")
    k.add_argument("--lang")
    for flag in ("keep-comments", "docstrings", "fold"):
        k.add_argument(f"--{flag}", action="store_true")
    k.add_argument("--no-directives", action="store_true")
    k.add_argument("--blanks", choices=("collapse", "remove", "keep"), default="collapse")
    k.add_argument("-o", "--output")
    c.add_parser("tokens", help="estimate tokens").add_argument("path")
    t = c.add_parser("classify", help="small or large task")
    t.add_argument("path", nargs="?")
    t.add_argument("--tokens", type=int)
    t.add_argument("--files", type=int, default=0)
    t.add_argument("--sources", type=int, default=0)
    s = c.add_parser("plan", help="chunks, prompts and required spans")
    s.add_argument("path")
    s.add_argument("--max-chars", type=int, default=K.CHUNK_CHARS)
    s.add_argument("--boundary", choices=("paragraph", "sentence"), default="paragraph")
    v = c.add_parser("verify", help="is everything required still there")
    v.add_argument("source")
    v.add_argument("digest")
    b = c.add_parser("corpus", help="report on a folder of samples")
    b.add_argument("path")
    c.add_parser("power", help="pairs needed to find a difference")
    return p


def show(lines) -> None:
    for row in lines.toLocalIterator():
        print(row["line"])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tersely").getOrCreate()
    if a.command == "reduce":
        names = K.Level().__dataclass_fields__
        options = {n: getattr(a, n) for n in names if getattr(a, n, None) is not None}
        out = measure.signals(reduce.reduce_text(readers.read_texts(spark, a.path), level=a.level, **options))
        if a.output:
            readers.write_texts(out, a.output)
        else:
            show(out.select(F.col("reduced").alias("line")))
        if a.stats:
            show(measure.stats_line(out))
        if a.auto:
            code = measure.verdict(F.col("saved_pct"), F.col("before_tokens"))
            show(out.select(measure.advice(code, F.col("saved_pct"), F.col("before_tokens")).alias("line")))
    elif a.command == "code":
        files = readers.read_source_files(spark, a.path)
        lang = F.lit(a.lang) if a.lang else F.col("lang")
        out = files.select(reduce.code_reduced(F.col("src"), lang, keep_comments=a.keep_comments, keep_directives=not a.no_directives,
                                               docstrings=a.docstrings, fold=a.fold, blanks=a.blanks).alias("line"))
        readers.write_texts(out, a.output, "line") if a.output else show(out)
    elif a.command == "tokens":
        show(readers.read_texts(spark, a.path).select(F.format_string("%d  %s  [%s]", X.tokens(F.col("text")), "path", F.lit(K.METHOD)).alias("line")))
    elif a.command == "classify":
        rows = readers.read_texts(spark, a.path) if a.path else spark.createDataFrame([("",)], "text string")
        rows = rows.select("text", F.lit(a.tokens).cast("int").alias("n"), F.lit(a.files).alias("files"), F.lit(a.sources).alias("sources"))
        show(measure.classify(rows, "text", "n").select(F.to_json("task").alias("line")))
    elif a.command == "plan":
        show(reports.plan_lines(chunks.plan(readers.read_texts(spark, a.path), most=a.max_chars, boundary=a.boundary), "path"))
    elif a.command == "verify":
        pair = readers.read_texts(spark, a.source).select(F.col("text").alias("source")).crossJoin(readers.read_texts(spark, a.digest).select(F.col("text").alias("digest")))
        found = fidelity.verify(pair).select("fidelity.ok", fidelity.summary(F.col("fidelity")).alias("line")).first()
        print(found["line"])
        return 0 if found["ok"] else 1
    elif a.command == "corpus":
        rows = reduce.reduce_levels(readers.read_corpus(spark, a.path).select("name", "category", "text"))
        show(reports.corpus_lines(measure.corpus_rows(rows)))
    else:
        show(reports.power_lines(evaluate.power_grid(spark)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
