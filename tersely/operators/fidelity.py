"""What a rewrite must keep word for word, and whether it did."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as X


TAIL = r"(?:['\-][A-Za-z0-9]+)?"
RUN = re.compile(rf"\b[A-Z][A-Za-z0-9]*{TAIL}(?:\s+[A-Z][A-Za-z0-9]*{TAIL})+\b")
ACRONYM = re.compile(r"\b[A-Z][A-Z0-9]+\b")
NAME = re.compile(r"\b[A-Z][a-z]+(?:['\-][A-Za-z]+)?\b")
QUOTED = re.compile(r'"[^"\n]+"')
SPANS = "struct<numbers:array<string>,code:array<string>,quotes:array<string>,proper_nouns:array<string>>"
REPORT = "struct<ok:boolean,missing_numbers:array<string>,missing_code:array<string>,missing_quotes:array<string>,missing_proper_nouns:array<string>>"


def prose(text: str) -> str:
    return "".join("".join(p for p, code in kernels.cut_at(kernels.INLINE, c) if not code) for c, fenced in kernels.cut_at(kernels.FENCE, text) if not fenced)


def code(text: str) -> set[str]:
    out: set[str] = set()
    for piece, fenced in kernels.cut_at(kernels.FENCE, text):
        out |= {piece} if fenced else {s for s in kernels.INLINE.findall(piece) if s.strip("` ")}
    return out


def quotes(text: str) -> set[str]:
    lines = (line.strip() for line in text.split("\n"))
    return {line for line in lines if line[:1] == ">"} | set(QUOTED.findall(prose(text)))


def names(text: str) -> set[str]:
    """Runs of capitalised words, acronyms, and single capitalised words that do not open a sentence or a line."""
    body = prose(text)

    def inside(m: re.Match) -> bool:
        ahead = body[: m.start()]
        last = ahead.rstrip()[-1:]
        return last != "" and ahead[-1] != "\n" and last not in ".!?:;"

    return {m[0] for p in (RUN, ACRONYM) for m in p.finditer(body)} | {m[0] for m in NAME.finditer(body) if inside(m)}


def required(text: str) -> dict:
    return {"numbers": list(kernels.numbers(text)), "code": sorted(code(text)), "quotes": sorted(quotes(text)), "proper_nouns": sorted(names(text))}


def lost_numbers(source: list[str], digest: list[str]) -> list[str]:
    """Source numbers that do not follow in the digest after the last one found."""
    lost, at = [], 0
    for n in source:
        try:
            at = digest.index(n, at) + 1
        except ValueError:
            lost.append(n)
    return lost


def report(source: str, digest: str) -> dict:
    need = required(source)
    out = {"missing_numbers": lost_numbers(need["numbers"], list(kernels.numbers(digest)))}
    out |= {f"missing_{k}": [s for s in need[k] if s not in digest] for k in ("code", "quotes", "proper_nouns")}
    return {"ok": not any(out.values()), **out}


def summary(found: Column) -> Column:
    """The report in words."""
    count = lambda k: F.when(F.size(found[f"missing_{k}"]) > 0, F.concat(F.lit(f"{k}="), F.size(found[f"missing_{k}"]).cast("string")))
    listed = lambda k: F.when(F.size(found[f"missing_{k}"]) > 0, F.concat(F.lit(f"{k}=["), F.array_join(found[f"missing_{k}"], ", "), F.lit("]")))
    text = F.concat_ws(", ", listed("numbers"), count("code"), count("quotes"), listed("proper_nouns"))
    return F.when(text == "", F.lit("(none)")).otherwise(text)


def spans(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([required(t or "") for t in texts], columns=["numbers", "code", "quotes", "proper_nouns"])

    return run(text)


def verified(source: Column, digest: Column) -> Column:
    """The whole report, names included; null texts count as empty."""
    @F.pandas_udf(REPORT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([report(x or "", y or "") for x, y in zip(a, b)],
                            columns=["ok", "missing_numbers", "missing_code", "missing_quotes", "missing_proper_nouns"])

    return run(source, digest)


def verify(df: DataFrame, source: str = "source", digest: str = "digest") -> DataFrame:
    return df.withColumn("fidelity", verified(F.col(source), F.col(digest)))


def verified_plain(source: Column, digest: Column) -> Column:
    """The report without names, as expressions in the JVM."""
    numbers = X.missing_in_order(X.numbers(source), X.numbers(digest))
    code_, quotes_ = X.absent(X.code_spans(source), digest), X.absent(X.quotes(source), digest)
    return F.struct(((F.size(numbers) + F.size(code_) + F.size(quotes_)) == 0).alias("ok"), numbers.alias("missing_numbers"),
                    code_.alias("missing_code"), quotes_.alias("missing_quotes"))
