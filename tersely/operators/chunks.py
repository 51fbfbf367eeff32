"""Chunks for a condenser, the prompts, and condensing that fails closed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import kernels
from ..functions import text as X
from . import fidelity, reduce


SYSTEM = ("Shorten the text without losing any fact. Keep every number, date, amount, unit, code span, quotation, proper name and "
          "contractual wording exactly as written. Merge repetition and tighten the prose around them; add nothing, leave no detail "
          "out, and keep numbers with their facts. Return the shortened text alone; where in doubt, keep the wording.")
ASK = "Shorten the following context under those rules.\n\nCONTEXT:\n"


def atoms(text: str, boundary: str = "paragraph") -> list[str]:
    """What must not be cut: whole fences, and paragraphs or sentences of the prose between them."""
    out = []
    for piece, fenced in kernels.cut_at(kernels.FENCE, text):
        if fenced:
            out.append(piece)
            continue
        for p in kernels.paragraphs(piece):
            out += [s.strip() for s in kernels.SENTENCE_GAP.split(p.strip())] if boundary == "sentence" else [p.strip()]
    return [a for a in out if a.strip()]


def pack(pieces: list[str], most: int = K.CHUNK_CHARS) -> list[str]:
    """Greedy: a piece joins the current chunk if it fits with the blank line between; too long a piece stands alone."""
    chunks: list[list[str]] = []
    room = -1
    for p in pieces:
        if chunks and len(p) + 2 <= room:
            chunks[-1].append(p)
            room -= len(p) + 2
        else:
            chunks.append([p])
            room = most - len(p)
    return ["\n\n".join(c) for c in chunks]


def chunked(text: Column, most: int = K.CHUNK_CHARS, boundary: str = "paragraph") -> Column:
    """Chunks of a text that may have fences."""
    return reduce.text_udf(lambda: lambda t: pack(atoms(t, boundary), most), "array<string>")(text)


def chunked_plain(text: Column, most: int = K.CHUNK_CHARS) -> Column:
    """Chunks of a text without fences, as one expression: a fold over the paragraphs that carries the open chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(s: Column, p: Column) -> Column:
        fits = s["open"].isNotNull() & (F.length(s["open"]) + 2 + F.length(p) <= most)
        return F.struct(F.when(fits | s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
                        F.when(fits, F.concat(s["open"], F.lit("\n\n"), p)).otherwise(p).alias("open"))

    pieces = F.transform(X.paragraphs(text), X.strip)
    return F.aggregate(pieces, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def prompts(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: F.struct(F.lit(SYSTEM).alias("system"), F.concat(F.lit(ASK), c).alias("user")))


def plan(df: DataFrame, column: str = "text", most: int = K.CHUNK_CHARS, boundary: str = "paragraph") -> DataFrame:
    """``df`` with chunks, prompts and required spans: all a condenser needs, without one."""
    d = df.withColumn("chunks", chunked(F.col(column), most, boundary))
    return d.withColumn("prompts", prompts(F.col("chunks"))).withColumn("required_spans", fidelity.spans(F.col(column)))


def budget(chunk: str) -> int:
    return max(256, min(8192, len(chunk) // 3 + 256))


def condense(df: DataFrame, column: str = "text", output: str = "condensed", condenser: Callable[[str, str, int], str] | None = None,
             level: str = "balanced", most: int = K.CHUNK_CHARS) -> DataFrame:
    """Reduce, condense chunk by chunk, verify against the reduced text, and fall back to that on any loss.

    ``condenser(system, user, budget)`` runs in the tasks; without one the reduced text is the result. A call that
    fails leaves its chunk as it is.
    """
    config = K.level_named(level)
    if condenser is None:
        return reduce.reduce_text(df, column, output, level)

    def make():
        shrink = kernels.reducer(config)

        def one(text: str) -> str:
            base = shrink(text)
            parts = []
            for chunk in pack(atoms(base), most):
                try:
                    parts.append(condenser(SYSTEM, ASK + chunk, budget(chunk)).strip())
                except Exception:
                    parts.append(chunk)
            digest = "\n\n".join(parts).strip()
            return digest if fidelity.report(base, digest)["ok"] else base

        return one

    return df.withColumn(output, reduce.text_udf(make)(F.col(column)))
