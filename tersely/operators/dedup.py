"""Repetition across rows: first occurrence by key, as windows and joins; scales past one document.

The window forms shuffle rows by (document, key), so a long document is many groups, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import constants as K
from ..functions import text as X


def parts(df: DataFrame, doc: str, pieces: Column, out: str = "part") -> DataFrame:
    """(doc, pos, part, part_key): the pieces of each document in order."""
    return df.select(doc, F.posexplode(pieces).alias("pos", out)).withColumn(f"{out}_key", X.key(F.col(out)))


def first_occurrences(rows: DataFrame, doc: str | None, key: str, order: list[str], shortest: int = 0) -> DataFrame:
    """Rows whose key has not come before in the document (in all rows, without one). Keys under ``shortest``
    characters always stay; such a row is a group of its own, so a short key that is very common is no hot group."""
    short = F.length(key) < shortest
    alone = [F.when(short, F.col(c)) for c in order] if shortest else []
    w = W.partitionBy(*([doc] if doc else []), F.when(short, F.lit("")).otherwise(F.col(key)) if shortest else key, *alone).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rebuild(rows: DataFrame, doc: str, part: str, order: str, separator: str, out: str = "text") -> DataFrame:
    """The kept parts of each document joined in order."""
    items = F.array_sort(F.collect_list(F.struct(order, part)))
    return rows.groupBy(doc).agg(F.array_join(F.transform(items, lambda x: x[part]), separator).alias(out))


def drop_repeated_paragraphs(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text): exact paragraph repeats out, by a window. Documents without paragraphs get the empty text."""
    rows = parts(df, doc, F.when(F.size(X.paragraphs(F.col(text))) > 0, X.paragraphs(F.col(text))).otherwise(F.array(F.lit(""))))
    return rebuild(first_occurrences(rows, doc, "part_key", ["pos"]), doc, "part", "pos", "\n\n")


def drop_repeated_sentences(df: DataFrame, doc: str = "doc_id", text: str = "text", shortest: int = K.MIN_SENTENCE) -> DataFrame:
    """(doc, text): sentences that came before anywhere in the document out, paragraphs rebuilt. A document is a row of
    its id and text, so rows without an id, or of one id with different texts, are documents of their own."""
    own = [F.col(doc).alias("_doc"), F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")).alias("_own")]
    docs = df.select(doc, text, *own)
    p = docs.select("_doc", "_own", text).distinct().select("_doc", "_own", F.posexplode(X.paragraphs(F.col(text))).alias("p", "par"))
    s = p.select("_doc", "_own", "p", F.posexplode(X.sentences(F.col("par"))).alias("s", "sent")).withColumn("k", X.key(F.col("sent")))
    short = F.length("k") < shortest
    alone = [F.when(short, F.col(c)) for c in ("p", "s")]
    w = W.partitionBy("_doc", "_own", F.when(short, F.lit("")).otherwise(F.col("k")), *alone).orderBy("p", "s")
    kept = s.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    items = F.array_sort(F.collect_list(F.struct("s", "sent")))
    pars = kept.groupBy("_doc", "_own", "p").agg(X.strip(F.array_join(F.transform(items, lambda x: x["sent"]), " ")).alias("par")).where("par != ''")
    whole = F.array_sort(F.collect_list(F.struct("p", "par")))
    out = pars.groupBy("_doc", "_own").agg(F.array_join(F.transform(whole, lambda x: x["par"]), "\n\n").alias("_new")).alias("o")
    docs = docs.select("_doc", "_own").alias("d")
    met = docs.join(out, F.col("d._doc").eqNullSafe(F.col("o._doc")) & (F.col("d._own") == F.col("o._own")), "left")
    return met.select(F.col("d._doc").alias(doc), F.coalesce("_new", F.lit("")).alias("text"))


def drop_repeated_items(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text): exact repeats within one unbroken run of list lines out. A run is an island: its number is
    the count of breaks before it. For text without fences; the kernel of that name heeds them."""
    lines = df.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    lines = lines.withColumn("item", X.is_list_item(F.col("line")))
    lines = lines.withColumn("run", F.sum(F.when(F.col("item"), 0).otherwise(1)).over(W.partitionBy(doc).orderBy("pos")))
    k = F.when(F.col("item"), X.key(X.item_content(F.col("line"))))
    ranked = lines.withColumn("_r", F.row_number().over(W.partitionBy(doc, "run", "item", k).orderBy("pos")))
    return rebuild(ranked.where(~F.col("item") | (F.col("_r") == 1)), doc, "line", "pos", "\n")


def drop_repeated_documents(df: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Extension: one row for each text of the whole corpus, by key: that with the smallest ``order``, nulls last. Only
    (digest, order) is aggregated, a digest that many rows share before the shuffle; texts then meet their digest and
    order. Rows that repeat both are one; null text counts as empty; all columns are kept."""
    columns = [F.struct(*[df[c].alias(f"c{i}") for i, c in enumerate(df.columns)]).alias("row"), df[order].alias("at"),
               F.sha2(X.key(F.coalesce(df[text], F.lit(""))).cast("binary"), 256).alias("digest")]
    rows = df.select(*columns)
    least = rows.groupBy("digest").agg(F.min(F.struct(F.col("at").isNull().alias("none"), "at")).alias("first"), F.count("*").alias("n"))
    least = least.select("digest", F.col("first.at").alias("at")).alias("l")
    rows = rows.alias("r")
    kept = rows.join(least, (F.col("r.digest") == F.col("l.digest")) & F.col("r.at").eqNullSafe(F.col("l.at")), "left_semi")
    return kept.dropDuplicates(["digest"]).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(df.columns)])
