"""Merkle-tree fingerprints of documents (operator 7), DataFrame expressions only.

The tree: document, sections (a blank line or a heading begins one), paragraphs (lines), leaves (clauses, cut
after a mark of punctuation). A clause of more than ``LONG`` characters is cut further by its content: after words
whose checksum says so, one in 20, and inside a word that is itself that long after four characters whose
checksum does, one in 64. So a long text has many leaves whatever it is written in, and an edit changes those
around it only. Cutting drops no character, so equal roots mean equal texts. A leaf's digest is the MD5 of its
text; a node's is the SHA-256 of its children's digests. The flat form of a fingerprint is
``root:section/section``, a section being paragraphs joined by ``.`` and a paragraph the first eight digits of
its leaves' digests; so two fingerprints can be compared, and differing branches found, without the texts.

Texts move once: rows go to buckets of ids by range, with the first row of the next bucket as an end mark, and each
row meets its successor there. Fingerprints are made after that move, once a text and once an edited text.

Edge cases: null text is the empty text, which has one empty leaf; the order of documents is by id (null
first), then by a hash of the text, so repeated ids have a defined successor, and the rows of one id are many
buckets where they are many; rows that repeat id and text follow one another; a single document is its own
successor; a text of megabytes is treated whole; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import let
from .common import cut

SECTION = "(?<=\\n)(?=[ \\t]*\\n|#)"
PARAGRAPH = "(?<=\\n)"
LEAF = "(?<=[.!?,;:|])"
SHORT = 8
#: A clause's characters before it is cut by content; the modulus and remainder of the checksums that cut, of words and of
#: places in a long word.
LONG, WORDS, PLACES = 512, (20, 3), (64, 0)
WORD = "(?<=[\\x20\\x09-\\x0D])"


def joined(units: Column, last: Column) -> Column:
    """Units side by side, joined up to each one that is marked as the last of its piece."""
    def of(u: Column, ends: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(u)), lambda i: (i == 1) | F.element_at(ends, F.greatest(i - 1, F.lit(1))))
        return let(starts, lambda s: F.transform(s, lambda a, j: F.array_join(
            F.slice(u, a, F.coalesce(F.try_element_at(s, j + 2), F.size(u) + 1) - a), "")))

    return let(units, lambda u: let(last(u), lambda ends: of(u, ends)))


def cuts(text: Column, rule: tuple[int, int]) -> Column:
    return F.crc32(text.cast("binary")) % rule[0] == rule[1]


def cut_word(word: Column) -> Column:
    """A very long word in pieces, by four characters."""
    return joined(F.split(word, ""), lambda c: F.transform(c, lambda x, i: cuts(F.array_join(F.slice(c, F.greatest(i - 2, F.lit(1)), F.lit(4)), ""), PLACES)))


def cut_clause(clause: Column) -> Column:
    """A very long clause in pieces, by words."""
    words = F.flatten(F.transform(F.split(clause, WORD), lambda w: F.when(F.length(w) > LONG, cut_word(w)).otherwise(F.array(w))))
    return joined(words, lambda w: F.transform(w, lambda x: cuts(x, WORDS)))


def leaves(paragraph: Column) -> Column:
    return F.flatten(F.transform(F.split(paragraph, LEAF), lambda c: F.when(F.length(c) > LONG, cut_clause(c)).otherwise(F.array(c))))


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf digests."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), SECTION), lambda s: F.transform(
        F.split(s, PARAGRAPH), lambda p: F.transform(leaves(p), lambda leaf: F.md5(leaf.cast("binary")))))


def root_of(nodes: Column) -> Column:
    def digest(children: Column) -> Column:
        return F.sha2(F.array_join(children, "").cast("binary"), 256)

    return digest(F.transform(nodes, lambda s: digest(F.transform(s, digest))))


def flat(nodes: Column) -> Column:
    """The flat form of a tree."""
    body = F.transform(nodes, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(
        F.transform(p, lambda d: F.substring(d, 1, SHORT)), "")), "."))
    return F.concat(root_of(nodes), F.lit(":"), F.array_join(body, "/"))


def fingerprint(text: Column) -> Column:
    return let(tree(text), flat)


def leaves_of(print_: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)))


def alike(a: Column, b: Column) -> Column:
    """Dice likeness of two lists of distinct leaves: 1 for equal texts, 0 where none is shared."""
    return F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def branches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each paragraph node: section and paragraph numbers and the node's digest."""
    t = docs.select(F.col(key), F.posexplode(tree(F.col(text))).alias("section", "_s"))
    t = t.select(key, "section", F.posexplode("_s").alias("paragraph", "_p"))
    return t.select(key, "section", "paragraph", F.sha2(F.array_join("_p", "").cast("binary"), 256).alias("digest"))


def edits(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The paragraphs at which two versions differ; documents with equal roots are left out before their
    branches are compared."""
    o, n = branches(old, key=key), branches(new, key=key)
    place = [key, "section", "paragraph"]
    both = o.withColumnRenamed("digest", "old_digest").join(n.withColumnRenamed("digest", "new_digest"), place, "full")
    return both.where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))


def ordered_buckets(docs: DataFrame, rows_a_bucket: int = 512, most_quantiles: int = 512) -> DataFrame:
    """``docs`` with a bucket that rises with doc_id (null first), and where one id fills a bucket with ``_tie``.

    Buckets are quantiles of the ids, at most ``most_quantiles`` values on the driver, each cut evenly by value
    beyond that; their number follows the number of rows. An id that is several quantiles has buckets of its own.
    """
    n, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    need = max(1, -(-n // rows_a_bucket))
    coarse = min(need, most_quantiles)
    found = docs.select("doc_id").approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 1 / (8 * coarse)) if n > nulls else []
    found = [int(c) for c in found]
    hot = {c for c in found if found.count(c) > 2}
    cuts = sorted({*found, *[c + 1 for c in hot]}) or [0]
    fine = max(1, -(-need // coarse) * (1 if not hot else max(found.count(c) for c in hot)), -(-nulls // rows_a_bucket))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.greatest(F.lit(1), F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("long")
    if fine > 1:
        low = F.element_at(bounds, at)
        high = F.coalesce(F.try_element_at(bounds, at + 1), low + 1)
        by_id = (F.col("doc_id") - low).cast("double") / (high - low).cast("double")
        by_tie = F.col("_tie").cast("double") / F.lit(2.0**64) + 0.5
        alone = F.col("doc_id").isNull() | F.col("doc_id").isin(*hot) if hot else F.col("doc_id").isNull()
        part = F.floor(F.when(alone, by_tie).otherwise(by_id) * fine)
        bucket = bucket * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), part)).cast("long")
    return docs.withColumn("_bucket", bucket)


def with_next(docs: DataFrame, value: str, out: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds ``out``: ``value`` of the row that follows by doc_id, then ``_tie``, after the last the first.

    One shuffle of the rows, by bucket, each bucket with the first row of the next one that has any as its end;
    ``prepare`` works on the rows after it, before they meet. Of all rows only (id, tie) is read to find the firsts.
    """
    df = ordered_buckets(docs)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")
    first = cut(df.groupBy("_bucket").agg(F.min(place).alias("_at")))
    ring = W.orderBy("_bucket")
    ends = first.select(F.col("_bucket").alias("_of"), "_at", F.coalesce(F.lag("_bucket").over(ring), F.max("_bucket").over(W.partitionBy())).alias("_ends"))
    n = first.count()
    ends = F.broadcast(ends) if n <= 500_000 else ends
    mark = df.join(ends, (F.col("_bucket") == F.col("_of")) & (place == F.col("_at"))).dropDuplicates(["_of"])
    columns = docs.columns
    mark = mark.select(*columns, F.col("_ends").alias("_bucket"), F.lit(1).alias("_end"))
    rows = df.select(*columns, "_bucket", F.lit(0).alias("_end")).unionByName(mark)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 64))
    rows = prepare(rows.repartition(parts, "_bucket"))
    w = W.partitionBy("_bucket").orderBy("_end", F.col("doc_id").asc_nulls_first(), "_tie")
    return rows.withColumn(out, F.lead(value).over(w)).where("_end = 0").select(*columns, out)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike it is to that and to the next."""
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", body.alias("_me"), F.xxhash64(body).alias("_tie"))
    rows = with_next(rows, "_me", "_then", lambda df: df.withColumn("_me", F.struct(F.col("_me").alias("text"), fingerprint(F.col("_me")).alias("print"))))
    n = F.length("_me.text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", F.col("_me.print").alias("fingerprint"), F.col("_then.print").alias("_next_print"), n.cast("long").alias("n_chars"),
                       F.concat(F.substring(F.col("_me.text"), F.lit(1), n - quarter), F.substring(F.col("_then.text"), F.lit(1), quarter)).alias("edited"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    own = leaves_of(F.col("fingerprint"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", alike(own, leaves_of(F.col("edited_fingerprint"))).alias("near_edited"),
                       alike(own, leaves_of(F.col("_next_print"))).alias("near_next"))
