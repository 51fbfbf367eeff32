"""SimHash near-duplicates by anchor-point covering (operator 4).

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link if
they differ in at most ``threshold`` bits.

Covering: the 64 bits are cut into blocks; of two linked fingerprints some block differs in at most t bits, t
being the threshold shared out. The anchors of a block are the words of a covering code: a Hamming code, whose
balls of radius 1 cover the space exactly, on as many of its bits as the code is long, all values on the rest.
A fingerprint's home is the anchor within the covering radius 1; it is replicated to every anchor within 1 + t,
so whatever links to it by that block finds it at its own home. Each pair is compared on all 64 bits per anchor.
The blocks depend on the number of distinct fingerprints: three blocks (t = 1) send a fingerprint to 45
anchors, two (t = 2) to 343 but with far fewer strangers at each; either finds every link.

Equal fingerprints are one row before any replication. An anchor gives a spanning forest of its links, not all
pairs. An anchor with many homes becomes a grid of cells, each with a part of the homes and of the rows near it.

Edge cases: null and empty texts have the zero fingerprint and link like any other; documents with fewer words
than a shingle have one shingle, and a text of any length is hashed whole; a bit that is set in just half the hashes
is 0; a null id never names a component unless all its ids are null; repeated rows stay; extra columns are left out
(``one_of_each`` keeps them, whatever their names); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, meet, ship
from .components import components, named

ship(__name__)

CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the contract's white space
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, tie: Column | None = None) -> DataFrame:
    """(doc_id, fp, tie): the fingerprint as a signed 64-bit number; ``tie`` is passed through."""
    def run(batches):
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "tie"])

    own = (F.lit(0) if tie is None else tie).cast("long").alias("tie")
    return docs.select(F.col("doc_id").cast("long"), "text", own).mapInArrow(run, "doc_id long, fp long, tie long")


class Block:
    """Bits ``shift`` to ``shift + width`` of a fingerprint, with a Hamming code on its lowest 2**r - 1 bits."""

    def __init__(self, number: int, shift: int, width: int, r: int, t: int):
        self.number, self.shift, self.width, self.r = number, shift, width, r
        n = (1 << r) - 1
        if n > width:
            raise ValueError("the code is longer than the block")
        self.masks = [sum(1 << i for i in range(n) if (i + 1) >> j & 1) for j in range(r)]
        by_syndrome: list[list[int]] = [[] for _ in range(1 << r)]
        for weight in range(t + 2):
            for bits in combinations(range(width), weight):
                s = 0
                for i in bits:
                    s ^= i + 1 if i < n else 0
                by_syndrome[s].append(sum(1 << i for i in bits))
        self.near = [np.array(x, np.uint64) for x in by_syndrome]

    def value(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for j, m in enumerate(self.masks):
            s |= (np.bitwise_count(x & np.uint64(m)) & 1).astype(np.int64) << j
        return s

    def key(self, anchors: np.ndarray) -> np.ndarray:
        return (np.uint64(self.number) << np.uint64(40) | anchors).astype(np.int64)

    def homes(self, fps: np.ndarray) -> np.ndarray:
        x = self.value(fps)
        s = self.syndrome(x)
        return self.key(x ^ np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0)))

    def anchors(self, fps: np.ndarray):
        """(keys, fingerprints) for every anchor within 1 + t."""
        x = self.value(fps)
        s = self.syndrome(x)
        for code in range(1 << self.r):
            own = s == code
            if own.any():
                yield self.key((x[own][:, None] ^ self.near[code][None, :]).ravel()), np.repeat(fps[own], len(self.near[code]))


def design(threshold: int, blocks: int) -> list[Block]:
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    out, shift = [], 0
    for i, w in enumerate(widths):
        r = max(r for r in range(1, 7) if (1 << r) - 1 <= w)
        out.append(Block(i, shift, w, r, threshold // blocks))
        shift += w
    return out


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) -> links of every node to its component's smallest, without the loops."""
    ids, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = inverse[: len(u)], inverse[len(u) :], np.arange(len(ids))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    far = np.flatnonzero(up != np.arange(len(ids)))
    return ids[far], ids[up[far]]


def links_at(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int, most_pairs: int = 1 << 20):
    """Spanning links among rows of whole anchors: each home row against all rows of its anchor."""
    order = np.argsort(keys, kind="stable")
    keys, fps, home = keys[order], fps[order], home[order]
    own = np.flatnonzero(home)
    low, high = np.searchsorted(keys, keys[own], "left"), np.searchsorted(keys, keys[own], "right")
    many, kept_u, kept_v, held = high - low, [], [], 0
    ends = np.cumsum(many)
    at, total = 0, len(own)
    while at < total:
        base = ends[at] - many[at]
        to = max(at + 1, int(np.searchsorted(ends, base + most_pairs, "right")))
        n = many[at:to]
        left = np.repeat(fps[own[at:to]], n)
        right = fps[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)]
        hit = (left != right) & (np.bitwise_count(left ^ right) <= threshold)
        if hit.any():
            u, v = forest(left[hit], right[hit])
            kept_u.append(u)
            kept_v.append(v)
            held += len(u)
            if held > most_pairs:
                u, v = forest(np.concatenate(kept_u), np.concatenate(kept_v))
                kept_u, kept_v, held = [u], [v], 0
        at = to
    if not kept_u:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return forest(np.concatenate(kept_u), np.concatenate(kept_v))


def links(distinct: DataFrame, threshold: int = 4, blocks: int | None = None, rows_a_task: int = 1 << 19,
          most_homes: int = 1 << 13) -> DataFrame:
    """(fp) distinct fingerprints -> (u, v) links that connect whatever is within ``threshold``."""
    n = distinct.count()
    blocks = blocks or (3 if n < 400_000_000 else 2)
    plan = design(threshold, blocks)

    def homes(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([b.homes(fps) for b in plan]))], ["key"])

    crowded = (distinct.select("fp").mapInArrow(homes, "key long").groupBy("key").count().where(F.col("count") > most_homes)
               .select("key", F.ceil(F.col("count") / most_homes).cast("int").alias("salts")))
    crowded = cut(crowded)
    n_crowded = crowded.count()

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps = batch.column(0).to_numpy()[at : at + 2048].view(np.uint64)
                for b in plan:
                    home = b.homes(fps)
                    keys, copies = map(np.concatenate, zip(*b.anchors(fps)))
                    order = np.argsort(fps)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(copies.view(np.int64)), pa.array(home[order][np.searchsorted(fps[order], copies)] == keys)], ["key", "fp", "home"])

    routed = distinct.select("fp").mapInArrow(route, "key long, fp long, home boolean")
    if n_crowded:
        # a crowded anchor becomes a grid of cells: a home meets each part of the rows near the anchor in one cell
        small = F.broadcast(crowded) if n_crowded <= 10_000 else crowded
        routed = routed.join(small, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        routed = routed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
        all_ = F.sequence(F.lit(0), F.col("salts") - 1)
        as_near = F.transform(all_, lambda i: F.struct(i.alias("row"), F.col("own").alias("column"), F.lit(False).alias("home")))
        as_home = F.transform(all_, lambda j: F.struct(F.col("own").alias("row"), j.alias("column"), F.lit(True).alias("home")))
        routed = (routed.withColumn("cell", F.explode(F.when(F.col("home"), F.concat(as_near, as_home)).otherwise(as_near)))
                  .select(F.xxhash64("key", "cell.row", "cell.column").alias("key"), "fp", "cell.home"))
    copies = sum(sum(map(len, b.near)) / len(b.near) for b in plan)
    tasks = max(1, int(n * copies / rows_a_task) + 1)

    def compare(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if parts:
            u, v = links_at(*map(np.concatenate, zip(*parts)), threshold)
            for at in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 100_000].view(np.int64)), pa.array(v[at : at + 100_000].view(np.int64))], ["u", "v"])

    return routed.repartition(tasks, "key").mapInArrow(compare, "u long, v long")


def one_of_each(docs: DataFrame, threshold: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, then text hash.

    The rows that stay are found on narrow rows; texts move once, to meet them. Only where a row is repeated
    whole are rows of one id and text compared once more.
    """
    tie = text_hash()
    return first_of(docs, near_duplicates(docs, threshold, shingle, tie=tie), tie)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def first_of(docs: DataFrame, groups: DataFrame, tie: Column, by: str = "component_id", every: DataFrame | None = None) -> DataFrame:
    """The first row of each of the ``groups`` (doc_id, tie, ``by``), found by minima that are combined before they are
    shuffled, and met again by id and text hash. ``every`` has (doc_id, tie) of all rows, if ``groups`` has not."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("tie").alias("tie"))).alias("first")
    kept = cut(groups.groupBy(by).agg(least).select("first.id", "first.tie")).alias("kept")
    rows = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs["doc_id"].alias("id"), tie.alias("tie")).alias("rows")
    out = rows.join(kept, F.col("rows.id").eqNullSafe(F.col("kept.id")) & (F.col("rows.tie") == F.col("kept.tie")), "left_semi")
    again = (groups if every is None else every).groupBy("doc_id", "tie").count().where("count > 1").limit(1).count()
    out = out.dropDuplicates(["id", "tie"]) if again else out
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, blocks: int | None = None, tie: Column | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, and ``tie``, if one is given."""
    prints = cut(fingerprints(docs, shingle, tie=tie))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    of = cut(named(distinct, components(links(distinct, threshold, blocks)), "fp").select("fp", "component_id", "n"))
    return meet(prints, of, "fp", prints.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                                          *([] if tie is None else ["tie"]))
