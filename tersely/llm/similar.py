"""Near-duplicates by shingle similarity: every pair of texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8 is linked, and no other.

Equal sets are one node. The nodes' SimHash fingerprints meet by op4's anchor covering: what is within five bits forms a
cluster, which keeps large groups of near copies together. The covering promises no similarity of 0.8 (some ten bits), so what it leaves apart
meets again exactly: two sets that similar share a shingle among the first n - ceil(0.8 n) + 1 of each in any one
order of all shingles (prefix filter). The order puts shingles last that a fixed share of the texts shows to be common; it decides
only how many candidates there are. Shingles with the same nodes are one meeting; nodes of different clusters at a meeting join
them, unless sizes or parity bits (a bit for every one or two shingles) show that they cannot be similar, which loses none. Last, the
whole sets of each cluster meet, a large cluster's in a grid of cells, and only pairs found similar there are links. No pair is ever
a row before it is verified; clusters, meetings and links are spanning forests.

Edge cases: null and empty texts have the empty set and are copies of each other; texts with fewer words than a
shingle have one shingle, and a text of any length has its whole set; of a group the smallest id stays, null ids
last, ties by a hash of the text, repeated rows once; extra columns are kept whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, discard, meet, release, ship
from .components import components, named

ship(__name__)

PAIR = "u long, v long"
#: Bits by which fingerprints of one cluster may differ: the three blocks of op4's covering for four bits find five as well.
THRESHOLD = 5


def parity(items: np.ndarray, words: int = 4) -> np.ndarray:
    """A set's parity bits: each shingle turns one of 64 ``words`` over, so two sets differ in no fewer shingles than bits."""
    odd = (np.bincount(items & (64 * words - 1), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def parity_words(n: int) -> int:
    """Words of parity bits for a set of size n: a power of two, of as many bits as shingles or fewer, but 256 at least."""
    return max(4, 1 << max(0, n.bit_length() - 7))


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64)


def near_enough(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether parity bits let sets of these sizes be similar: such sets differ in a ninth of both sizes at most."""
    return 9 * bits_apart(x, y) <= n + m


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(size, len(words))
    first, last = (ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), np.uint64, len(first)).view(np.int64))


def sets_of(docs: DataFrame, size: int = 5) -> DataFrame:
    """(node, items): each text's set and the hash that names it."""
    def run(batches):
        import xxhash

        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(0)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items array<long>")


def common_shingles(docs: DataFrame, size: int = 5, share: int = 8, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) seen three times or more in one of ``share`` texts, drawn by hash; the more frequent ones if they
    are more than ``most``. For the order only. As the share is fixed, what is common in a table stays so in a larger one."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counted = cut(sets_of(part, size).dropDuplicates(["node"]).select(F.explode("items").alias("s")).groupBy("s").agg(F.count("*").alias("many"))
                  .where("many > 2").withColumn("level", F.floor(4 * F.log2("many"))))
    least, held = 1 << 30, 0
    for level, n in sorted(map(tuple, counted.groupBy("level").count().collect()), reverse=True):
        held += n
        if held > most:
            break
        least = level
    rows = counted.where(F.col("level") >= least).select("s", "many").toArrow()
    s, many = rows.column("s").to_numpy(), rows.column("many").to_numpy()
    order = np.argsort(s)
    discard(counted)
    return s[order], many[order]


def prefix(n: int) -> int:
    """How many of a set's first shingles a similar set must share one of."""
    return n - (4 * n + 4) // 5 + 1


def first_shingles(docs: DataFrame, common: np.ndarray, counts: np.ndarray, size: int = 5) -> DataFrame:
    """(doc_id, tie, at, node, n, fp, bits, first): a hash of the text, the name and size of its set, the set's fingerprint and
    parity bits, and its first shingles in the order."""
    def run(batches):
        import xxhash

        for batch in batches:
            node, many, fps, bits, first = [], [], [], [], []
            for text in batch.column(3):
                x = shingles(text.as_py(), size)
                rank = np.zeros(len(x), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    rank = np.where(common[at] == x, counts[at], 0)
                node.append(xxhash.xxh64_intdigest(x.tobytes()))
                many.append(len(x))
                fps.append(fingerprint(x))
                bits.append(parity(x, parity_words(len(x))))
                first.append(np.sort(x[np.lexsort((x, rank))[: prefix(len(x)) if len(x) else 0]]))
            signed = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (node, fps)]
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (bits, first)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], signed[0], pa.array(many, pa.int64()), signed[1], *lists],
                                             ["doc_id", "tie", "at", "node", "n", "fp", "bits", "first"])

    return docs.select("doc_id", "tie", simhash.text_hash().alias("at"), "text").mapInArrow(
        run, "doc_id long, tie long, at long, node long, n long, fp long, bits array<long>, first array<long>")


def fingerprint(items: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: their bitwise majority."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(items), simhash.CHUNK):
        counts += np.unpackbits(items[at : at + simhash.CHUNK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(items)).tobytes(), "big")


def are_similar(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (n + m)


def small(df: DataFrame) -> DataFrame:
    """A checkpoint, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= 1_000_000 else df


def connected(edges: DataFrame, few: int = 1_000_000) -> DataFrame:
    """(u, v) links -> (u, label) as ``components`` has them, with any one node of each component for label, as a broadcast if
    they are few; few links need no rounds, but one task."""
    edges = cut(edges.select("u", "v"))
    if edges.count() > few:
        return small(components(edges))

    def run(batches):
        parts = [[c.to_numpy().view(np.uint64) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            u, v = simhash.forest(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "label"])

    label = cut(edges.coalesce(1).mapInArrow(run, "u long, label long"))
    discard(edges)
    return F.broadcast(label)


def covered(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, ...) with cluster: the smallest fingerprint of those that op4's anchor covering connects with theirs."""
    distinct = cut(nodes.select("fp").distinct())
    label = components(simhash.links(distinct, THRESHOLD))
    out = nodes.join(small(label.withColumnRenamed("u", "fp")), "fp", "left").withColumn("cluster", F.coalesce("label", "fp")).drop("label")
    discard(distinct)
    return out


def runs(n: np.ndarray, cluster: np.ndarray):
    """(from, to) of the stretches of rising sizes ``n`` in which each may be similar to the next, of several clusters."""
    edges = np.r_[0, np.flatnonzero(4 * n[1:] > 5 * n[:-1]) + 1, len(n)].tolist()
    for at, to in zip(edges[:-1], edges[1:]):
        if to - at > 1 and (cluster[at:to] != cluster[at]).any():
            yield at, to


def meetings(nodes: DataFrame, tasks: int) -> DataFrame:
    """(meeting, node): the nodes of different clusters that meet at a first shingle, once for all shingles with the same nodes."""
    def run(batches):
        import xxhash

        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        s, node, n, cluster = map(np.concatenate, zip(*parts))
        order = np.lexsort((node, n, s))
        s, node, n, cluster = s[order], node[order], n[order], cluster[order]
        edges = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)]
        several = np.flatnonzero(np.diff(edges) > 1)
        seen: set[int] = set()
        keys, out, held = [], [], 0
        for at, to in zip(edges[several].tolist(), edges[several + 1].tolist()):
            for a, b in runs(n[at:to], cluster[at:to]):
                members = node[at + a : at + b]
                key = xxhash.xxh64_intdigest(members.tobytes())
                if key not in seen:
                    seen.add(key)
                    keys.append(np.full(b - a, key, np.uint64))
                    out.append(members)
                    held += b - a
            if held > 1 << 18:
                yield both(keys, out)
                keys, out, held = [], [], 0
        if held:
            yield both(keys, out)

    def both(keys, out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(out))], ["meeting", "node"])

    routed = nodes.select(F.explode("first").alias("s"), "node", "n", "cluster")
    return routed.repartition(tasks, "s").mapInArrow(run, "meeting long, node long").distinct()


def joined(n: np.ndarray, cluster: np.ndarray, bits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links between clusters of nodes of rising sizes ``n``: of each two that sizes and parity bits let be similar."""
    ids, label = np.unique(cluster, return_inverse=True)
    first, wide = label.copy(), np.array([len(b) for b in bits])
    tables: dict[int, tuple[int, np.ndarray]] = {}
    for i in range(len(n) - 1):
        to = int(np.searchsorted(4 * n, 5 * n[i], "right"))
        other = i + 1 + np.flatnonzero(label[i + 1 : to] != label[i])
        if not len(other):
            continue
        w = int(wide[i])
        if w not in tables:  # the nodes of as many words of bits, or of twice as many, folded
            at, end = np.searchsorted(wide, [w, 2 * w + 1])
            tables[w] = int(at), np.stack([b if len(b) == w else b[:w] ^ b[w:] for b in bits[at:end]])
        at, table = tables[w]
        for near in np.unique(label[other[near_enough(n[i], n[other], table[i - at], table[other - at])]]):
            label[label == near] = label[i]
    moved = np.flatnonzero(first != label)
    return ids[first[moved]], ids[label[moved]]


def cluster_links(nodes: DataFrame, met: DataFrame, tasks: int) -> DataFrame:
    """(u, v): links between the clusters of nodes that meet and may be similar."""
    def run(batches):
        parts = [([c.to_numpy() for c in b.columns[:4]], [x.values.to_numpy() for x in b.column(4)]) for b in batches if b.num_rows]
        if not parts:
            return
        meeting, node, n, cluster = map(np.concatenate, zip(*[p for p, _ in parts]))
        bits = [x for _, b in parts for x in b]
        order = np.lexsort((node, n, meeting))
        meeting, n, cluster = meeting[order], n[order], cluster[order]
        edges = np.r_[0, np.flatnonzero(meeting[1:] != meeting[:-1]) + 1, len(order)].tolist()
        us, vs = [], []
        for at, to in zip(edges[:-1], edges[1:]):
            u, v = joined(n[at:to], cluster[at:to], [bits[k] for k in order[at:to]])
            us.append(u)
            vs.append(v)
        u, v = simhash.forest(np.concatenate(us).view(np.uint64), np.concatenate(vs).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    rows = met.join(nodes.select("node", "n", "cluster", "bits"), "node").select("meeting", "node", "n", "cluster", "bits")
    return rows.repartition(tasks, "meeting").mapInArrow(run, PAIR)


def similar_in(node: np.ndarray, part: np.ndarray, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a cell's nodes with a similarity of 0.8 or more; ``part``: only between different parts, if it has two.
    A node's whole set meets those of all others at its shingles, unless they are connected already."""
    n = np.array([len(x) for x in items])
    order = np.argsort(n, kind="stable")
    node, part, n, items = node[order], part[order], n[order], [items[k] for k in order]
    all_, owner = np.concatenate(items), np.repeat(np.arange(len(n)), n)
    by = np.argsort(all_, kind="stable")
    sorted_, owner = all_[by], owner[by]
    label, two = np.arange(len(n)), (part != part[0]).any()
    for i in range(len(n) - 1):
        to = int(np.searchsorted(4 * n, 5 * n[i], "right"))
        fits = label[i + 1 : to] != label[i]
        if two:
            fits &= part[i + 1 : to] != part[i]
        if not fits.any():
            continue
        low, high = np.searchsorted(sorted_, items[i], "left"), np.searchsorted(sorted_, items[i], "right")
        many = high - low
        met = owner[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        shared = np.bincount(met, minlength=len(n))[i + 1 : to]
        for near in np.unique(label[i + 1 : to][fits & (9 * shared >= 4 * (n[i] + n[i + 1 : to]))]):
            label[label == near] = label[i]
    moved = np.flatnonzero(label != np.arange(len(n)))
    return node[moved], node[label[moved]]


def verified(nodes: DataFrame, firsts: DataFrame, docs: DataFrame, size: int, few: int, items_a_part: int = 1 << 20) -> DataFrame:
    """(u, v) links that connect the nodes of a cluster with a similarity of 0.8 or more. The sets of clusters of several nodes are made
    again, of one text a node; a cluster of many nodes or shingles has parts, each two of which meet in a cell."""
    several = nodes.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("all")).where("m > 1")
    several = cut(several.select("cluster", F.greatest(F.ceil(F.col("m") / few), F.ceil(F.col("all") / items_a_part)).alias("parts"), "all"))
    items = several.agg(F.sum(F.col("all") * F.col("parts"))).first()[0] or 0
    inside = nodes.select("node", "cluster").join(small(several.drop("all")), "cluster")
    one = firsts.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("one")).join(inside, "node")
    one = cut(one.select(F.col("one.doc_id").alias("one_id"), F.col("one.at").alias("one_at"), "node", "cluster", "parts"))
    texts = docs.withColumn("at", simhash.text_hash()).join(small(one), F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("at") == F.col("one_at")))

    def sets(batches):
        import xxhash

        seen: set[int] = set()
        for batch in batches:
            made = [shingles(t.as_py(), size) for t in batch.column(0)]
            own = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in made), np.uint64, len(made)).view(np.int64)
            fresh = [a == b and a not in seen and not seen.add(a) for a, b in zip(own.tolist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.list_(pa.int64()))], ["node", "cluster", "parts", "items"]).filter(pa.array(fresh, pa.bool_()))

    made = texts.select("text", "node", "cluster", "parts").mapInArrow(sets, "node long, cluster long, parts long, items array<long>")
    made = made.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = made.select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "items")

    def run(batches):
        parts = [([c.to_numpy() for c in b.columns[:5]], [x.values.to_numpy() for x in b.column(5)]) for b in batches if b.num_rows]
        if not parts:
            return
        cluster, i, j, part, node = map(np.concatenate, zip(*[p for p, _ in parts]))
        sets_ = [x for _, b in parts for x in b]
        order = np.lexsort((node, j, i, cluster))
        cluster, i, j, part, node = (c[order] for c in (cluster, i, j, part, node))
        fresh = np.r_[True, (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (node[1:] != node[:-1])]
        order, cluster, i, j, part, node = (c[fresh] for c in (order, cluster, i, j, part, node))
        edges = np.r_[0, np.flatnonzero((cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(node)].tolist()
        us, vs = zip(*[similar_in(node[a:b], part[a:b], [sets_[k] for k in order[a:b]]) for a, b in zip(edges[:-1], edges[1:])])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    tasks = int(items // (1 << 21)) + 1
    found = cut(cells.repartition(tasks, "cluster", "i", "j").mapInArrow(run, PAIR))
    discard(several, one)
    return found


def links(firsts: DataFrame, docs: DataFrame, size: int = 5, few: int = 4096, rows_a_task: int = 1 << 19) -> DataFrame:
    """(u, v) links that connect all nodes with a similarity of 0.8 or more; ``firsts`` is a checkpoint of what
    ``first_shingles`` makes of ``docs`` (doc_id, text, tie)."""
    def once(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = [n not in seen and not seen.add(n) for n in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(fresh, pa.bool_()))

    columns = "node long, n long, fp long, bits array<long>, first array<long>"
    own = firsts.select("node", "n", "fp", "bits", "first").where("n > 0").mapInArrow(once, columns).dropDuplicates(["node"])
    nodes = cut(covered(own).select("node", "n", "cluster", "bits", "first"))
    rows = nodes.agg(F.sum(F.size("first"))).first()[0] or 0
    tasks = int(rows / rows_a_task) + 1
    met = cut(meetings(nodes, tasks))
    label = connected(cluster_links(nodes, met, int(met.count() / (rows_a_task >> 2)) + 1)).withColumnRenamed("u", "cluster")
    clusters = nodes.select("node", "n", "cluster").join(label, "cluster", "left").select("node", "n", F.coalesce("label", "cluster").alias("cluster"))
    found = verified(clusters, firsts, docs, size, few)
    discard(nodes, met)
    release(firsts.sparkSession)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, few: int = 4096, tie: Column | None = None) -> DataFrame:
    """(doc_id, component_id, tie) of every document. ``few``: nodes of a part of a cluster's cells."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(0) if tie is None else tie).cast("long").alias("tie"))
    firsts = cut(first_shingles(docs, *common_shingles(docs, size), size))
    least = firsts.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    of = cut(named(least, connected(links(firsts, docs, size, few)), "node").select("node", "label", "component_id", "n"))
    rows = firsts.select("doc_id", "tie", "node")
    return meet(rows, of, "node", rows.count()).select("doc_id", "component_id", "label", "tie")


def one_of_each(docs: DataFrame, size: int = 5, few: int = 4096) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, then text hash. The first row of each
    node stands for all of them, so no row meets its group again."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", simhash.text_hash().alias("tie"))
    firsts = cut(first_shingles(narrow, *common_shingles(narrow, size), size))
    label = connected(links(firsts, narrow, size, few)).withColumnRenamed("u", "node")
    least = firsts.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("least"))
    groups = least.join(label, "node", "left").select(F.coalesce("label", "node").alias("label"), "least.doc_id", "least.tie")
    return simhash.first_of(docs, groups, simhash.text_hash(), "label", firsts)
