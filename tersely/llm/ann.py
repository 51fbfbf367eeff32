"""Nearest neighbours by largest inner product: a small-world graph per shard (operator 8).

Equal vectors are one node that carries its smallest ids. Nodes are dealt to shards of bounded size by a hash of
the id. A shard's index is a hierarchical navigable small-world graph in flat arrays: a level for each node
(geometric, by hash), and for each level one array of neighbours, ``degree`` a node. Nodes are inserted from the
highest level down, a block at a time: a block searches the graph as it stands, meets its own members exactly,
and each node links to near ones that are not nearer to one another (the usual diversity rule); a node that gets
too many links keeps those that the same rule chooses. Inner product becomes a distance by one more coordinate
that gives all vectors of a graph the same length; vectors of a shard whose lengths lie far apart are graphs of
their own.

A search enters at the top, descends greedily, and keeps a beam on the ground level; queries move in blocks. Each
shard's rows go to one task once, and the queries stream past them, so the index is never copied; a query goes
to every shard, and its best come from all of them. Shards grow with the table up to ``MOST_ROWS`` vectors, so up
to 64 times as many vectors there are at most 64 shards. The scores that decide are double-precision inner
products of the original vectors, which are never rounded; the graph is walked in single precision.

Edge cases: null, empty, all-zero and non-finite vectors and those with null components take no part, nor do
vectors with a null id; vectors of another length are never compared; an empty table gives an empty result; a
tie goes to the smaller id; rows that repeat an id with one vector count once; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, ship

ship(__name__)

LEAST_ROWS, MOST_ROWS = 1 << 13, 1 << 18


def chosen(vectors: np.ndarray, sims: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none), those nearer to the node than to any chosen before;
    then the nearest of the rest. At most ``degree`` a row, -1 where there are fewer."""
    n, c = near.shape
    between = np.einsum("nad,nbd->nab", vectors[near], vectors[near])
    ok = np.zeros((n, c), bool)
    for j in range(c):
        blocked = (ok[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
        ok[:, j] = ~blocked & (near[:, j] >= 0) & (ok[:, :j].sum(axis=1) < degree)
    rank = np.where(near < 0, 3 * c, np.where(ok, 0, c)) + np.arange(c)
    best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    return np.take_along_axis(near, best, axis=1)


def log_norms(x: np.ndarray) -> np.ndarray:
    """Logarithms of the lengths; no length is too large or small for that."""
    top = np.abs(x).max(axis=1)
    y = x / top[:, None]
    return np.log(top) + 0.5 * np.log(np.einsum("nd,nd->n", y, y))


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of one length 1, in double precision, whose inner products with (q, 0) rank like the original ones."""
    x = x.astype(np.float64)
    size = log_norms(x)
    size = np.exp(size - size.max())
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x *= (size / np.sqrt(np.einsum("nd,nd->n", x, x)))[:, None]
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - size**2))[:, None]], axis=1)


def bands(x: np.ndarray, ratio: float = 32.0) -> list[np.ndarray]:
    """Positions by length, longest first, cut where the longest of a band is more than ``ratio`` times as long: lifted
    beside one that is far longer, vectors would all look alike. Ordinary vectors are one band."""
    size = log_norms(x.astype(np.float64))
    order = np.argsort(-size, kind="stable")
    out, at = [], 0
    while at < len(order):
        to = at + int(np.searchsorted(-size[order[at:]], np.log(ratio) - size[order[at]], "right"))
        out.append(np.sort(order[at:to]))
        at = to
    return out


def reached(table: np.ndarray, start: np.ndarray, seen: np.ndarray) -> None:
    """Mark in ``seen`` all that can be reached from ``start``."""
    seen[start] = True
    while len(start):
        near = np.unique(table[start])
        start = near[near >= 0]
        start = start[~seen[start]]
        seen[start] = True


def all_reachable(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``table`` with one column more where nodes cannot be reached from the first: the nearest node that can be, and
    has its place free, links to one of them."""
    seen, extra = np.zeros(len(x), bool), np.full((len(x), 1), -1, np.int32)
    reached(table, np.array([0]), seen)
    if seen.all():
        return table
    while not seen.all():
        u = int(np.argmin(seen))
        free = np.flatnonzero(seen & (extra[:, 0] < 0))
        extra[free[np.argmax(x[free] @ x[u])], 0] = u
        reached(np.concatenate([table, extra], axis=1), np.array([u]), seen)
    return np.concatenate([table, extra], axis=1)


def levels_of(ids: np.ndarray, degree: int) -> np.ndarray:
    """A node's top level: geometric with ratio 1 / (degree / 2), from a hash of its id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    u = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(np.floor(-np.log(u) / np.log(degree / 2)), 12).astype(np.int32)


class Level:
    """One level while nodes are inserted: its nodes, where a node stands among them, and the neighbour table."""

    def __init__(self, nodes: np.ndarray, n: int, degree: int):
        self.nodes, self.degree = nodes, degree
        self.place = np.full(n, -1, np.int64)
        self.place[nodes] = np.arange(len(nodes))
        self.table = np.full((len(nodes), degree), -1, np.int32)

    def neighbours(self, at: np.ndarray) -> np.ndarray:
        return self.table[self.place[at]]

    def link(self, x: np.ndarray, new: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Links ``new`` to the chosen of their candidates (nearest first), and these back."""
        pick = chosen(x, sims, near, max(1, self.degree // 2))
        self.table[self.place[new], : pick.shape[1]] = pick
        row, column = np.nonzero(pick >= 0)
        to, back = pick[row, column].astype(np.int64), new[row]
        ends, start, many = np.unique(to, return_inverse=True, return_counts=True)
        order = np.argsort(start, kind="stable")
        first = np.cumsum(many) - many
        slot = np.arange(len(to)) - first[start[order]]
        for at in range(0, len(ends), 256):
            part = slice(at, min(at + 256, len(ends)))
            mine = (start[order] >= part.start) & (start[order] < part.stop)
            own = self.neighbours(ends[part])
            extra = np.full((len(own), int(many[part].max())), -1, np.int64)
            extra[start[order][mine] - at, slot[mine]] = back[order][mine]
            both = np.concatenate([own, extra], axis=1)
            twice = (extra[:, :, None] == own[:, None, :]).any(axis=2) & (extra >= 0)
            both[:, own.shape[1] :][twice] = -1
            s = np.where(both >= 0, np.einsum("nd,nmd->nm", x[ends[part]], x[both]), -np.inf)
            best = np.argsort(-s, axis=1, kind="stable")
            both, s = np.take_along_axis(both, best, axis=1), np.take_along_axis(s, best, axis=1)
            full = (both >= 0).sum(axis=1) > self.degree
            kept = both[:, : self.degree].copy()
            if full.any():
                kept[full] = chosen(x, s[full], both[full], self.degree)
            self.table[self.place[ends[part]], : kept.shape[1]] = kept


def descend(x: np.ndarray, level: Level, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where each query ends that moves to its nearest neighbour as long as that is nearer."""
    at, best = at.copy(), np.einsum("qd,qd->q", q, x[at])
    moving = np.arange(len(q))
    while len(moving):
        near = level.neighbours(at[moving])
        s = np.where(near >= 0, np.einsum("qd,qmd->qm", q[moving], x[near]), -np.inf)
        j = s.argmax(axis=1)
        top = s[np.arange(len(moving)), j]
        better = top > best[moving]
        moving, near, j, top = moving[better], near[better], j[better], top[better]
        at[moving], best[moving] = near[np.arange(len(moving)), j], top
    return at


def explore(x: np.ndarray, level: Level, q: np.ndarray, starts: np.ndarray, beam: int, widen: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(positions, similarities) of a beam's nearest on one level, nearest first, -1 where there are fewer; every query
    starts at the positions of its row of ``starts``."""
    nq, n = len(q), len(level.nodes)
    beam = max(1, min(beam, n))
    ids, sims = np.full((nq, beam), -1, np.int64), np.full((nq, beam), -np.inf, x.dtype)
    seen, each = np.zeros((nq, n), bool), np.arange(nq)
    for j, at in enumerate(starts.T[:beam]):
        fresh = ~seen[each, level.place[at]]
        seen[each, level.place[at]] = True
        ids[fresh, j], sims[fresh, j] = at[fresh], np.einsum("qd,qd->q", q[fresh], x[at[fresh]])
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    open_ = ids >= 0
    live = each
    while len(live):
        order = np.argsort(~open_[live], axis=1, kind="stable")[:, :widen]  # beams are sorted: the nearest open ones
        take = np.take_along_axis(open_[live], order, axis=1)
        source = np.take_along_axis(ids[live], order, axis=1)
        rows = np.repeat(live[:, None], order.shape[1], axis=1)
        open_[rows[take], order[take]] = False
        near = np.where(take[:, :, None], level.neighbours(np.where(take, source, level.nodes[0])), -1).reshape(len(live), -1)
        flat_row, flat = np.nonzero(near >= 0)
        flat = level.place[near[flat_row, flat]]
        fresh = ~seen[live[flat_row], flat]
        key = np.unique(flat_row[fresh] * n + flat[fresh])
        flat_row, flat = key // n, key % n
        seen[live[flat_row], flat] = True
        flat = level.nodes[flat]
        s = np.einsum("md,md->m", q[live[flat_row]], x[flat])
        width = int(np.bincount(flat_row, minlength=len(live)).max()) if len(flat) else 0
        place = np.arange(len(flat)) - np.searchsorted(flat_row, flat_row)
        new_ids, new_s = np.full((len(live), width), -1, np.int64), np.full((len(live), width), -np.inf, x.dtype)
        new_ids[flat_row, place], new_s[flat_row, place] = flat, s
        all_ids, all_s = np.concatenate([ids[live], new_ids], axis=1), np.concatenate([sims[live], new_s], axis=1)
        all_open = np.concatenate([open_[live], new_ids >= 0], axis=1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids[live], sims[live], open_[live] = (np.take_along_axis(a, order, axis=1) for a in (all_ids, all_s, all_open))
        live = live[open_[live].any(axis=1)]
    return ids, sims


def build(ids: np.ndarray, vectors: np.ndarray, degree: int, beam: int = 64) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(levels, [(nodes of the level, their neighbour table by node)] from the ground up)."""
    x, top = lifted(vectors).astype(np.float32), levels_of(ids, degree)
    n = len(x)
    levels = [Level(np.flatnonzero(top >= i), n, degree if i == 0 else max(2, degree // 2)) for i in range(int(top.max()) + 1)]
    order = np.argsort(-top, kind="stable")
    most = max(16, min(512, (1 << 25) // n))
    at = 0
    while at < n:
        block = order[at : at + max(1, min(most, at // 2))] if at else order[:1]
        here = np.full(len(block), order[0])
        for i in range(len(levels) - 1, -1, -1):
            level, on = levels[i], top[block] >= i
            if not at:
                continue
            if not on.any():
                here = descend(x, level, x[block], here)
                continue
            found, sims = explore(x, level, x[block], here[:, None], beam)
            here = found[:, 0]
            # members of the block that are on this level meet exactly; each sees those that come before it
            inner = x[block] @ x[block[on]].T
            inner[np.flatnonzero(on)[None, :] >= np.arange(len(block))[:, None]] = -np.inf
            found = np.concatenate([found, np.where(inner > -np.inf, block[on][None, :], -1)], axis=1)[on]
            sims = np.concatenate([sims, inner], axis=1)[on]
            near = np.argsort(-sims, axis=1, kind="stable")[:, : level.degree + level.degree // 2]
            level.link(x, block[on], np.take_along_axis(found, near, axis=1), np.take_along_axis(sims, near, axis=1))
        at += len(block)
    graph = [(level.nodes, level.table) for level in levels]
    graph[0] = (levels[0].nodes, all_reachable(levels[0].table, x))
    return top, graph


def search(x: np.ndarray, graph: list[Level], queries: np.ndarray, k: int, beam: int) -> np.ndarray:
    """Positions of each query's nearest found, nearest first, -1 where there are fewer."""
    q = np.concatenate([queries, np.zeros((len(queries), 1), queries.dtype)], axis=1)
    at = np.full(len(q), graph[-1].nodes[0])
    for level in reversed(graph[1:]):
        at = descend(x, level, q, at)
    # from the first node all others can be reached
    return explore(x, graph[0], q, np.stack([at, np.zeros(len(q), np.int64)], axis=1), beam)[0][:, :k]


def usable(v):
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nodes_of(vectors: DataFrame, most: int) -> DataFrame:
    """(h0, h1, rep, vector, ids): distinct vectors with their ``most`` smallest ids."""
    w = W.partitionBy("h0", "h1").orderBy("vec_id")
    kept = vectors.select("h0", "h1", "vec_id").withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= most).distinct()
    ids = kept.groupBy("h0", "h1").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    reps = vectors.groupBy("h0", "h1").agg(F.min_by("vector", "vec_id").alias("vector"))
    return reps.join(ids, ["h0", "h1"]).select("h0", "h1", F.element_at("ids", 1).alias("rep"), "vector", "ids")


def build_index(nodes: DataFrame, shards: int, degree: int = 32) -> DataFrame:
    """(rep, vector, ids) -> the index's flat rows: shard, dim, rep, level, vector, ids, links (positions by level,
    in order of ``rep`` within the band of the shard)."""
    sharded = nodes.select(F.pmod(F.xxhash64("rep", F.size("vector")), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"), "rep", "vector", "ids")
    number = dict(nodes.dtypes)["vector"]
    kind = pa.list_(pa.float32() if number == "array<float>" else pa.float64())

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        ids = table["rep"].to_numpy()
        x = matrix(table["vector"], table["dim"][0].as_py())
        links: list[list] = [[] for _ in ids]
        levels = np.zeros(len(ids), np.int32)
        for band in bands(x):
            levels[band], graph = build(ids[band], x[band], degree)
            for nodes_, rows in graph:
                for i, row in zip(band[nodes_].tolist(), rows):
                    links[i].append(row[row >= 0])
        return pa.table({"shard": table["shard"], "dim": table["dim"], "rep": table["rep"], "level": pa.array(levels), "vector": table["vector"].cast(kind),
                         "ids": table["ids"].cast(pa.list_(pa.int64())), "links": pa.array(links, pa.list_(pa.list_(pa.int32())))})

    return sharded.groupBy("shard", "dim").applyInArrow(make, f"shard int, dim int, rep long, level int, vector {number}, ids array<long>, links array<array<int>>")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length side by side, in the precision in which they came."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Shard:
    """A shard's vectors and graphs, made of its flat rows in order of ``rep``."""

    def __init__(self, rows: pa.Table, dim: int, degree: int):
        self.rep, self.ids, self.raw = rows["rep"].to_numpy(), rows["ids"].combine_chunks(), matrix(rows["vector"], dim)
        links, self.bands = rows["links"].to_pylist(), []
        for band in bands(self.raw):
            graph = []
            for level in range(max(len(links[i]) for i in band)):
                own = np.array([j for j, i in enumerate(band) if len(links[i]) > level], np.int64)
                part = Level(own, len(band), degree + 1)
                for r, j in enumerate(own):
                    near = links[band[j]][level]
                    part.table[r, : len(near)] = near
                graph.append(part)
            self.bands.append((band, lifted(self.raw[band]).astype(np.float32), graph))

    def find(self, want: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, node, score) of the nearest found; every query in every band."""
        unit = (want / np.abs(want).max(axis=1, keepdims=True)).astype(np.float32)
        row, node = [], []
        for band, x, graph in self.bands:
            size = max(16, min(256, (1 << 25) // len(x)))
            got = np.concatenate([search(x, graph, unit[i : i + size], k, max(beam, k)) for i in range(0, len(unit), size)])
            r, c = np.nonzero(got >= 0)
            row.append(r)
            node.append(band[got[r, c]])
        row, node = np.concatenate(row), np.concatenate(node)
        return row, node, np.einsum("md,md->m", want[row], self.raw[node].astype(np.float64))


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int = 21, beam: int = 96, degree: int = 32) -> DataFrame:
    """(h0, h1, vector) queries against every shard: h0, h1, rep, ids, score, each query's best ``k`` distinct vectors
    over all shards. A task takes its shards one after another: a shard's rows come first, then the queries in
    batches, so it holds one shard and one batch."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("h0", "long"), ("h1", "long"))]
    rows = index.select("shard", "dim", F.lit(0).alias("asks"), "rep", "vector", "ids", "links", *none)
    asks = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("vector").alias("dim"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("rep"),
                          "vector", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<array<int>>").alias("links"), "h0", "h1")
    both = rows.unionByName(asks).repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "asks", "rep")

    def run(batches):
        held, key, shard = [], None, None
        for batch in batches:
            place = list(zip(batch.column("shard").to_pylist(), batch.column("dim").to_pylist(), batch.column("asks").to_pylist()))
            edges = [0, *[i for i in range(1, len(place)) if place[i] != place[i - 1]], len(place)]
            for a, b in zip(edges[:-1], edges[1:]):
                if b == a:
                    continue
                if place[a][:2] != key:
                    held, key, shard = [], place[a][:2], None
                part = batch.slice(a, b - a)
                if not place[a][2]:
                    held.append(part)
                    continue
                if shard is None and held:
                    shard, held = Shard(pa.Table.from_batches(held), key[1], degree), []
                if shard is not None:
                    row, node, score = shard.find(matrix(part.column("vector"), key[1]).astype(np.float64), k, beam)
                    for i in range(0, len(row), 20_000):
                        r, n = row[i : i + 20_000], node[i : i + 20_000]
                        yield pa.RecordBatch.from_arrays([part.column("h0").take(pa.array(r)), part.column("h1").take(pa.array(r)), pa.array(shard.rep[n]),
                                                          shard.ids.take(pa.array(n)).cast(pa.list_(pa.int64())), pa.array(score[i : i + 20_000])], ["h0", "h1", "rep", "ids", "score"])

    found = both.mapInArrow(run, "h0 long, h1 long, rep long, ids array<long>, score double")
    best = W.partitionBy("h0", "h1").orderBy(F.col("score").desc(), "rep")
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def nearest(table: DataFrame, every: int = 20, k: int = 20, shard_rows: int | None = None, degree: int = 32, beam: int = 96) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    number = "float" if dict(table.dtypes)["embedding"] == "array<float>" else "double"
    v = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{number}>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    v = v.withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast(number)).otherwise(x)))
    v = v.withColumn("h0", F.xxhash64("vector")).withColumn("h1", F.xxhash64(F.lit("second"), F.col("vector")))
    nodes = cut(nodes_of(v, k + 1))
    n = nodes.count()
    shards = max(1, -(-n // (shard_rows or max(LEAST_ROWS, min(MOST_ROWS, n // 64)))))
    index = cut(build_index(nodes, shards, degree))
    asked = v.where(F.col("vec_id") % every == 0).select("h0", "h1", "vec_id").distinct()
    wanted = nodes.join(asked.select("h0", "h1").distinct(), ["h0", "h1"], "left_semi").select("h0", "h1", "vector")
    found = search_index(index, wanted, shards, k + 1, beam, degree=degree)
    lists = found.groupBy("h0", "h1").agg(F.collect_list(F.struct("score", "ids")).alias("_found"))
    flat = F.flatten(F.transform("_found", lambda r: F.transform(r["ids"], lambda i: F.struct((-r["score"]).alias("down"), i.alias("vec_id")))))
    best = F.slice(F.array_sort(F.filter(flat, lambda r: r["vec_id"] != F.col("query_id"))), 1, k)
    out = asked.withColumnRenamed("vec_id", "query_id").join(lists, ["h0", "h1"]).select("query_id", F.posexplode(best).alias("pos", "r"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.down")).alias("score"))
