"""Operator 8 over several shards, in double precision, and its graph by insertion."""
import numpy as np
from pyspark.sql import functions as F

from tersely.llm import ann

from .test_ann import exact, run


def test_doubles_are_not_rounded(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(100, [1e200, 1.0, -1e190]), (120, [1e-200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.nearest(df, shard_rows=30, beam=64).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) <= 1e-13 * abs(b) for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_small_shards_of_several_lengths_find_all(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3 + i % 3).astype(np.float32).tolist()) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(0, 600, 7)]
    got = run(spark, rows, shard_rows=50, beam=64)
    for dim in (3, 4, 5):
        for q, best in exact([r for r in rows if len(r[1]) == dim]).items():
            assert [i for i, _ in got[q]] == [i for i, _ in best]


def test_every_index_row_is_moved_once(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(400, 4)).tolist())], "vec_id long, vector array<double>")
    nodes = df.select(F.xxhash64("vec_id").alias("h0"), F.col("vec_id").alias("h1"), F.col("vec_id").alias("rep"), "vector", F.array("vec_id").alias("ids"))
    index = ann.build_index(nodes, 4)
    assert index.count() == 400 and index.select("shard").distinct().count() == 4
    found = ann.search_index(index, nodes, 4, k=5, beam=400)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    x = np.array([r.vector for r in df.orderBy("vec_id").collect()])
    best = {(r.h1, r.rep) for r in found.collect()}
    s = x @ x.T
    assert best == {(i, int(j)) for i in range(400) for j in np.argsort(-s[i], kind="stable")[:5]}


def test_insertion_by_blocks_gives_a_graph_that_finds(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 12))
    _, graph = ann.build(np.arange(3000), x, 16)
    levels = []
    for nodes, table in graph:
        level = ann.Level(nodes, 3000, table.shape[1])
        level.table = table
        levels.append(level)
    q = rng.normal(size=(100, 12)).astype(np.float32)
    got = ann.search(ann.lifted(x).astype(np.float32), levels, q, 10, 64)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got.tolist(), want.tolist())]) > 9
    assert [len(n) for n, _ in graph] == sorted((len(n) for n, _ in graph), reverse=True)
