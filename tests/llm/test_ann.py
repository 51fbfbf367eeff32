import numpy as np

from tersely.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, every=20, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    x = np.array([v for _, v in good])
    ids = np.array([i for i, _ in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).selectExpr("*", "1 as shard", "'a' as vector")
    out = {}
    for r in sorted(ann.nearest(df, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 24))) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, want = run(spark, rows, shard_rows=400, beam=64), exact(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got[q] if i in scores)


def test_ties_copies_and_bad_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.5, 0.5, 0.0]
    rows = [(i, a) for i in range(0, 60)] + [(i, b) for i in range(60, 70)]
    rows += [(100, None), (120, [0.0, 0.0, 0.0]), (140, [float("nan"), 1.0, 1.0]), (160, [None, 1.0, 1.0]), (180, []), (200, [float("inf"), 0.0, 0.0])]
    assert run(spark, rows) == exact(rows)
    got = run(spark, [(20, [1.0, 2.0]), (3, [1.0, 1.0]), (40, [-0.0, 1.0])])
    assert got == exact([(20, [1.0, 2.0]), (3, [1.0, 1.0]), (40, [0.0, 1.0])])


def test_one_and_none(spark):
    assert run(spark, [(20, [1.0, 0.0])]) == {}
    assert run(spark, []) == {}


def test_graph_links_run_both_ways_and_levels_shrink():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8)).astype(np.float32)
    levels, graph = ann.build(np.arange(800), x, 16)
    assert [len(nodes) for nodes, _ in graph] == [int((levels >= l).sum()) for l in range(len(graph))]
    table = graph[0][1]
    assert table.shape == (800, 16) and (table[:, 0] >= 0).all()
    links = {(i, int(j)) for i, row in enumerate(table) for j in row if j >= 0}
    assert sum((j, i) in links for i, j in links) > 0.6 * len(links)


def test_recall_beside_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1e4
    x[8] *= 1e9
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, want = run(spark, rows), exact(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_every_node_can_be_reached():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 1e-3 * rng.normal(size=(60, 6)) for c in 10 * rng.normal(size=(20, 6))]).astype(np.float32)
    _, graph = ann.build(np.arange(len(x)), x, 8)
    seen = np.zeros(len(x), bool)
    ann.reached(graph[0][1], np.array([0]), seen)
    assert seen.all() and graph[0][1].shape[1] <= 9
