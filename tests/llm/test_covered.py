"""The stage's texts meet by op4's anchor covering first, what it leaves apart exactly, and no pair is a row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tersely.llm import similar, simhash


def near_copies(many, words=60, changes=3, seed=1):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return [" ".join(f"x{rng.randrange(99)}" if i in at else w for i, w in enumerate(base)) for at in (rng.sample(range(words), rng.randint(0, changes)) for _ in range(many))]


def brute(sets):
    least = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if g == b else g for g in least]
    return least


def partition(label):
    return sorted(sorted(np.flatnonzero(np.array(label) == g).tolist()) for g in set(label))


def test_fingerprints_are_those_of_five_words():
    text = " ".join(f"w{i}" for i in range(500))
    assert similar.fingerprint(similar.shingles(text)) == simhash.simhash(text, shingle=5)
    assert similar.fingerprint(similar.shingles(None)) == 0


def test_clusters_are_the_covering_s(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([4, 5, 5]))) for f in fps[:20]]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {r.fp: r.cluster for r in similar.covered(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    least = list(range(50))
    for i in range(50):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 5:
                least = [least[j] if g == least[i] else g for g in least]
    assert partition([got[f] for f in signed]) == partition(least)


def test_parity_bits_of_any_width_rule_no_similar_pair_out():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(-(2**63), 2**63 - 1, 560))
    near = [np.unique(np.r_[x[k:], rng.integers(-(2**63), 2**63 - 1, k // 9)]) for k in (0, 50, 60, 100)]
    far = [np.unique(np.r_[x[:20], rng.integers(-(2**63), 2**63 - 1, 520)]) for _ in range(4)]
    sets = sorted(near + far, key=len)
    n = np.array([len(s) for s in sets])
    bits = [similar.parity(s, similar.parity_words(len(s))) for s in sets]
    assert {len(b) for b in bits} == {4, 8}
    u, v = similar.joined(n, np.arange(8), bits)
    label = {i: i for i in range(8)} | dict(zip(u.tolist(), v.tolist()))
    own = brute([set(s.tolist()) for s in sets])
    for i in range(8):
        for j in range(8):
            assert own[i] != own[j] or label[i] == label[j]
    assert sum(np.bincount([label[i] for i in range(8)]) == 1) >= 4  # those that share a few shingles only


@pytest.mark.parametrize("parts", [1, 3])
def test_cells_against_brute_force(parts):
    sets = [similar.shingles(t) for t in near_copies(60)]
    part = np.arange(60) % parts
    label = np.arange(60)
    for i in range(parts):
        for j in range(i, parts):
            at = np.flatnonzero((part == i) | (part == j))
            for u, v in zip(*similar.similar_in(at, part[at], [sets[k] for k in at])):
                label[label == label[u]] = label[v]
    own = brute([set(s.tolist()) for s in sets])
    assert partition(label.tolist()) == partition(own) and 1 < len(set(own)) < 60


def test_links_are_fewer_than_nodes(spark):
    docs = spark.createDataFrame(list(enumerate(near_copies(400))), "doc_id long, text string").withColumn("tie", F.lit(0).cast("long"))
    firsts = similar.cut(similar.first_shingles(docs, *similar.common_shingles(docs)))
    found = similar.links(firsts, docs).collect()
    assert 0 < len(found) < firsts.select("node").distinct().count()


def test_components_of_few_and_of_many_links(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (-7, 2), (2, 8), (8, -7)], "u long, v long")
    for few in (0, 100):
        label = {r.u: r.label for r in similar.connected(edges, few).collect()}
        assert partition([label.get(i, i) for i in (5, 3, 9, -7, 2, 8)]) == [[0, 1, 2], [3, 4, 5]]


def test_one_of_each_of_repeated_rows(spark):
    texts = near_copies(80)
    own = brute([set(similar.shingles(t).tolist()) for t in texts])
    rows = [(None if i % 7 == 0 else i, t) for i, t in enumerate(texts)] * 2
    kept = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), few=9).collect()
    groups = [[i for i in range(80) if own[i] == g] for g in sorted(set(own))]
    assert len(kept) == len(groups)
    place = {t: own[i] for i, t in enumerate(texts)}
    for r in kept:
        ids = [i for i in range(80) if own[i] == place[r.text] and i % 7]
        assert r.doc_id == (min(ids) if ids else None)
