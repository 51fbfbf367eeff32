import random
import re

import numpy as np
import pytest
import xxhash

from tersely.llm import simhash
from tersely.llm.components import components

from .fixtures import DOCS, corpus, frame


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, threshold=4):
    label = {d: d for d in fps}
    def root(d):
        while label[d] != d:
            d = label[d]
        return d
    ids = list(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= threshold:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("blocks", [3, 2])
def test_against_brute_force(spark, blocks):
    rows = corpus(4)
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(frame(spark, rows), blocks=blocks).collect()}
    fps = {r[0]: slow_print(r[1]) for r in rows}
    want = slow_components(fps)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert len(set(want.values())) < len(want) - 10


@pytest.mark.parametrize("blocks, most_homes", [(3, 8192), (2, 8192), (3, 4)])
def test_links_connect_what_brute_force_connects(spark, blocks, most_homes):
    rng = random.Random(7)
    values = [rng.getrandbits(64) for _ in range(150)]
    for v in values[:60]:
        x = v
        for _ in range(4):
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
            values.append(x)
    values = sorted(set(values))
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), blocks=blocks, most_homes=most_homes)
    labels = {r[0] % 2**64: r[1] % 2**64 for r in components(edges).collect()}
    want = slow_components(dict(zip(values, values)))
    groups = {}
    for v, w in want.items():
        groups.setdefault(w, set()).add(labels.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_anchors_cover():
    rng = np.random.default_rng(1)
    for blocks in (2, 3):
        for b in simhash.design(4, blocks):
            x = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
            bits = rng.choice(b.width, 4 // blocks, replace=False)
            y = x ^ np.uint64(sum(1 << (b.shift + int(i)) for i in bits))
            home = b.homes(x)
            got = {}
            for keys, fps in b.anchors(y):
                for k, f in zip(keys.tolist(), fps.tolist()):
                    got.setdefault(f, set()).add(k)
            assert all(h in got[f] for h, f in zip(home.tolist(), y.tolist()))


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (-5, 1001)], "u long, v long")
    got = {r[0]: r[1] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1000: -5, 1001: -5}


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e", None, None, 0), (9, "a b c d e", None, None, 0), (9, "a b c d e", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0)]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert sorted((str(r[0]), r[2]) for r in got) == [("3", 3), ("4", 3), ("9", 9), ("9", 9), ("None", 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
