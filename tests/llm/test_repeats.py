import hashlib

import numpy as np
import pytest

from tersely.llm import repeats

from .fixtures import DOCS, corpus, frame


def brute(rows, threshold=50):
    first = {}
    for d, t in sorted((r[0], (r[1] or "").encode()) for r in rows):
        for i in range(len(t) - threshold + 1):
            first.setdefault(t[i : i + threshold], d)
    out = {}
    for d, t in ((r[0], (r[1] or "").encode()) for r in rows):
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - threshold + 1):
            if first[t[i : i + threshold]] < d:
                mask[i : i + threshold] = True
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        out[d] = (d, len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed, crowd, segment", [(1, 64, 1 << 20), (2, 1, 1 << 20), (3, 2, 700)])
def test_against_brute_force(spark, seed, crowd, segment, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    rows = corpus(seed, 160)
    got = {r[0]: tuple(r) for r in repeats.remove_repeats(frame(spark, rows), crowd=crowd, records_a_bucket=500).collect()}
    assert got == brute(rows)
    assert sum(r[2] for r in got.values()) > 1000


def test_same_id_and_null_id(spark):
    long_text = "".join(chr(97 + i * i % 26) for i in range(200))
    rows = [(5, long_text, None, None, 0), (5, long_text, None, None, 0), (5, "y" + long_text, None, None, 0), (None, long_text, None, None, 0), (7, "z" + long_text[:60], None, None, 0)]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    removed = sorted((str(r[0]), r[1], r[2]) for r in got)
    assert removed == sorted([("5", 200, 0), ("5", 200, 0), ("5", 201, 0), ("None", 200, 200), ("7", 61, 60)])


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_segments_cover_every_window_once():
    starts, ends = np.array([0, 100, 130]), np.array([100, 130, 400])
    seen = []
    for group in repeats.segments(starts, ends, 50, 64):
        seen += [(i, w) for i, a, b in group for w in range(a, b - 49)]
    assert sorted(seen) == [(0, w) for w in range(51)] + [(2, w) for w in range(130, 351)]
