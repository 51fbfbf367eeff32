"""Operator 3: decisions by bytes whatever the digits, dealing to smaller buckets, shared ids, long texts."""
import random

import numpy as np
import pytest

from tersely.llm import repeats

from .fixtures import DOCS, corpus, frame
from .test_repeats import brute


def by_id(df):
    return {r[0]: tuple(r) for r in df.collect()}


@pytest.mark.parametrize("mask", [0, 7])
def test_digits_that_meet_by_chance_change_nothing(spark, mask, monkeypatch):
    monkeypatch.setattr(repeats, "mix", lambda x: x & np.uint64(mask))
    rows = corpus(31, 60)
    assert by_id(repeats.remove_repeats(frame(spark, rows), records_a_bucket=500)) == brute(rows)


@pytest.mark.parametrize("partitions, crowd", [(2, 64), (3, 1)])
def test_more_buckets_than_partitions(spark, partitions, crowd):
    rows = corpus(32, 120)
    got = repeats.remove_repeats(frame(spark, rows), records_a_bucket=50, most_partitions=partitions, crowd=crowd)
    assert by_id(got) == brute(rows)


def test_other_thresholds(spark):
    rows = corpus(33, 80)
    for threshold in (24, 37, 55):
        assert by_id(repeats.remove_repeats(frame(spark, rows), threshold)) == brute(rows, threshold)


def test_many_rows_of_one_id(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(300))
    other = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(None, text, None, None, 0)] * 150 + [(None, other, None, None, 0)] * 5 + [(3, "x" + text[:100], None, None, 0), (9, other, None, None, 0), (9, text + other, None, None, 0)]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(7)).collect()), key=str)
    assert len(got) == len(rows)
    count = {}
    for r in got:
        count[r[:4]] = count.get(r[:4], 0) + 1
    # of id 9's two rows neither covers the other; nulls come after it and lose all that it or id 3 has
    assert count == {(3, 101, 0, 0): 1, (9, 300, 0, 0): 1, (9, 600, 100, 1): 1, (None, 300, 300, 1): 155}


def test_long_text_and_its_copy(spark):
    rng = np.random.default_rng(2)
    long = "".join(map(chr, rng.integers(97, 123, 1_500_000)))
    rows = [(1, long, None, None, 0), (2, "q" * 10 + long, None, None, 0), (3, "z" * 200_000, None, None, 0), (4, "z" * 70, None, None, 0)]
    got = by_id(repeats.remove_repeats(spark.createDataFrame(rows, DOCS)))
    assert [got[i][2:4] for i in (1, 2, 3, 4)] == [(0, 0), (1_500_000, 1), (0, 0), (70, 1)]
