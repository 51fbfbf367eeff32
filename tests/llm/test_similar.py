import re

import pytest

import corpus_pipeline as P
from tersely.llm import similar

from .fixtures import DOCS, corpus, frame


def slow_sets(rows):
    out = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        out[r[0]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def slow_groups(rows):
    sets = slow_sets(rows)
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if g == old else g for d, g in label.items()}
    return label


@pytest.mark.parametrize("few", [64, 2])
def test_against_brute_force(spark, few):
    rows = corpus(11)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(frame(spark, rows), few=few).collect()}
    assert got == slow_groups(rows)


def test_the_stage_takes_all_that_is_similar(spark):
    stage = dict(P.STAGES)["near_duplicates"]
    rows = corpus(11)
    kept = [r.doc_id for r in stage(spark, frame(spark, rows + rows[:3], extra=False), "").collect()]
    assert sorted(kept) == sorted(set(slow_groups(rows).values()))


def test_nothing(spark):
    assert similar.one_of_each(spark.createDataFrame([], DOCS)).count() == 0
