"""Operator 5's fit and scores against plain numpy and Python, its bound, clashing columns and long texts."""
import math

import numpy as np

import corpus_pipeline as P
from tersely.llm import toxicity

from .fixtures import DOCS
from .test_toxicity import make

LABELS = "doc_id long, quality int, toxic int"


def test_bound_holds_for_repeated_ids_and_texts(spark):
    rows = [(i % 4, f"text {i % 7}", None, None, 0) for i in range(3000)] + [(None, "x", None, None, 0)]
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(4)] + [(99, 1, 1)], LABELS)
    docs = spark.createDataFrame(rows, DOCS)
    assert toxicity.training_rows(docs, lab, 2).count() <= 2
    every = toxicity.training_rows(docs, lab, 100).collect()
    assert len({r.text for r in every}) == len(every) <= 4


def test_one_column_for_equal_voters_changes_no_weight(spark):
    rows, labels = make(7, 400)
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, lab)
    known = toxicity.training_rows(docs, lab, 12_000).collect()
    texts, y = [r.text for r in known], np.array([r.label for r in known])
    fired = [{s for w in toxicity.words_in(t) for s in toxicity.signs(w)} for t in texts]
    x = np.array([[v in f for v in model.voters] + toxicity.forms(t) for f, t in zip(fired, texts)], np.float64)
    assert len({tuple(c) for c in x.T}) < x.shape[1]
    seeds = len(dict.fromkeys(toxicity.SEEDS))
    post, _ = toxicity.label_model(x, y)
    weights, bias = toxicity.logistic(x, post, toxicity.centres(x, post, seeds))
    weights = np.where(x.sum(axis=0) > 0, weights, [2.0 if i < seeds else 0.0 for i in range(x.shape[1])])
    assert np.allclose(weights, model.weights, atol=1e-4) and abs(bias - model.bias) < 1e-4


def test_scores_against_plain_python(spark):
    rows, labels = make(8, 300)
    docs, lab = spark.createDataFrame(rows + [(9001, None, None, None, None)], DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, lab)
    for r in toxicity.score_only(docs, model).collect():
        text = dict((d, t) for d, t, *_ in rows).get(r.doc_id) or ""
        words = {w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()}
        own = {w[:n] for w in words for n in range(3, min(9, len(w)) + 1)} | {w + "$" for w in words}
        z = model.bias + sum(w for v, w in zip(model.voters, model.weights) if v in own)
        z += sum(w for f, w in zip(toxicity.forms(text), model.weights[len(model.voters) :]) if f)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_candidates_are_those_of_the_rule(spark):
    rows, labels = make(9, 300)
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    known = toxicity.training_rows(docs, lab, 12_000)
    got = toxicity.candidates(known.repartition(3))
    data = [({s for w in toxicity.words_in(r.text) for s in toxicity.signs(w)}, r.label) for r in known.collect()]
    n, t, where = {}, {}, {}
    for i, (own, y) in enumerate(data):
        for s in own:
            n[s], t[s] = n.get(s, 0) + 1, t.get(s, 0) + int(y)
            where.setdefault(s, []).append(i)
    p = sum(y for _, y in data) / len(data)
    least = 0.5 * math.log(sum(c >= 3 for c in n.values()) + 2)

    def evidence(s):
        share = min(t[s] / n[s], 1 - 1e-9)
        return n[s] * (share * math.log(share / p) + (1 - share) * math.log((1 - share) / (1 - p))) if share else 0

    assert {s for s, _ in got} == {s for s in n if n[s] >= 3 and t[s] >= n[s] * max(0.5, p) and evidence(s) > least}
    groups = {}
    for s, g in got:
        assert groups.setdefault(g, where[s]) == where[s]
    assert len({tuple(w) for w in groups.values()}) == len(groups)


def test_stage_keeps_columns_named_like_results(spark, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    long = "plain words " * 200_000
    docs = spark.createDataFrame([(1, "fine", None, None, 0), (2, "you idiot moron", None, None, 0), (3, None, None, None, None), (4, long, None, None, 0)], DOCS)
    docs = docs.selectExpr("*", "0.123 as Score", "'p' as predicted", "'x' as predicted_", "1 as `label`")
    kept = P.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {1, 3, 4} and got[4].text == long
    assert all((float(r.Score), r.predicted, r.predicted_, r.label) == (0.123, "p", "x", 1) for r in got.values())
