import random
import zlib

import numpy as np

from tersely.llm import toxicity

from .fixtures import DOCS


def make(seed=1, n=900):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiourstnlm") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["IDIOT!", "zorgly" + rng.choice(words), "moron", "blekta" + rng.choice(words)]))
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = make()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score_only(docs.selectExpr("*", "1 as score", "2 as predicted"), model).collect()}
    truth = {d: t for d, _, t in labels}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 3 == 1]
    assert held == [d for d in got if got[d].held_out] and len(held) > 200
    hit = [got[d].predicted == truth[d] for d in held]
    assert np.mean(hit) > 0.97
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())


def test_no_input_but_the_text(spark):
    rows, labels = make(2, 300)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, lab)
    other = [(10_000 + d, t, "xx", None, 5) for d, t, *_ in rows]
    a = {r.doc_id: r.score for r in toxicity.score_only(docs, model).collect()}
    b = {r.doc_id - 10_000: r.score for r in toxicity.score_only(spark.createDataFrame(other, DOCS), model).collect()}
    assert a == b
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    again = toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert again.voters == model.voters and np.allclose(again.weights, model.weights)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (3, "you idiot moron", None, None, 0), (None, "x", None, None, 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_only(docs, toxicity.fit(docs, none)).collect()}
    assert got[1].score == got[2].score < 0.7 and got[3].predicted == 1
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score_only(docs, toxicity.fit(docs, odd)).count() == 4
    assert toxicity.score_only(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.3).astype(float)
    good = np.where(y > 0, rng.random(2000) < 0.8, rng.random(2000) < 0.02)
    noise = rng.random(2000) < 0.3
    x = np.stack([good] + [noise] * 6, axis=1).astype(np.float32)
    post, share = toxicity.label_model(x, y)
    assert share[0] > 0.7 and (share[1:] < 0.3).all()
    assert ((post > 0.5) == (y > 0.5)).mean() > 0.95
    w, b = toxicity.logistic(x, post)
    assert w[0] > 2 and abs(w[1:].sum()) < 1
