"""The pipeline as a whole against plain Python, its clashing columns, long texts, and the files it leaves."""
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

import corpus_pipeline as P
from tersely.llm import components, mixing, packing, pii, simhash, toxicity

from .fixtures import DOCS, corpus, frame
from .test_toxicity import make


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def firsts(rows):
    """One of each group linked by a similarity of 0.8 or more."""
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if shared * 5 >= every * 4:
                label[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        best[root(i)] = min(best.get(root(i), r), r, key=lambda r: r[0])
    return sorted(r[0] for r in best.values())


def test_every_stage_by_hand(spark, tmp_path):
    docs_, labels = make(3, 240)
    rng = random.Random(2)
    rows = [(d, t, "en", rng.choice(["a", "b", "c", None]), len(t)) for d, t, *_ in docs_]
    rows += [(1000 + r[0], r[1] + " more words", "en", "a", 0) for r in rows[:40] if len(r[1].split()) > 30]
    rows += [(2000 + r[0], r[1], "en", "b", 0) for r in rows[50:60]] + [(3000, "Mr. Jan Ott wrote to a@b.org and +1 (212) 555-0100 today", "en", "c", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))
    got = P.run(spark, str(tmp_path)).collect()
    after = set(os.listdir(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")))
    assert not [f for f in after - before if f.startswith("pipeline-") and os.listdir(os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"), f))]

    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.fit(read, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    score = model.scorer()
    clean = [r for r in rows if score(r[1]) < 0.7]
    assert 0 < len(clean) < len(rows)
    ids = set(firsts(clean))
    kept = [r for r in clean if r[0] in ids]
    assert len(kept) < len(clean) - 20
    replaced = {r.doc_id: r.text for r in pii.replace_documents(spark.createDataFrame(kept, DOCS)).collect()}
    assert all(replaced[r[0]] == r[1] for r in kept if r[0] != 3000) and "a@b.org" not in replaced[3000]
    mixed = spark.createDataFrame([(r[0], replaced[r[0]], *r[2:4], len(replaced[r[0]])) for r in kept], DOCS)
    taken = {r.doc_id: r.taken for r in mixing.mix(mixed).collect()}
    plain, want = Tokenizer.from_file(public.path("byte_bpe_50k.json")), Counter()
    for d, n in taken.items():
        text, size = replaced[d], len(replaced[d].split())
        copies = [text] * (n // size) + ([re.match(r"(?:\s*\S+){%d}" % (n % size), text).group()] if n % size else [])
        for t in copies:
            ids_ = [*plain.encode(t, add_special_tokens=False).ids, 0]
            want.update((d, k, s, m, zlib.crc32(np.array(ids_[s : s + m], "<u4").tobytes())) for k, (s, m) in enumerate(packing.pieces_of(len(ids_), 2048)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_keep_columns_of_any_name_and_long_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["score", "predicted", "_tie", "_d", "_t", "_taken", "_new", "_m", "row", "id", "tie", "first", "label", "node", "component_id", "pii", "size", "items", "u", "v"]
    long = "long text here and there " * 80_000
    docs = spark.createDataFrame([(1, long, "en", "s", 0), (2, long + " end", "en", "s", 0), (3, "a b", None, "s", 0), (None, None, None, None, None)], DOCS)
    docs = docs.selectExpr("*", *[f"'{n}!' as `{n}`" for n in names])
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        assert docs.columns[5:] == names
        rows = docs.collect()
        assert all(r[n] == f"{n}!" for r in rows for n in names), name
        kept.append({r.doc_id for r in rows})
    assert kept[:3] == [{1, 2, 3, None}, {1, 3, None}, {1, 3, None}]


def test_large_components_are_salted(spark):
    nodes = spark.range(1, 400).selectExpr("id as k", "id * 2 as least")
    label = spark.range(2, 300).selectExpr("id as u", "1L as label")
    few = {tuple(r) for r in components.named(nodes, label, "k").select("k", "component_id").collect()}
    many = {tuple(r) for r in components.named(nodes, label, "k", broadcast_rows=0).select("k", "component_id").collect()}
    assert few == many == {(k, 2 if k < 300 else 2 * k) for k in range(1, 400)}


def test_one_of_each_on_ties_and_null_ids(spark):
    rows = [(None, "x y z", None, None, 0), (4, "x y z", None, None, 0), (4, "x y z", None, None, 0), (None, "other text that stays", None, None, 0)]
    got = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(4, "x y z")] and len(got) == 2
    assert simhash.one_of_each(frame(spark, corpus(3)).limit(0)).count() == 0


def test_rows_of_one_key_are_spread(spark):
    from tersely.llm import common

    rows = common.cut(spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 7L else id end as k"))
    one = common.cut(rows.groupBy("k").count().selectExpr("k", "count as n", "k * 10 as value"))
    got = {(r.id, r.value) for r in common.meet(rows, one, "k", 1000, least=20).collect()}
    assert got == {(i, 70 if i % 3 == 0 else i * 10) for i in range(1000)}
