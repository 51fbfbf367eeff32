import re
from collections import Counter

import corpus_pipeline as P

from .fixtures import DOCS, corpus, frame


def test_stages_in_order_on_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
        assert docs.columns == columns
        seen[name] = docs.collect()
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert 0 < len(seen["near_duplicates"]) < len(seen["toxicity"]) < 200
    assert {r.doc_id for r in seen["personal_data"]} == {r.doc_id for r in seen["near_duplicates"]}
    packed = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    copies = Counter(r.doc_id for r in seen["mixing"])
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert P.run(spark, sf_dir).count() == len(packed)


def test_one_of_each_group_stays(spark):
    from tersely.llm import simhash

    rows = corpus(11)
    rows += rows[:3]
    df = frame(spark, rows, extra=False)
    groups = {}
    for r in simhash.near_duplicates(df).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    kept = [r.doc_id for r in P.drop_near_duplicates(spark, df, "").collect()]
    assert sorted(kept) == sorted(groups)


def test_mixing_takes_the_words_it_says(spark):
    from tersely.llm import mixing

    rows = corpus(12, 150)
    df = frame(spark, rows, extra=False)
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    words = Counter()
    text = {r[0]: r[1] for r in rows}
    for r in P.mix_sources(spark, df, "").collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        words[r.doc_id] += n
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert words == Counter({d: n for d, n in taken.items() if n})


def test_stages_on_nulls_and_nothing(spark, sf_dir):
    rows = [(None, None, None, None, None), (None, "a b c d e", None, None, 9), (1, None, "en", "s", None), (1, "", "en", "s", 0), (2, "x y z " * 50, None, "s", 0), (2, "x y z " * 50, None, "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, DOCS)
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir).checkpoint()
            assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
        packed = P.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert len(packed) == docs.count()
        if data:
            assert {r.doc_id for r in packed} == {2, None}
