"""Links by the nearest of other components, against plain Python on many texts that share a few shingles."""

import random

import numpy as np

from tersely.llm import similar


def test_crowded_groups_are_whole(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(0, 2)):
            words[at] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    sets = [set(similar.shingles(t).tolist()) for t in texts]
    least = list(range(40))
    for _ in range(40):
        for i in range(40):
            for j in range(40):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs, few=4).collect()}
    assert got == dict(enumerate(least))


def test_order_knows_a_fixed_share_of_texts(spark):
    texts = [f"a{i} b{i} c{i} one two three four five" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s, many = similar.common_shingles(docs)
    assert s.tolist() == similar.shingles("one two three four five").tolist()
    assert 20 <= many[0] <= 100 and similar.common_shingles(docs, most=0)[0].size == 0
    assert isinstance(many, np.ndarray) and similar.common_shingles(docs.limit(0))[0].size == 0
