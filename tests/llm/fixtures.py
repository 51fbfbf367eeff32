"""Small corpora with the cases every operator must handle."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Random word texts with exact and near copies, shared passages, nulls, empties, ties and a long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ü"[:7].replace(" ", "")) for _ in range(rng.randint(1, 7))) for _ in range(150)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for i in range(n):
        t = " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 90)))
        kind = i % 6
        if kind == 1 and texts:
            t = rng.choice(texts)
        elif kind == 2 and texts:
            base = rng.choice(texts).split(" ")
            base[rng.randrange(len(base))] = rng.choice(words)
            t = " ".join(base)
        elif kind == 3:
            t = t + "\n" + passage + "\n" + rng.choice(words)
        elif kind == 4:
            t = t.upper().replace(" ", rng.choice([" ", "  ", "\n", "\t"]))
        texts.append(t)
    texts += [None, "", "   ", "x", "x", "a" * 3000, "word " * 500, passage, "日本語のテキスト " * 8, "  odd\u0085spaces"]
    rows = [(i * 3, t, "en", rng.choice(["s1", "s2", "s3", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as size", "1 as score", "2 as shard", "3 as fp", "'k' as key", "0 as _sub") if extra else df
