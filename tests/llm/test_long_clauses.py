"""Operator 7 on long clauses, many rows of one id and long texts; operator 1 on repeated turn numbers."""
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tersely.llm import chat, fingerprints

from .fixtures import DOCS, corpus


def pieces(units, last):
    out, held = [], ""
    for i, u in enumerate(units):
        held += u
        if last(i):
            out.append(held)
            held = ""
    return out + [held] * bool(held) or [""]


def by_hand(text):
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaves(clause):
        if len(clause) <= 512:
            return [clause]
        words = []
        for w in re.split(r"(?<=[\x20\x09-\x0D])", clause):
            words += pieces(w, lambda i: zlib.crc32(w[max(0, i - 3) : max(0, i - 3) + 4].encode()) % 64 == 0) if len(w) > 512 else [w]
        return pieces(words, lambda i: zlib.crc32(words[i].encode()) % 20 == 3)

    tree = [[[hashlib.md5(x.encode()).hexdigest() for c in re.split(r"(?<=[.!?,;:|])", p) for x in leaves(c)]
             for p in re.split(r"(?<=\n)", s)] for s in re.split(r"(?<=\n)(?=[ \t]*\n|#)", text)]
    root = sha([sha([sha(p) for p in s]) for s in tree])
    return f"{root}:" + "/".join(".".join("".join(d[:8] for d in p) for p in s) for s in tree), {d[:8] for s in tree for p in s for d in p}


def plain_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (50, 250, 900, 300, 260)]
    texts += ["".join(rng.choice("日本語あいうえお") for _ in range(n)) for n in (600, 1500)]
    return texts + ["x" * 700 + " " + texts[2] + ". short, " + texts[1] + "\n\n" + texts[3], "", "one"]


def test_long_clauses_by_hand(spark):
    texts = plain_texts()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    for i, t in enumerate(texts):
        then = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + then[: len(t) // 4]
        (own, a), (new, b), (_, c) = map(by_hand, (t, edited, then))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, new)
        assert abs(got[i].near_edited - 2 * len(a & b) / (len(a) + len(b))) < 1e-12
        assert abs(got[i].near_next - 2 * len(a & c) / (len(a) + len(c))) < 1e-12
    # three quarters are shared, so a good part of the leaves is, with or without spaces
    assert all(got[i].near_edited > 0.4 for i, t in enumerate(texts) if len(t) > 1000)


def test_many_rows_of_one_id_follow_one_another(spark):
    rows = [(None, f"n{i}", None, None, 0) for i in range(40)] + [(5, f"f{i}", None, None, 0) for i in range(60)] + [(i, f"t{i}", None, None, 0) for i in range(6, 40)] + [(5, "same", None, None, 0)] * 9
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").alias("v"), F.xxhash64("text").alias("_tie")).repartition(3)
    real = fingerprints.ordered_buckets
    try:
        fingerprints.ordered_buckets = lambda d: real(d, rows_a_bucket=4, most_quantiles=8)
        got = [tuple(r) for r in fingerprints.with_next(docs, "v", "then").select("doc_id", "_tie", "v", "then").collect()]
        assert real(docs, 4, 8).where("doc_id = 5").select("_bucket").distinct().count() > 3
    finally:
        fingerprints.ordered_buckets = real
    order = sorted(docs.select("doc_id", "_tie", "v").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r._tie))
    want = [(*r, order[(i + 1) % len(order)].v) for i, r in enumerate(order)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_texts_move_once(spark, sf_dir):
    plan = fingerprints.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("md5") == 2 and "PythonUDF" not in plan and "MapInArrow" not in plan


def test_fingerprint_of_a_long_text(spark):
    long = "word number " * 100_000 + "y" * 100_000
    docs = spark.createDataFrame([(1, long, None, None, 0), (2, None, None, None, 0)], DOCS).selectExpr("*", "1 as _tie", "2 as _bucket", "3 as _end", "4 as _me")
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert got[1].n_chars == len(long) and got[2].n_chars == 0
    assert got[1].edited_sha256 == hashlib.sha256(long[: len(long) - len(long) // 4].encode()).hexdigest()


def test_repeated_turn_numbers_are_cut_into_parts(spark):
    rng = random.Random(6)
    turns = [(1, None if i % 3 else 7, rng.choice("ab"), f"text {i % 500}") for i in range(1500)] + [(2, i, "ab"[i % 2], f"t{i}") for i in range(130)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for most in (1 << 16, 128):
        got = chat.perspectives(df, most_rows=most).collect()
        assert max(r.n_turns for r in got) <= 64
        assert len({(r.conv_id, r.speaker, r.block) for r in got}) == len(got)
        for speaker in "ab":
            said = sorted(r.rendered[a:b] for r in got if r.conv_id == 1 and r.speaker == speaker for a, b in zip(r.mask_from, r.mask_to))
            assert said == sorted(t[3] + "<|im_end|>" for t in turns if t[0] == 1 and t[2] == speaker)
        assert sorted((r.block, r.n_turns) for r in got if r.conv_id == 2 and r.speaker == "a") == [(0, 64), (1, 64), (2, 2)]


def test_chat_of_a_long_turn_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "a", "x" * 2_000_000), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as block", "2 as salt", "3 as part", "4 as _c", "5 as speaker")
    assert {(r.speaker, len(r.rendered) > 2_000_000) for r in chat.perspectives(df).collect()} == {("a", True), ("b", True)}


def test_fixture_texts_keep_their_fingerprints(spark):
    from .test_by_hand import print_by_hand

    assert all(by_hand(t) == print_by_hand(t) for t in [r[1] or "" for r in corpus(22, 80)] if max(map(len, re.split("[.!?,;:|]", t))) <= 512)
