"""Operators 1, 6, 7 and 10 on small fixtures; 1 and 10 have DuckDB SQL besides."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tersely.llm import chat, fingerprints, mixing, sharding

from .fixtures import DOCS, corpus, frame


def test_sharding(spark):
    rows = corpus(8)
    got = sharding.shard_documents(frame(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    slots = defaultdict(list)
    for r in got:
        body = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(got) == len(rows)


def test_jump_moves_the_necessary_share(spark):
    keys = spark.range(20000)
    a, b = (keys.select("id", sharding.jump_shard(F.col("id"), n).alias(f"s{n}")) for n in (10, 11))
    r = a.join(b, "id").agg(F.count(F.when(F.col("s10") != F.col("s11"), 1)), F.max(F.when(F.col("s10") != F.col("s11"), F.col("s11"))), F.min(F.when(F.col("s10") != F.col("s11"), F.col("s11")))).first()
    assert 1500 < r[0] < 2150 and r[1] == r[2] == 10
    counts = Counter(x[1] for x in a.collect())
    assert max(counts.values()) < 1.15 * 2000 and min(counts.values()) > 0.85 * 2000


def test_sharding_with_null_and_equal_ids(spark):
    rows = [(None, "a", None, None, 0), (None, None, None, None, 0), (4, "a", None, None, 0), (4, "a", None, None, 0)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_mixing(spark):
    rows = corpus(9, 200)
    got = mixing.mix(frame(spark, rows)).collect()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by_source = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        s = by_source[r.source]
        s[0] += r["size"]
        s[1] += r.taken
        s[2] = r.target
    total = sum(size.values())
    weights = dict(zip(["s1", "s2", "s3", None], [5, 2, 1, 5]))
    left, free, target = total * 1.5, set(weights), {}
    while True:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 2 * by_source[s][0]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * by_source[s][0]
            left -= target[s]
        free -= full
    target |= {s: weights[s] * level for s in free}
    for s, (words, taken, t) in by_source.items():
        assert abs(t - target[s]) < 1e-6 * total
        assert abs(taken - t) <= 0.02 * t + 16 * 8
    again = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows).repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_sainte_lague_against_quotients(spark):
    votes = [("a", 53000), ("b", 24000), ("c", 23000), ("d", 11), ("e", 0)]
    for seats in (0, 1, 7, 100, 1234):
        df = spark.createDataFrame([("g", p, v, seats) for p, v in votes], "g string, p string, v long, n long")
        got = {r.p: r.quota for r in mixing.sainte_lague(df, ["g"], "p", "v", "n").collect()}
        won = Counter()
        for _ in range(seats):
            won[max((p for p, v in votes if v), key=lambda p: (dict(votes)[p] / (2 * won[p] + 1), [-ord(p)]))] += 1
        assert got == {p: won[p] for p, _ in votes}


def test_mixing_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, None, 0), (2, "  ", None, "s", 0)]
    assert [r.taken for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()] == [0, 0]


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n\nc  d ", n) for n in (0, 1, 2, 3, 4, 9)], "t string, n int")
    got = [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    assert got[1:] == ["  a", "  a b", "  a b\n\nc", "  a b\n\nc  d", "  a b\n\nc  d"] and got[0].strip() == ""


def test_fingerprints(spark):
    rows = corpus(10, 90)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    prints = {}
    for i, (d, t) in enumerate(ordered):
        then = ordered[(i + 1) % len(ordered)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + then[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        else:
            assert r.fingerprint.split(":")[0] != r.edited_fingerprint.split(":")[0]
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len({p.split(":")[0] for p in prints.values()}) == len(prints)
    assert len(got) == len(rows)


def test_next_across_buckets_and_ties(spark):
    rows = [(i * 7, f"t{i}", None, None, 0) for i in range(50)] + [(0, "t0", None, None, 0), (None, "n", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").alias("v"), F.xxhash64("text").alias("_tie"))
    real = fingerprints.ordered_buckets
    try:
        fingerprints.ordered_buckets = lambda d: real(d, rows_a_bucket=3, most_quantiles=4)
        got = {(r.doc_id, r.v): r.then for r in fingerprints.with_next(docs, "v", "then").collect()}
    finally:
        fingerprints.ordered_buckets = real
    assert got[(None, "n")] == "t0" and got[(49 * 7, "t49")] == "n"
    assert all(got[(i * 7, f"t{i}")] == f"t{i + 1}" for i in range(1, 49))
    one = spark.createDataFrame([(1, "only", None, None, 0)], DOCS)
    r = fingerprints.fingerprint_documents(one).first()
    assert r.near_next == 1.0
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_edits_locate_the_paragraph(spark):
    old = spark.createDataFrame([(1, "a.\nb.\nc.\n\nd."), (2, "same")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a.\nX.\nc.\n\nd."), (2, "same")], "doc_id long, text string")
    assert [(r.doc_id, r.section, r.paragraph) for r in fingerprints.edits(old, new).collect()] == [(1, 0, 1)]


def test_perspectives(spark):
    turns = [(1, 0, "ann", "hi <|im_start|>"), (1, 1, "bob", None), (1, 2, "cy", "x"), (1, 3, None, "who"), (1, None, "ann", "first"), (1, 64, "bob", "late"), (None, 0, "ann", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as block", "'s' as speaker")
    got = chat.perspectives(df).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "ann")}
    for r in got:
        said = [r.rendered[a:b] for a, b in zip(r.mask_from, r.mask_to)]
        own = sorted(((t[1] if t[1] is not None else -1), t[3] or "") for t in turns if t[0] == r.conv_id and t[2] == r.speaker and (-1 if t[1] is None else t[1] // 64) == r.block)
        assert said == [x.replace("<|", "<⁠|") + "<|im_end|>" for _, x in own]
        assert r.rendered.count("<|im_start|>") == r.n_turns == r.rendered.count("<|im_end|>\n")
    assert chat.perspectives(df.limit(0)).count() == 0
