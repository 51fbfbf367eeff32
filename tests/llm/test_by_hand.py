"""Operators 6 and 7 against plain Python that computes the same hashes."""
import hashlib
import re

import xxhash

from tersely.llm import fingerprints, sharding

from .fixtures import corpus, frame


def eight(n):
    return n.to_bytes(8, "little", signed=True)


def shard_by_hand(key, shards):
    at, then = -1, 0
    while then < shards:
        at = then
        draw = xxhash.xxh64_intdigest(eight(at), xxhash.xxh64_intdigest(eight(key), 42)) >> 33
        then = int((at + 1) * (2.0**31 / (draw + 1)))
    return at


def test_shards(spark):
    rows = corpus(21, 400)
    for r in sharding.shard_documents(frame(spark, rows)).collect():
        assert (r.shard, r.grown_shard) == (shard_by_hand(r.doc_id, 16), shard_by_hand(r.doc_id, 17))


def print_by_hand(text):
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    tree = [[[hashlib.md5(leaf.encode()).hexdigest() for leaf in re.split(r"(?<=[.!?,;:|])", p)]
             for p in re.split(r"(?<=\n)", s)] for s in re.split(r"(?<=\n)(?=[ \t]*\n|#)", text)]
    root = sha([sha([sha(p) for p in s]) for s in tree])
    return f"{root}:" + "/".join(".".join("".join(d[:8] for d in p) for p in s) for s in tree), {d[:8] for s in tree for p in s for d in p}


def test_fingerprints(spark):
    rows = corpus(22, 80) + [(9001, "# a\n\nb. c\n \n## d", "", "", 0), (9002, "one,two|three", "", "", 0)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, rows)).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    for i, (d, t) in enumerate(ordered):
        then = ordered[(i + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 4] + then[: len(t) // 4]
        (own, a), (new, b), (_, c) = map(print_by_hand, (t, edited, then))
        r = got[d]
        assert (r.fingerprint, r.edited_fingerprint) == (own, new)
        assert abs(r.near_edited - 2 * len(a & b) / (len(a) + len(b))) < 1e-12
        assert abs(r.near_next - 2 * len(a & c) / (len(a) + len(c))) < 1e-12
