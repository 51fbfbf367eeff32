"""Operator 2's ids as the plain call gives them, its plan against best-two-fit piece by piece, and its groups."""
import random
import zlib

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tersely.llm import packing

from .fixtures import DOCS, corpus, frame


def test_ids_are_those_of_the_file_as_loaded(spark):
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "é <|endoftext|>日", "<|endoftext", "no name", None, "<|endoftext|>" * 3000]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = {}
    for r in packing.tokenize(spark.createDataFrame(rows, DOCS)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.pieces_of(len(ids), 2048))]
        assert sorted(got[i]) == want
    assert plain.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def one_bin(left, capacity):
    bin_, room = [], capacity
    while fits := [n for n in left if n <= room]:
        n = max(fits)
        left.remove(n)
        bin_.append(n)
        room -= n
    while room and bin_:
        small = min(bin_)
        pairs = [(a + b, -max(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room + small]
        if not pairs or max(pairs)[0] <= small:
            break
        total, big = max(pairs)
        bin_.remove(small)
        left.append(small)
        for n in (-big, total + big):
            left.remove(n)
            bin_.append(n)
        room += small - total
    return sorted(bin_, reverse=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=40))
def test_plan_is_best_two_fit_piece_by_piece(lengths):
    left, want = list(lengths), []
    while left:
        want.append(one_bin(left, 24))
    got = [b for times, b in packing.plan(np.bincount(lengths, minlength=25), 24) for _ in range(times)]
    assert got == want


def test_patterns_do_not_grow_with_the_pieces():
    rng = random.Random(3)
    few = np.bincount([rng.randint(1, 2048) for _ in range(3000)], minlength=2049)
    assert len(packing.plan(few * 1_000_000_007, 2048)) < 4 * 2048


def test_small_groups_give_the_same_kind_of_plan(spark):
    rows = corpus(15) + [(7, "same " * 30, None, None, 0)] * 40
    pieces = packing.cut(packing.tokenize(frame(spark, rows).repartition(4)))
    for group in (1, 1 << 20):
        placed = packing.place(pieces, rows_a_group=group).collect()
        bins = {}
        for r in placed:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 2048
        assert len(placed) == pieces.count()
        assert len(bins) == sum(t for t, _ in packing.plan(np.bincount([r.length for r in placed], minlength=2049), 2048))


def test_sharding_and_mixing_with_small_groups(spark):
    from tersely.llm import mixing, sharding

    rows = corpus(16) + [(7, "same " * 30, "en", "s1", 0)] * 40
    docs = frame(spark, rows)
    slots = {}
    for r in sharding.shard_documents(docs, rows_a_group=1).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    taken = [sorted(map(tuple, mixing.mix(docs, rows_a_group=n).select("doc_id", "size", "taken").collect()), key=str) for n in (1, 1 << 20)]
    assert taken[0] == taken[1]


def test_mixing_keeps_columns_of_any_name(spark):
    from tersely.llm import mixing

    names = ["_taken", "_tie", "row", "body", "id", "src", "tie", "taken", "rows", "whole", "rest", "copy", "size", "c0", "_h", "_sub", "_shard", "_own", "_t"]
    docs = frame(spark, corpus(17), extra=False).selectExpr("*", *[f"'{n}!' as `{n}`" for n in names])
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[n] == f"{n}!" for r in rows for n in names)


def test_very_long_texts(spark):
    from tersely.llm import mixing, sharding

    long = "word\n" * 600_000
    docs = spark.createDataFrame([(1, long, None, "s", 0), (2, "a b", None, "s", 0)], DOCS)
    assert {r["size"] for r in mixing.mix(docs).collect()} == {600_000, 2}
    assert sum(r.length for r in packing.tokenize(docs).where("doc_id = 1").collect()) > 600_000
    assert {r["size"] for r in sharding.shard_documents(docs).collect()} == {len(long) + 1, 4}
    assert {len(r.text.split()) for r in mixing.mix_documents(docs).collect()} <= set(range(600_001))
