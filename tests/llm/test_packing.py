import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tersely.llm import packing

from .fixtures import DOCS, corpus, frame


def exact():
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_both_coders_agree_on_latin_1():
    fast, slow = packing.coder(packing.TOKENIZER), exact()
    marks = [chr(i) for i in range(256)]
    texts = [f"a{c}b {c}{c} 1{c}2 {c}\n  {c}'s" for c in marks] + ["".join(marks), "<|endoftext|> x", " " * 50 + "y", "z" * 5000]
    assert [fast(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_coder_on_any_text(text):
    assert packing.coder(packing.TOKENIZER)(text) == exact_ids(text)


def exact_ids(text, _cache=[]):
    if not _cache:
        _cache.append(exact())
    return _cache[0].encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = corpus(5)
    rows.append((9999, "long text here " * 2000, "en", "s1", 0))
    slow, want = exact(), {}
    for r in rows:
        want[r[0]] = [*slow.encode(r[1] or "", add_special_tokens=False).ids, 0]
    got = packing.pack_documents(frame(spark, rows)).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p.start == at and (p.length == 2048 or k == 0)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for parts in by_bin.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(len(x) for x in want.values())
    assert len(by_bin) <= -(-total // 2048) + 1


def test_sequences_hold_the_ids(spark):
    rows = corpus(6, 30)
    out = packing.sequences(spark.createDataFrame(rows, DOCS)).collect()
    slow = exact()
    assert sum(len(r.ids) for r in out) == sum(len(slow.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert max(len(r.ids) for r in out) <= 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_plan_packs_everything(lengths):
    counts = np.bincount(lengths, minlength=65)
    used = np.zeros(65, int)
    bins = 0
    for times, b in packing.plan(counts, 64):
        assert sum(b) <= 64
        used += np.bincount(b, minlength=65) * times
        bins += times
    assert (used == counts).all()
    assert bins <= 1.7 * -(-sum(lengths) // 64) + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_of_white_space_beyond_the_fast_coder():
    fast = packing.coder(packing.TOKENIZER)
    for text in (" " * 2_000_000, "a" + "\n" * 1_000_000 + "b"):
        assert fast(text) == exact_ids(text)
