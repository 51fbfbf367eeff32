"""Best-two-fit packing of documents into sequences (operator 2).

Tokenising is Arrow-batched; packing needs only how many pieces there are of each length, at most ``capacity``
counts however large the corpus. The planner builds one bin at a time from those counts: fill greedily with the
largest length that fits, then replace the bin's smallest piece by the two unpacked ones that fill its expanded
gap most tightly, as long as that gains. The same bin is repeated as often as the counts allow it, since the choice
would be the same; a pattern leaves at least one of its lengths too few for a further bin of its kind, so planning
takes a few thousand steps, whatever the number of pieces. A piece finds its place by its length and its rank among
pieces of that length, which sub-groups make without a global sort; their number follows the counts.

Edge cases: null or empty text is one piece, the end token; a text of any length is tokenised whole; ties between
pieces of one length go by place; repeated rows are packed one by one; an empty table gives an empty result; extra
columns of the input are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gapless, ship, worker_cache

ship(__name__)

TOKENIZER = "byte_bpe_50k.json"


def coder(name: str, literal: bool = True):
    """A function from a text to its ids, made once in each worker.

    The ids are those of the ``tokenizers`` file. A special token's name in a text is ordinary text if ``literal``;
    otherwise it is that token's id, as the file's tokenizer has it when it is loaded. Texts of Latin-1 characters
    go through the same vocabulary as ranks, whose word pattern treats these characters alike and which is about
    four times as fast; all others go through ``tokenizers`` itself, and so does a text whose runs of white space
    (some 700,000 characters) are too long for the fast coder's stack, and one with a special token's name that is
    not literal. tests/llm holds the two against each other.
    """
    coders = worker_cache().setdefault("coders", {})
    if (name, literal) not in coders:
        import base64
        import os

        import public_tokenizers as public
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(public.path(name))
        exact.encode_special_tokens = literal
        special = [] if literal else [t.content for t in exact.get_added_tokens_decoder().values()]
        with open(public.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            try:
                text.encode("latin-1")
                if any(t in text for t in special):
                    return exact.encode(text, add_special_tokens=False).ids
            except UnicodeEncodeError:
                return exact.encode(text, add_special_tokens=False).ids
            try:
                return fast.encode_ordinary(text)
            except BaseException as e:  # a panic in Rust is no Exception
                if type(e).__name__ != "PanicException":
                    raise
                return exact.encode(text, add_special_tokens=False).ids

        coders[name, literal] = encode
    return coders[name, literal]


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than the rest."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *[(s, capacity) for s in range(head, n, capacity)]]


def tokenize(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, end: int = 0, with_ids: bool = False, literal: bool = False) -> DataFrame:
    """Every document's pieces: doc_id, piece, start, length, ids_crc32 (and ids, if asked for)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        encode = coder(tokenizer, literal)
        for batch in batches:
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = {k: [] for k in names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], dtype="<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                    part = ids[s : s + n]
                    row = (doc, k, s, n, zlib.crc32(part.tobytes()), part) if with_ids else (doc, k, s, n, zlib.crc32(part.tobytes()))
                    for name, value in zip(names, row):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def best_pair(counts: np.ndarray, below: np.ndarray, room: int) -> tuple[int, int]:
    """Two lengths that are left and fill ``room`` most tightly, the larger first; (0, 0) if there are none."""
    a = np.flatnonzero(counts[: room + 1])
    if not len(a):
        return 0, 0
    b = below[np.minimum(room - a, a)]
    short = (b == a) & (counts[a] < 2)
    b = np.where(short, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    i = int(np.argmax(total))
    return (int(a[i]), int(b[i])) if total[i] else (0, 0)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one bin) for all pieces; ``counts[n]`` pieces have length ``n``."""
    counts = counts.astype(np.int64).copy()
    out = []
    while counts.any():
        bin_: list[int] = []
        left = counts

        def largest(room: int) -> int:
            have = np.flatnonzero(left[: room + 1])
            return int(have[-1]) if len(have) else 0

        left, room = counts.copy(), capacity
        while room and (n := largest(room)):
            k = min(int(left[n]), room // n)
            bin_ += [n] * k
            left[n] -= k
            room -= n * k
        while room and bin_:
            small = bin_[-1]
            have = np.flatnonzero(left)
            below = np.zeros(capacity + 1, np.int64)
            below[have] = have
            below = np.maximum.accumulate(below)
            a, b = best_pair(left, below, room + small)
            if a + b <= small:
                break
            bin_ = sorted([*bin_[:-1], a, b], reverse=True)
            left[small] += 1
            left[a] -= 1
            left[b] -= 1
            room += small - a - b
        used = np.bincount(bin_, minlength=capacity + 1)
        has = used > 0
        times = int((counts[has] // used[has]).min())
        counts -= used * times
        out.append((times, bin_))
    return out


def slots(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """The plan as flat arrays sorted by (length, rank): ranks from ``rank`` on go to bins from ``bin`` on,
    ``each`` of them side by side in a bin from ``offset`` on."""
    base, ranks, rows = 0, np.zeros(capacity + 1, np.int64), []
    for times, bin_ in plan(counts, capacity):
        offset = 0
        for n in dict.fromkeys(bin_):
            each = bin_.count(n)
            rows.append((n, ranks[n], base, each, offset))
            ranks[n] += each * times
            offset += n * each
        base += times
    rows.sort()
    names = ("length", "rank", "bin", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def place(pieces: DataFrame, capacity: int = 2048, rows_a_group: int = 1 << 20) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, ..., length), which are a checkpoint: their places in it
    deal the pieces of a length to groups of about ``rows_a_group``, so many equal rows are many groups too."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    table = slots(counts, capacity)
    salts = max(64, -(-int(counts.max()) // rows_a_group))
    ranked = gapless(pieces, ["length"], F.xxhash64(F.monotonically_increasing_id()), salts, ["doc_id", "piece"], "_rank")
    names = [c for c in pieces.columns]
    at = names.index("length")
    span = int(counts.max()) + 1

    def run(batches):
        key = table["length"] * span + table["rank"]
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            i = np.searchsorted(key, length * span + rank, side="right") - 1
            k = rank - table["rank"][i]
            sequence, offset = table["bin"][i] + k // table["each"][i], table["offset"][i] + k % table["each"][i] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents with their places. The narrow pieces are checkpointed, so texts are
    tokenised once."""
    return place(cut(tokenize(docs, capacity, tokenizer)), capacity)


def sequences(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids; at most ``capacity`` ids a row."""
    placed = place(cut(tokenize(docs, capacity, tokenizer, with_ids=True)), capacity)
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    return parts.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
