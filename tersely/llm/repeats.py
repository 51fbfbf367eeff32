"""Repeated byte strings by depth-limited radix passes over suffixes (operator 3).

Wanted: every byte covered by a ``threshold``-byte string that also starts in a document with a smaller id. A
suffix matters only up to ``threshold`` bytes, so suffixes are ordered to that depth and no further, most
significant digit first; groups that are equal at that depth are the repeated windows. A pass deals suffixes out
by a digit, drops those whose group lies in one document, and hands the rest to the next digit:

1. The first digit is dealt across the cluster: a window's anchor, the 24 bytes inside it with the smallest hash.
   Equal windows have equal anchors at equal places, so one record stands for the run of windows that share an
   anchor (about 14). Groups of one anchor within one document end here; that is nearly all text that is not
   repeated. This digit is a hash, which only deals: records that meet by chance part at the next digit.
2. Runs that are left travel with their bytes, dealt by anchor, and are ordered by them, eight bytes a digit. All
   but the smallest document of a group of equal runs are settled: every window of theirs starts there too.
3. The windows of the runs that are left are ordered likewise, for each place of the anchor in them, to depth
   ``threshold``. All but the smallest document of a group of equal windows are settled.

So what is removed is equal byte for byte; no decision is by hash. Records travel packed, a row for each task and
bucket. Before they leave a task, equal runs of it are compared by bytes and reduced to the smallest document's; the
others are settled on the spot, so a passage that a third of all documents share brings one record a task. An anchor
with very many different runs in a task is dealt out by run, and its windows by window. Texts are shuffled once, to
meet the runs that are left; the later passes read that same exchange. A task deals what it gets to smaller buckets
where there are more than ``most_partitions`` of them, and Spark sorts these, so a bucket is small at any size.

Edge cases: null text is empty; documents of under ``threshold`` bytes keep everything; a text of any length is
treated whole; rows with one id but different texts are documents of their own that do not cover each other; a null
id counts as the largest; repeated rows lose the same bytes; an empty table gives an empty result; extra columns of
the input are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir, release, ship

ship(__name__)

GRAM = 24
SEGMENT = 1 << 20
NO_ID = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the 64-bit finaliser of MurmurHash3, a public constant pair)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def tables(n: int):
    """Random values for bytes, and the powers of the base and of its inverse up to ``n``."""
    if _TABLES.get("n", 0) < n:
        values = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64)
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _TABLES.update(n=n, values=values, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _TABLES["values"], _TABLES["up"], _TABLES["down"]


class Sums:
    """Hashes of any substrings of ``data``: sums of byte values times powers, mod 2**64."""

    def __init__(self, data: np.ndarray):
        values, up, self.down = tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int):
    """Runs of windows that share an anchor: first window, number of windows - 1, document's place, digits, and the
    anchor's place in the first window.

    ``data`` holds documents side by side; document i is data[starts[i]:ends[i]].
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < threshold:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    s = Sums(data)
    grams = s.every(GRAM)
    bits = np.uint64(max(1, int(n).bit_length()))
    place = np.arange(len(grams), dtype=np.uint64)
    key = (mix(grams) >> bits << bits) | place
    width = threshold - GRAM + 1
    step, low = 1, key
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window that starts here
    inside = np.zeros(len(anchor) + 1, np.int8)
    long = ends - starts >= threshold
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - threshold + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    begins[starts[long]] = True
    first = np.flatnonzero(begins)
    stop = np.append(first[1:], len(anchor))
    doc = np.searchsorted(starts, first, "right") - 1
    last = np.minimum(stop - 1, ends[doc] - threshold)
    at = anchor[first]
    gram = mix(grams[at])
    whole = mix(s.of(first, last + threshold) + mix((at - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
    return first, last - first, doc, gram, whole, at - first


def segments(starts: np.ndarray, ends: np.ndarray, threshold: int, size: int = SEGMENT):
    """(from, to, [document, start, end]) pieces of about ``size`` bytes; a longer document is cut so that every
    window lies in exactly one piece."""
    group: list = []
    held = 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if b - a < threshold:
            continue
        for c in range(a, b - threshold + 1, size):
            d = min(b, c + size + threshold - 1)
            group.append((i, c, d))
            held += d - c
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def radix(digits, doc: np.ndarray) -> np.ndarray:
    """Which records are equal in all digits to one of a smaller document. Most significant digit first: after each
    digit only the groups that hold several documents go on. A digit is a function of the records' places."""
    at, group = np.arange(len(doc)), np.zeros(len(doc), np.int64)
    least = np.zeros(0, np.int64)
    for digit in digits:
        if not len(at):
            break
        d = digit(at)
        order = np.lexsort((d, group))
        at, group, d = at[order], group[order], d[order]
        new = np.append(True, (group[1:] != group[:-1]) | (d[1:] != d[:-1]))
        heads = np.flatnonzero(new)
        least, most = np.minimum.reduceat(doc[at], heads), np.maximum.reduceat(doc[at], heads)
        number = np.cumsum(new) - 1
        several = (most > least)[number]
        at, group = at[several], number[several]
    beaten = np.zeros(len(doc), bool)
    if len(at):
        beaten[at] = doc[at] > least[group]
    return beaten


def eights(body: np.ndarray) -> list:
    """The digits of rows of bytes, eight bytes each, as numbers that order like the bytes."""
    return [lambda at, k=k: np.ascontiguousarray(body[at, k : k + 8]).view(">u8").ravel().astype(np.uint64) for k in range(0, body.shape[1], 8)]


def plain(x: np.ndarray):
    return lambda at: x[at]


#: A point: the first window's place in the document, the run's length (five bits), and what is known of the run.
DONE, OPEN, CROWDED = 0, 1, 2
PLACE_BITS = 31


def point(place, length, state):
    return place << 7 | length << 2 | state


def slim(x: np.ndarray) -> bytes:
    return (x.astype("<u4") if not len(x) or x.max() < 1 << 32 else x.astype("<u8")).tobytes()


def wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<u4" if len(b) == 4 * n else "<u8").astype(np.int64)


def six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(n, 6)
    return out.view("<u8").ravel()


LOW48 = np.uint64((1 << 48) - 1)
ROW = ("bucket long, n long, key binary, second binary, docs binary, doc binary, point binary, row binary, off binary, body binary, "
       "done_row binary, done_point binary")
FIELDS = [c.split()[0] for c in ROW.split(", ")]


class Records:
    """Arrays side by side: the dealing key (48 bits), a second key or none, document, its row, point, the anchor's place
    in the first window, and the run's bytes or none."""

    def __init__(self, key, second, doc, row, point_, off, body):
        self.key, self.second, self.doc, self.row, self.point, self.off, self.body = key, second, doc, row, point_, off, body

    def __len__(self):
        return len(self.key)

    def take(self, at) -> "Records":
        part = lambda x: None if x is None else x[at]
        return Records(self.key[at], part(self.second), self.doc[at], self.row[at], self.point[at], self.off[at], part(self.body))

    @staticmethod
    def together(parts: list) -> "Records":
        names = ("key", "second", "doc", "row", "point", "off", "body")
        return Records(*[None if getattr(parts[0], n) is None else np.concatenate([getattr(p, n) for p in parts]) for n in names])

    def pack(self, threshold: int) -> tuple:
        """The fields of a packed row; documents are sorted, so their places are few bits."""
        r = self.take(np.lexsort((self.point, self.doc)))
        docs, index = np.unique(r.doc, return_inverse=True)
        same = np.array_equal(r.row, r.doc)
        body = b"" if r.body is None else r.body[sizes_mask(r.point, threshold, r.body.shape[1])].tobytes()
        return (len(r), six(r.key), b"" if r.second is None else r.second.tobytes(), docs.tobytes(), slim(np.diff(index, prepend=0)),
                slim(r.point), b"" if same else r.row.tobytes(), r.off.astype(np.uint8).tobytes(), body)

    @staticmethod
    def unpack(r: dict, threshold: int, width: int) -> "Records":
        n = r["n"]
        doc, point_ = np.frombuffer(r["docs"], np.int64)[np.cumsum(wide(r["doc"], n))], wide(r["point"], n)
        body = None
        if r["body"]:
            body = np.zeros((n, width), np.uint8)
            body[sizes_mask(point_, threshold, width)] = np.frombuffer(r["body"], np.uint8)
        return Records(from_six(r["key"], n), np.frombuffer(r["second"], np.uint64) if r["second"] else None, doc,
                       np.frombuffer(r["row"], np.int64) if r["row"] else doc, point_, np.frombuffer(r["off"], np.uint8).astype(np.int64), body)


def sizes_mask(point_: np.ndarray, threshold: int, width: int) -> np.ndarray:
    return np.arange(width) < ((point_ >> 2 & 31) + threshold)[:, None]


def width_of(threshold: int) -> int:
    """Bytes of the longest run, in whole digits."""
    return -(-(2 * threshold - GRAM) // 8) * 8


def bytes_at(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes: ``size`` bytes of ``data`` from ``start`` on, then zeros; ``data`` ends in ``width`` more."""
    body = np.lib.stride_tricks.sliding_window_view(data, width)[start]
    body *= np.arange(width) < size[:, None]
    return body


def packed(records: Records, buckets: int, to: np.ndarray, threshold: int, done_row: np.ndarray, done_point: np.ndarray):
    """Packed rows, one for each bucket that has records or a share of the settled."""
    bucket = (to % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    shares = max(1, min(buckets, -(-len(done_row) // 4096))) if len(done_row) else 0
    cuts = np.linspace(0, len(done_row), shares + 1).astype(np.int64)
    rows = []
    for i in range(max(len(own), shares)):
        over = slice(cuts[i], cuts[i + 1]) if i < shares else slice(0, 0)
        fields = records.take(order[starts[i] : ends[i]]).pack(threshold) if i < len(own) else (0, *[b""] * 8)
        rows.append((int(own[i]) if i < len(own) else i % buckets, *fields, done_row[over].tobytes(), done_point[over].tobytes()))
    types = [pa.int64(), pa.int64()] + [pa.binary()] * (len(FIELDS) - 2)
    for at in range(0, len(rows), 32):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 32]), types)], FIELDS)


class Packer:
    """Collects the runs of one task and packs them by bucket; equal ones are reduced to the smallest document's.

    ``crowd``: a key with more different runs than this in one task goes by its second key instead, marked as crowded,
    and a stand-in for all of them goes by the key.
    """

    def __init__(self, buckets: int, threshold: int, flush: int, crowd: int | None = None):
        self.buckets, self.threshold, self.flush_at, self.crowd = buckets, threshold, flush, crowd
        self.parts, self.held, self.texts, self.base = [], 0, [], 0

    def add(self, key, second, doc, row, point_, off, data, first):
        """Runs of ``data`` from ``first`` on; their bytes are looked up when needed."""
        self.parts.append((key & LOW48, second, doc, row, point_, off, first + self.base))
        self.texts.append(data)
        self.base += len(data)
        self.held += len(key)
        if self.held >= self.flush_at:
            yield from self.flush()

    def flush(self):
        if not self.held:
            self.parts, self.texts, self.base = [], [], 0
            return
        key, second, doc, row, point_, off, first = map(np.concatenate, zip(*self.parts))
        width = width_of(self.threshold)
        data = np.concatenate([*self.texts, np.zeros(width, np.uint8)])
        self.parts, self.held, self.texts, self.base = [], 0, [], 0
        size = (point_ >> 2 & 31) + self.threshold
        # equal runs: those that meet by both keys, then by their bytes
        order = np.lexsort((second, key))
        met = np.append(False, (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1]))
        met[:-1] |= met[1:]
        met = order[met]
        beaten = np.zeros(len(key), bool)
        group = np.cumsum(np.append(True, (key[met][1:] != key[met][:-1]) | (second[met][1:] != second[met][:-1]))) if len(met) else met
        at = 0
        while at < len(met):
            to = int(np.searchsorted(group, group[min(len(met) - 1, at + (1 << 16))], "right"))
            part = met[at:to]
            body = bytes_at(data, first[part], size[part], width)
            beaten[part] = radix([plain(group[at:to]), plain(off[part] << 8 | size[part]), *eights(body)], doc[part])
            at = to
        keep = np.flatnonzero(~beaten)
        if self.crowd is None:
            body = bytes_at(data, first[keep], size[keep], width)
            kept = Records(key[keep], None, doc[keep], row[keep], point_[keep], off[keep], body)
            yield from packed(kept, self.buckets, kept.key, self.threshold, row[beaten], point_[beaten] & ~3)
            return
        kept = Records(key[keep], second[keep], doc[keep], row[keep], point_[keep], off[keep], None)
        to = kept.key
        order = np.lexsort((kept.second, kept.key))
        k, s = kept.key[order], kept.second[order]
        new = np.append(True, k[1:] != k[:-1])
        other = new | np.append(True, s[1:] != s[:-1])
        number = np.cumsum(new) - 1
        crowded = np.bincount(number, weights=other)[number] > self.crowd
        if crowded.any():
            heads, crowded = order[new & crowded], order[crowded]
            kept.point = kept.point & ~3
            kept.point[crowded] |= CROWDED
            to = kept.key.copy()
            to[crowded] = kept.second[crowded] & LOW48
            stand_in = kept.take(heads)
            stand_in.point = stand_in.point | 3
            kept, to = Records.together([kept, stand_in]), np.concatenate([to, stand_in.key])
        yield from packed(kept, self.buckets, to, self.threshold, row[beaten], point_[beaten] & ~3)


def by_bucket(batches):
    """The packed rows of a partition that is sorted by bucket, bucket by bucket."""
    held, number = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["bucket"] != number:
                yield held
                held = []
            number = r["bucket"]
            held.append(r)
    if held:
        yield held


def points(row: np.ndarray, point_: np.ndarray):
    for at in range(0, len(row), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(row[at : at + 200_000]), pa.array(point_[at : at + 200_000])], ["row", "point"])


def settled_before(rows: list[dict]):
    for r in rows:
        if r["done_row"]:
            yield from points(np.frombuffer(r["done_row"], np.int64), np.frombuffer(r["done_point"], np.int64) & ~3)


def dealt(rows: DataFrame, buckets: int, partitions: int, threshold: int, flush: int = 1 << 20) -> DataFrame:
    """Packed rows with each bucket's side by side. Where a partition has several buckets, its task deals what it gets
    to them; Spark then sorts, on disk if need be."""
    width = width_of(threshold)

    def finer(batches):
        parts, held = [], 0

        def out():
            records = Records.together(parts)
            yield from packed(records, buckets, np.where(records.point & 3 == CROWDED, records.second & LOW48, records.key) if records.second is not None else records.key,
                              threshold, np.zeros(0, np.int64), np.zeros(0, np.int64))

        for batch in batches:
            for r in batch.to_pylist():
                if r["done_row"]:
                    done = {**r, "n": 0, **{f: b"" for f in FIELDS[2:10]}}
                    yield pa.RecordBatch.from_pylist([done], schema=batch.schema)
                if r["n"]:
                    parts.append(Records.unpack(r, threshold, width))
                    held += r["n"]
                if held >= flush:
                    yield from out()
                    parts, held = [], 0
        if held:
            yield from out()

    rows = rows.repartition(partitions, "bucket")
    return (rows.mapInArrow(finer, ROW) if buckets > partitions else rows).sortWithinPartitions("bucket")


def open_runs(rows: list[dict], threshold: int, width: int):
    """Of one bucket's runs those whose key several documents have, or that are crowded."""
    r = Records.together([Records.unpack(r, threshold, width) for r in rows])
    order = np.argsort(r.key, kind="stable")
    r = r.take(order)
    new = np.append(True, r.key[1:] != r.key[:-1])
    group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    state = r.point & 3
    several = np.maximum.reduceat(r.doc, heads) > np.minimum.reduceat(r.doc, heads)
    crowded = np.maximum.reduceat((state == 3).astype(np.int8), heads) > 0
    is_crowded = (state == CROWDED) | crowded[group]
    go = (state != 3) & (several[group] | is_crowded)
    yield from points(r.row[go], r.point[go] & ~3 | np.where(is_crowded[go], CROWDED, OPEN))


def settle(rows: list[dict], threshold: int, width: int):
    """Of one bucket's runs with their bytes, those that are equal to one of a smaller document, and the windows of the
    others that are."""
    r = Records.together([Records.unpack(r, threshold, width) for r in rows])
    length = r.point >> 2 & 31
    beaten = radix([plain(r.key), plain(r.off << 8 | length), *eights(r.body)], r.doc)
    yield from points(r.row[beaten], r.point[beaten] & ~3)
    r = r.take(np.flatnonzero(~beaten))
    length, place = r.point >> 2 & 31, r.point >> 7
    for j in range(threshold - GRAM + 1):  # the anchor's place in the window
        step = r.off - j
        own = np.flatnonzero((step >= 0) & (step <= length))
        if not len(own):
            continue
        body = np.zeros((len(own), -(-threshold // 8) * 8), np.uint8)
        for i in np.unique(step[own]):
            mine = step[own] == i
            body[mine, :threshold] = r.body[own[mine], i : i + threshold]
        beaten = radix([plain(r.key[own]), *eights(body)], r.doc[own])
        hit = own[beaten]
        yield from points(r.row[hit], point(place[hit] + step[hit], 0, DONE))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a batch's documents side by side, and where each begins and ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def runs_of(column: pa.Array, threshold: int, wanted: np.ndarray | None = None):
    """Runs of a batch, segment by segment: (place in the batch, first window in the document, length, digits, the
    anchor's place; and the segment's bytes with the run's start there)."""
    data, starts, ends = texts(column)
    if wanted is not None:
        ends = np.where(wanted, ends, starts)
    for group in segments(starts, ends, threshold):
        which, a, b = (np.array(x, np.int64) for x in zip(*group))
        size = b - a
        end = np.cumsum(size)
        part = data[a[0] : b[0]] if len(group) == 1 else np.concatenate([data[x:y] for x, y in zip(a.tolist(), b.tolist())])
        first, length, doc, gram, whole, off = runs(part, end - size, end, threshold)
        yield which[doc], first - (end - size)[doc] + a[doc] - starts[which[doc]], length, gram, whole, off, part, first


def removed(n: int, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which of ``n`` bytes the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    return np.cumsum(edge[:-1]) > 0


def with_rows(docs: DataFrame) -> tuple[DataFrame, int]:
    """((doc_id, row, text), bytes of all texts): a number for each row, which is the id if no two rows share one and none is
    null; otherwise the rows are numbered in a checkpoint."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sizes = d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, total = sizes.agg(F.max(F.when(F.col("doc_id").isNull(), 2).otherwise(F.col("n"))), F.sum("bytes")).first()
    if (most or 0) < 2:
        # never null, so that a join that needs no null reads the same exchange as one that does
        return d.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("row"), "text"), total or 0
    return cut(d.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")), total


def order_of(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(NO_ID).to_numpy()


def remove_repeats(docs: DataFrame, threshold: int = 50, records_a_bucket: int = 400_000, crowd: int = 64, keep_text: bool = False,
                   most_partitions: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and ``kept``, the bytes that stay)."""
    if not GRAM <= threshold < GRAM + 32:
        raise ValueError(f"threshold must be from {GRAM} to {GRAM + 31}")
    ensure_checkpoint_dir(docs.sparkSession)
    spark = docs.sparkSession
    d, n_bytes = with_rows(docs)
    density = 2.0 / (threshold - GRAM + 2)
    buckets = int(max(8, n_bytes * density / records_a_bucket))
    partitions = min(buckets, most_partitions)
    width = width_of(threshold)

    def first_pass(batches):
        packer = Packer(partitions, threshold, 1 << 20, crowd)
        for batch in batches:
            ids, row = order_of(batch.column(0)), batch.column(1).to_numpy()
            for which, place, length, gram, whole, off, data, first in runs_of(batch.column(2), threshold):
                yield from packer.add(gram, whole, ids[which], row[which], point(place, length, DONE), off, data, first)
        yield from packer.flush()

    def second_pass(batches):
        for rows in by_bucket(batches):
            yield from settled_before(rows)
            if rows := [r for r in rows if r["n"]]:
                yield from open_runs(rows, threshold, width)

    found = d.mapInArrow(first_pass, ROW)
    found = dealt(found, buckets, partitions, threshold).mapInArrow(second_pass, "row long, point long")
    found = found.groupBy("row").agg(F.collect_list("point").alias("points"))
    found = found.checkpoint(eager=True)
    release(spark)  # the shuffle files of the first passes are the largest
    joined = d.join(found.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "points")

    def third_pass(batches):
        packer = Packer(partitions, threshold, 1 << 18)
        for batch in batches:
            ids, rows = order_of(batch.column(0)), batch.column(1).to_numpy()
            at = batch.column(3).offsets.to_numpy()
            own = batch.column(3).values.to_numpy()[at[0] : at[-1]]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            row, own = row[own & 3 != DONE], own[own & 3 != DONE]
            wanted = np.zeros(batch.num_rows, bool)
            wanted[row] = True
            place = row << PLACE_BITS | own >> 7
            order = np.argsort(place, kind="stable")
            place, state = place[order], own[order] & 3
            if not len(place):
                continue
            for which, start, length, gram, _, off, data, first in runs_of(batch.column(2), threshold, wanted):
                i = np.minimum(np.searchsorted(place, which << PLACE_BITS | start), len(place) - 1)
                hit = place[i] == which << PLACE_BITS | start
                whole = np.flatnonzero(hit & (state[i] == OPEN))
                if len(whole):
                    yield from packer.add(gram[whole], gram[whole], ids[which[whole]], rows[which[whole]], point(start[whole], length[whole], DONE), off[whole], data, first[whole])
                apart = np.flatnonzero(hit & (state[i] == CROWDED))
                if len(apart):  # window by window, each dealt by itself
                    many = length[apart] + 1
                    run = np.repeat(apart, many)
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    key = mix(Sums(data).of(first[run] + step, first[run] + step + threshold))
                    yield from packer.add(key, key, ids[which[run]], rows[which[run]], point(start[run] + step, 0, DONE), off[run] - step, data, first[run] + step)
        yield from packer.flush()

    def last_pass(batches):
        for rows in by_bucket(batches):
            yield from settled_before(rows)
            if rows := [r for r in rows if r["n"]]:
                yield from settle(rows, threshold, width)

    rims = joined.where("points is not null").mapInArrow(third_pass, ROW)
    rims = dealt(rims, buckets, partitions, threshold, 1 << 18).mapInArrow(last_pass, "row long, point long")
    rims = rims.groupBy("row").agg(F.collect_list("point").alias("rims"))
    both = joined.join(rims.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "points", "rims")

    def spans_at(column: pa.Array):
        """A batch's settled runs: row by row (from, to)."""
        column = column.fill_null([]) if column.null_count else column
        at = column.offsets.to_numpy()
        p = column.values.to_numpy()[at[0] : at[-1]]
        row = np.repeat(np.arange(len(column)), np.diff(at))
        row, p = row[p & 3 == DONE], p[p & 3 == DONE]
        start = p >> 7
        return np.searchsorted(row, np.arange(len(column) + 1)), start, start + (p >> 2 & 31) + threshold

    def finish(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
        for batch in batches:
            data, starts, ends = texts(batch.column(2))
            groups = [spans_at(batch.column(i)) for i in (3, 4)]
            out = []
            for i, (doc, a, b) in enumerate(zip(batch.column(0).to_pylist(), starts.tolist(), ends.tolist())):
                body = data[a:b]
                spans = [(s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]) for at, s, e in groups if at[i + 1] > at[i]]
                gone = spans_count = 0
                if spans:
                    mask = removed(b - a, spans)
                    gone, spans_count = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    body = body[~mask]
                out.append((doc, b - a, gone, spans_count, hashlib.sha256(body.tobytes()).hexdigest(), *([body.tobytes()] if keep_text else [])))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
