"""Removal of repeated 100-byte strings by distributed prefix doubling.

Plain prefix doubling sorts (position, rank, rank) for every byte of the corpus
in each round. Here the rounds are kept, but the first rank is taken at offset
50 at once, at sampled positions, and only unresolved positions go on:

1. In each 100-byte window the 50-byte string of least hash is its anchor, so
   equal windows have equal anchors at equal places. Anchors are ranked by
   their 50 bytes; unique ones settle all their windows. A repeated anchor
   whose whole surroundings repeat settles them too: all but the first go.
2. Positions of the other repeated anchors are ranked by the pair of their
   50-byte ranks at offsets 0 and 50, which is their rank at the threshold of
   100 bytes. All but the first of a rank are covered.

Ranks are 100 bits or more of the strings' hashes, not dense numbers, as only
their equality counts. Records travel as packed arrays, one row for each pair of task and
bucket; a task sends each rank once, so a string that a third of all documents
hold costs one record a task. Nothing but two totals reaches the driver.

A null text is empty. Rows that repeat a doc_id are one document, so a row is
never a repeat of its own copy. Rows without doc_id come after all others, as
one document. An empty table gives an empty result; extra columns are ignored.
Removal is by bytes and can split a character, so kept text is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import cut

LENGTH, HALF = 100, 50
WIDTH = LENGTH - HALF + 1
#: Windows looked at together; a power of two, as a place must fit beside its hash.
CHUNK_BITS = 17
CHUNK = 1 << CHUNK_BITS
#: Anchors a task holds before it sends them.
HELD = 500_000
#: Text behind one bucket of records or of documents.
BUCKET_BYTES = 16 << 20
_LAST_ID = (1 << 63) - 1

_U = np.uint64
_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def halves(data: np.ndarray) -> np.ndarray:
    """Hash of the 50 bytes at each position."""
    h = {1: _TABLE[data]}
    for n in (1, 2, 4, 8, 16):
        x = h[n][:-n] * _power(n)
        x += h[n][n:]
        h[2 * n] = x
    h48 = h[32][:-16] * _power(16)
    h48 += h[16][32:]
    h50 = h48[:-2] * _power(2)
    h50 += h[2][48:]
    return _mix(h50)


def anchors(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rank of the anchor, rank of its surroundings, first window, windows) of each run of windows with one anchor."""
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        h = halves(data[at : at + CHUNK + LENGTH - 1])
        n = len(h) - WIDTH + 1
        key = (h & _U(_MASK ^ (2 * CHUNK - 1))) | np.arange(len(h), dtype=_U)
        m = key
        for s in (1, 2, 4, 8, 16):
            m = np.minimum(m[:-s], m[s:])
        m = np.minimum(m[: n], m[WIDTH - 32 : WIDTH - 32 + n])
        place = (m & _U(2 * CHUNK - 1)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        hi = np.concatenate([lo[1:], [n]]) - 1
        a = place[lo]
        # the first and the last window cover the surroundings, and two halves a window
        ctx = _mix(h[lo] * _power(3) + h[lo + HALF] * _power(5) + h[hi] * _power(7) + h[hi + HALF] * _power(11) + ((hi - lo) * 64 + (a - lo)).astype(_U) * _U(0x9E3779B97F4A7C15))
        yield h[a], ctx, lo + at, hi - lo + 1


def _anchors_of(h: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Place of the anchor of each of some windows."""
    out = np.empty(len(windows), np.int64)
    for k in range(0, len(windows), 4096):
        some = windows[k : k + 4096]
        out[k : k + 4096] = some + (h[some[:, None] + np.arange(WIDTH)] >> _U(CHUNK_BITS + 1)).argmin(axis=1)
    return out


def buckets_of(ids: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(id), n), as Spark computes it."""
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    x = ids.astype(np.int64).view(_U) * p2
    x = ((x << _U(31)) | (x >> _U(33))) * p1
    h = (_U(42) + p5 + _U(8)) ^ x
    h = ((h << _U(27)) | (h >> _U(37))) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return (h ^ (h >> _U(32))).view(np.int64) % n


SCHEMA = "kind int, key int, place int, blob binary"
#: Kinds of records: ranks to compare; covered windows of documents; windows still to rank.
RANK, COVERED, OPEN = 0, 1, 2


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of unsigned integers, each cut to so many bytes; like bytes lie together."""
    parts = [np.int64(len(columns[0][0])).tobytes()]
    for x, width in columns:
        parts.append(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes, *widths: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n, at, out = int(data[:8].view(np.int64)[0]), 8, []
    for w in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = data[at : at + n * w].reshape(w, n).T
        out.append(x.view(np.int64).ravel())
        at += n * w
    return out


#: Bytes of the columns: anchor, surroundings, document, window, windows, whether a task has several surroundings;
#: anchor, document, anchor's place, window before it, pair of ranks; document, window, windows.
_RANKS, _PAIRS, _SPANS = (7, 6, 8, 4, 1, 1), (7, 8, 4, 1, 6), (8, 4, 4)


def _groups(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(key[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, order[edges[k] : edges[k + 1]]


class Out:
    """Record batches of SCHEMA."""

    def __init__(self, ranks: int, places: int):
        self.ranks, self.places, self.rows = ranks, places, []

    def rank(self, widths: tuple[int, ...], key: np.ndarray, *columns: np.ndarray) -> None:
        for k, at in _groups(((key >> _U(32)) % _U(self.ranks)).astype(np.int64), self.ranks):
            self.rows.append((RANK, k, 0, pack(*((c[at], w) for c, w in zip((key, *columns), widths)))))

    def spans(self, kind: int, ids: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
        """Runs of windows; those that touch are joined."""
        if not len(ids):
            return
        order = np.lexsort((lo, ids))
        ids, lo, n = ids[order], lo[order], n[order]
        if kind == COVERED:
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (lo[1:] > lo[:-1] + n[:-1])])
            first = np.flatnonzero(new)
            end = np.maximum.reduceat(lo + n, first)
            ids, lo = ids[first], lo[first]
            n = end - lo
        for k, at in _groups(buckets_of(ids, self.places), self.places):
            self.rows.append((kind, k % self.ranks, k, pack(*((c[at], w) for c, w in zip((ids, lo, n), _SPANS)))))

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [(), (), (), ()]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "key", "place", "blob"])


def _firsts(order: np.ndarray, keys: tuple[np.ndarray, ...], ids: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by keys, ids, lo: which are first of their keys, and which come after another place."""
    n = len(order)
    first = np.ones(n, bool)
    first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    i, p = ids[order], lo[order]
    return first, (i != i[start]) | (p != p[start])


def _sampled(out: Out, parts: list[tuple]) -> None:
    """One task's anchors: its own repeats are settled here; each rank is sent once."""
    kh, ch, lo, n, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, ids, ch, kh))
    first, later = _firsts(order, (kh, ch), ids, lo)
    gone = order[later]
    out.spans(COVERED, ids[gone], lo[gone], n[gone])
    own = order[first]
    k = kh[own]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(own)))
    several = np.repeat(count > 1, count)
    more = own[several]
    out.spans(OPEN, ids[more], lo[more], n[more])
    one = own[start]
    out.rank(_RANKS, kh[one], ch[one], ids[one], lo[one], n[one], (count > 1).astype(np.int64))


def _rows(table: pa.Table, kind: int, *widths: int) -> list[np.ndarray] | None:
    found = [unpack(b.as_py(), *widths) for k, b in zip(table.column("kind").to_pylist(), table.column("blob")) if k == kind]
    return [np.concatenate(x) for x in zip(*found)] if found else None


def _kept_rows(table: pa.Table) -> pa.Table:
    return table.filter(pa.compute.not_equal(table.column("kind"), RANK))


def _settle(ranks: int, places: int):
    """Anchors of one bucket, of all tasks."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = _rows(table, RANK, *_RANKS), Out(ranks, places)
        if rows is not None:
            kh, ch, ids, lo, n, flag = rows
            order = np.lexsort((lo, ids, ch, kh))
            k = kh[order]
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(start, len(k)))
            c = ch[order]
            mixed = np.maximum.reduceat(flag[order], start) > 0
            mixed |= np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
            mixed = np.repeat(mixed, size)
            _, later = _firsts(order, (kh,), ids, lo)
            gone = order[later & ~mixed]
            out.spans(COVERED, ids[gone], lo[gone], n[gone])
            more = order[mixed & (flag[order] == 0)]
            out.spans(OPEN, ids[more], lo[more], n[more])
        return pa.concat_tables([_kept_rows(table), pa.Table.from_batches([out.batch()])])

    return run


def _double(ranks: int, places: int):
    """Pairs of 50-byte ranks of one bucket's open windows."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        out, rows = Out(ranks, places), _rows(spans, OPEN, *_SPANS)
        if rows is None:
            return pa.Table.from_batches([out.batch()])
        ids, lo, n = rows
        order = np.argsort(ids, kind="stable")
        ids, lo, n = ids[order], lo[order], n[order]
        seen: set[int] = set()
        parts = []
        for i, text in zip(docs.column("_d").to_pylist(), docs.column("text").cast(pa.large_binary())):
            a, b = np.searchsorted(ids, [i, i + 1] if i < _LAST_ID else [i, i])
            b = len(ids) if i == _LAST_ID else b
            if a == b or i in seen or not text.is_valid:
                continue
            seen.add(i)
            h = halves(np.frombuffer(text.as_buffer(), np.uint8))
            p = np.repeat(lo[a:b], n[a:b]) + np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            p = np.unique(p[p + HALF < len(h)])
            a = _anchors_of(h, p)
            parts.append((h[a], (p - a + HALF).astype(np.int64), _mix(h[p] * _power(3) + h[p + HALF] * _power(5)) >> _U(16), a, np.full(len(p), i, np.int64)))
        if parts:
            anchor, r, pair, a, who = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((a, who, pair, r, anchor))
            first, later = _firsts(order, (anchor, r, pair), who, a)
            gone = order[later]
            out.spans(COVERED, who[gone], (a + r - HALF)[gone], np.ones(len(gone), np.int64))
            one = np.sort(order[first])  # windows of one anchor stay together, and pack well
            out.rank(_PAIRS, anchor[one], who[one], a[one], r[one], pair[one])
        return pa.Table.from_batches([out.batch()])

    return run


def _rerank(ranks: int, places: int):
    """Pairs of ranks of one bucket, of all tasks: all but the first place are covered."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = _rows(table, RANK, *_PAIRS), Out(ranks, places)
        if rows is not None:
            anchor, ids, a, r, pair = rows
            order = np.lexsort((a, ids, pair, r, anchor))
            _, later = _firsts(order, (anchor, r, pair), ids, a)
            gone = order[later]
            out.spans(COVERED, ids[gone], (a + r - HALF)[gone], np.ones(len(gone), np.int64))
        return pa.concat_tables([_kept_rows(table), pa.Table.from_batches([out.batch()])])

    return run


def _sample(ranks: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, held = Out(ranks, places), [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                if not text.is_valid or len(text.as_buffer()) < LENGTH:
                    continue
                for a in anchors(np.frombuffer(text.as_buffer(), np.uint8)):
                    parts.append((*a, np.full(len(a[0]), i, np.int64)))
                    held += len(a[0])
                if held >= HELD:
                    _sampled(out, parts)
                    yield out.batch()
                    parts, held = [], 0
        if parts:
            _sampled(out, parts)
            yield out.batch()

    return run


def _apply(keep_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        rows = _rows(spans, COVERED, *_SPANS) or [np.zeros(0, np.int64)] * 3
        order = np.argsort(rows[0], kind="stable")
        ids, lo, n = (x[order] for x in rows)
        result: list[list] = [[], [], [], [], [], []]
        for i, d, text in zip(docs.column("doc_id").to_pylist(), docs.column("_d").to_pylist(), docs.column("text").cast(pa.large_binary())):
            data = text.as_buffer() if text.is_valid else b""
            a = np.searchsorted(ids, d)
            b = np.searchsorted(ids, d, side="right")
            size = len(data)
            removed = spans_ = 0
            kept = data
            if b > a and size:
                step = np.zeros(size + 1, np.int64)
                np.add.at(step, np.minimum(lo[a:b], size), 1)
                np.add.at(step, np.minimum(lo[a:b] + n[a:b] - 1 + LENGTH, size), -1)
                off = np.cumsum(step[:-1]) > 0
                removed = int(off.sum())
                spans_ = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~off].tobytes()
            for x, v in zip(result, (i, size, removed, spans_, hashlib.sha256(kept).hexdigest(), bytes(kept) if keep_text else None)):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        m = 6 if keep_text else 5
        return pa.table([pa.array(c, t) for c, t in zip(result[:m], kinds)], names=names[:m])

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = ranks = max(1, -(-total // BUCKET_BYTES))
    ids = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("_d"), "text")
    by_place = ids.withColumn("_p", F.pmod(F.xxhash64("_d"), F.lit(places)).cast("int"))

    def place(df: DataFrame, kind: int) -> DataFrame:
        return df.where(F.col("kind") == kind).withColumnRenamed("place", "_p").groupBy("_p")

    sampled = ids.select("_d", "text").mapInArrow(_sample(ranks, places), SCHEMA)
    settled = cut(sampled.groupBy("key").applyInArrow(_settle(ranks, places), SCHEMA))
    unsettled = _in(by_place.select("_p", "_d", "text"), _documents(settled, (OPEN,)), "left_semi")
    paired = unsettled.groupBy("_p").cogroup(place(settled, OPEN)).applyInArrow(_double(ranks, places), SCHEMA)
    covered = settled.union(cut(paired.groupBy("key").applyInArrow(_rerank(ranks, places), SCHEMA)))
    named = _documents(covered, (COVERED,))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    some = _in(by_place, named, "left_semi").groupBy("_p").cogroup(place(covered, COVERED)).applyInArrow(_apply(keep_text), schema)
    whole = F.coalesce("text", F.lit("")).cast("binary")
    rest = _in(ids, named, "left_anti").select("doc_id", F.octet_length(whole).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(whole, 256), *([whole] if keep_text else []))
    return some.union(rest)


#: Bits of a filter of documents, and of one of its rows.
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 16


def _documents(spans: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """A filter (row, bits) of the documents that spans of these kinds name: at most FILTER_BITS bits, whatever the input.

    A document outside of the filter isn't named; the fuller it is, the more others are let through.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for blob in b.column(0):
                at = buckets_of(np.unique(unpack(blob.as_py(), *_SPANS)[0]), FILTER_BITS)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        rows = bits.view(np.int64).reshape(-1, ROW_BITS // 64)
        own = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([r.tolist() for r in rows[own]], pa.list_(pa.int64()))], names=["row", "bits"])

    def joined(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce(np.stack([np.array(x, np.int64) for x in t.column("bits").to_pylist()]))
        return pa.table({"row": pa.array([t.column("row")[0].as_py()], pa.int64()), "bits": pa.array([bits.tolist()], pa.list_(pa.int64()))})

    schema = "row long, bits array<long>"
    return F.broadcast(cut(spans.where(F.col("kind").isin(*kinds)).select("blob").mapInArrow(some, schema).groupBy("row").applyInArrow(joined, schema)))


def _in(docs: DataFrame, filter_: DataFrame, how: str) -> DataFrame:
    bit = F.pmod(F.xxhash64("_d"), F.lit(FILTER_BITS))
    word = F.get(filter_["bits"], F.floor(F.pmod(bit, F.lit(ROW_BITS)) / 64).cast("int"))
    return docs.join(filter_, (F.floor(bit / ROW_BITS) == filter_["row"]) & (F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1), how)


def op10_suffix(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)


def brute_force(texts: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, int, str]]:
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256), by the definition; for tests."""
    first: set[bytes] = set()
    out = {}
    for i, t in sorted(texts):
        off = bytearray(len(t))
        for s in range(len(t) - LENGTH + 1):
            w = t[s : s + LENGTH]
            if w in first:
                off[s : s + LENGTH] = b"\x01" * LENGTH
            first.add(w)
        spans_ = sum(1 for k in range(len(off)) if off[k] and (k == 0 or not off[k - 1]))
        out[i] = (len(t), sum(off), spans_, hashlib.sha256(bytes(b for b, o in zip(t, off) if not o)).hexdigest())
    return out
