"""Near copies by the Jaccard similarity of word shingles, exactly.

Two texts are near copies where their sets of SHINGLE-word shingles have a
Jaccard similarity of at least 4/5. Each set proposes its prefix, its first
n - ceil(4n/5) + 1 shingles in an order that all sets share: similar sets must
meet in their prefixes. Pairs whose sizes, or the number of shingles that their
prefixes share, rule the similarity out are left, the others are verified on the whole sets. No
pair is lost; the order (rare shingles first, as far as a sample tells) decides
only how many pairs are looked at.

Documents of one known component aren't paired with each other, so a group of
copies that is joined already (``neardup`` does that first) costs its rows and
not its pairs.

Shingles are compared as 64-bit hashes. Texts of fewer words are one shingle;
texts without words have none and are in no pair. Repeated rows are kept; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import SLICE_ROWS, with_ids

SHINGLE = 5
#: Bounds of the sample that tells frequent shingles: documents, shingles remembered.
SAMPLE_DOCS, FREQUENT = 4_000, 200_000
#: Pairs held before they are handed on.
_PAIRS = 1 << 17
_SEED, _SHORT_SEED = 42, 43
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_BLANK = re.compile(rb"[\x20\t-\r]")
#: Bytes hashed at once, up to the next blank; longer words are hashed one by one.
_CHUNK, _LONG = 1 << 20, 64
_INSIDE = np.array([_BLANK.match(bytes((b,))) is None for b in range(256)])
_VALUES = np.where(_INSIDE, np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64), np.uint64(0))
_POWERS = np.cumprod(np.full(_LONG, 0xD1342543DE82EF95, np.uint64))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each word of lower-case bytes; long texts in bounded memory."""
    places, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        blank = _BLANK.search(data, at + _CHUNK)
        end = blank.start() if blank else len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.concatenate([[False], _INSIDE[x], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = edges[::2], edges[1::2] - edges[::2]
        if len(start):
            x = x[start[0] :]
            n = np.diff(start, append=end - at)
            # a word's bytes by their values and places in it, added up; blanks count nothing
            h = np.add.reduceat(_VALUES[x] * _POWERS[np.minimum(np.arange(len(x)) - np.repeat(start - start[0], n), _LONG - 1)], start - start[0])
            h = (h ^ (h >> np.uint64(33))) * _MIX
            for k in np.flatnonzero(size > _LONG).tolist():
                h[k] = xxhash.xxh64_intdigest(data[at + start[k] : at + start[k] + size[k]], _SEED)
            places.append(start + at)
            hashes.append(h)
        at = end
    return np.concatenate(places), np.concatenate(hashes)


def shingles_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    data = b" ".join([t or b"" for t in texts]).lower()
    places, w = _words(data)
    # the first word of each text, and the end
    first = np.searchsorted(places, np.cumsum([0, *[len(t or b"") + 1 for t in texts]])).tolist()
    h = np.zeros(max(0, len(w) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        h *= _BASE
        h += w[k : k + len(h)]
    for _ in range(2):
        h ^= h >> np.uint64(33)
        h *= _MIX
    h ^= h >> np.uint64(33)
    out = []
    for t, a, b in zip(texts, first, first[1:]):
        if b - a < SHINGLE:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), _SHORT_SEED)] if b > a else [], dtype=np.uint64))
        else:
            x = np.sort(h[a : b - SHINGLE + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return shingles_of([text])[0]


def similar(common: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    """Whether sets of a and b shingles that share so many have a similarity of 4/5 at least."""
    return 9 * common >= 4 * (a + b)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, shingles, other columns) of batches of doc_id, text and others."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(at, SLICE_ROWS)
            yield from zip(part.column(0).to_pylist(), shingles_of(part.column(1).cast(pa.binary()).to_pylist()), *[c.to_pylist() for c in part.columns[2:]])


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that a sample of docs (n rows) has more than once, and how often."""
    drawn = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 40))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["shingle"])

    counts = drawn.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow()
    keys, n_of = (counts.column(k).to_numpy() for k in ("shingle", "count"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], n_of[order]


def prefixes(docs: DataFrame, sampled: DataFrame, n: int) -> DataFrame:
    """(shingle, doc_id, n, root): the prefix of each set of n shingles; docs has doc_id, text and root, the order comes from sampled (n rows)."""
    model = docs.sparkSession.sparkContext.broadcast(frequent(sampled, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = model.value
        for i, s, root in _texts(batches):
            size = len(s)
            if not size:
                continue
            seen = np.zeros(size, dtype=np.int64)
            if len(keys):
                k = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                seen = np.where(keys[k] == s, often[k], 0)
            first = s[np.argsort(seen, kind="stable")[: size - (4 * size + 4) // 5 + 1]]
            m = len(first)
            cols = [first.view(np.int64), np.full(m, i), np.full(m, size, dtype=np.int32), np.full(m, i if root is None else root)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shingle", "doc_id", "n", "root"])

    return docs.select("doc_id", "text", "root").mapInArrow(run, "shingle long, doc_id long, n int, root long")


#: Rows of one shingle from which on they are paired by root.
_MANY = 64


def _meetings(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    """[u, v, size of u, size of v] of rows of whole shingles, sorted by shingle and n, that are of different roots and whose sizes allow the similarity."""
    shingle, ids, n, root = rows
    start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
    size = np.diff(np.append(start, len(shingle)))
    mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
    few = np.repeat(mixed & (size < _MANY), size)
    s, i_, n_, r_ = (x[few] for x in rows)
    i = np.arange(len(i_))
    for d in range(1, len(i_)):
        i = i[i + d < len(i_)]
        i = i[(s[i] == s[i + d]) & (5 * n_[i] >= 4 * n_[i + d])]
        if not len(i):
            break
        x = i[r_[i] != r_[i + d]]
        y = x + d
        yield np.stack([i_[x], i_[y], n_[x], n_[y]])
    for k in np.flatnonzero(mixed & (size >= _MANY)).tolist():
        i_, n_, r_ = (x[start[k] : start[k] + size[k]] for x in (ids, n, root))
        _, at, many = np.unique(r_, return_inverse=True, return_counts=True)
        # rows of the commonest root only meet others; each of the others meets that root, and those after itself
        other = at != many.argmax()
        for x in np.flatnonzero(other).tolist():
            y = np.flatnonzero((~other | (np.arange(len(r_)) > x)) & (r_ != r_[x]) & (5 * np.minimum(n_, n_[x]) >= 4 * np.maximum(n_, n_[x])))
            yield np.stack([np.full(len(y), i_[x]), i_[y], np.full(len(y), n_[x]), n_[y]])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of prefixes sorted by shingle and n to pairs (u, v, a, b, c), u < v, of a and b shingles that share c here; only the rows of one shingle are held."""

    def rows() -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            x = [c.to_numpy() for c in b.columns]
            if not len(x[0]):
                continue
            other = np.flatnonzero(x[0] != x[0][-1])
            k = other[-1] + 1 if len(other) else 0
            if k or held and held[-1][0][-1] != x[0][0]:
                yield [np.concatenate(c) for c in zip(*held, [c[:k] for c in x])]
                held = []
            held.append([c[k:] for c in x])
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def out() -> pa.RecordBatch:
        x = np.concatenate(found, axis=1).astype(np.int64)
        x = np.where(x[0] < x[1], x, x[[1, 0, 3, 2]])
        order = np.lexsort((x[1], x[0]))
        x = x[:, order[x[0, order] != x[1, order]]]
        first = np.flatnonzero(np.concatenate([[True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)])) if x.size else np.zeros(0, int)
        counts = np.diff(np.append(first, x.shape[1]))
        return pa.RecordBatch.from_arrays([*map(pa.array, x[:, first]), pa.array(counts.astype(np.int64))], names=["u", "v", "a", "b", "c"])

    found, many = [], 0
    for some in rows():
        for pairs in _meetings(some):
            if pairs.size:
                found.append(pairs)
                many += pairs.shape[1]
            if many >= _PAIRS:
                yield out()
                found, many = [], 0
    if found:
        yield out()


def candidates(docs: DataFrame, sampled: DataFrame, n: int) -> DataFrame:
    """(u, v), u < v: documents of different roots whose sets can be similar, by what their prefixes share.

    docs has doc_id, text and root (null: the document itself). The set whose prefix ends first in the order shares no more
    there than the prefixes do (c), and after its prefix no more than the ceil(4a/5) - 1 shingles that are left. Which set
    that is isn't known: the larger rest counts.
    """
    met = prefixes(docs, sampled, n).repartition("shingle").sortWithinPartitions("shingle", "n").mapInArrow(_meet, "u long, v long, a long, b long, c long")
    shared = met.groupBy("u", "v", "a", "b").agg(F.sum("c").alias("c"))
    return shared.where("9 * (c + (4 * greatest(a, b) + 4) div 5 - 1) >= 4 * (a + b)").select("u", "v").distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar, by their whole sets. Many pairs may have one v, whose set is then made once for all that lie together."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for b in batches:
            ok = []
            for at in range(0, b.num_rows, SLICE_ROWS):
                xs, ys = (b.column(c).slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist() for c in (2, 3))
                for s, y in zip(shingles_of(xs), ys):
                    if y != last[0]:
                        last = (y, shingles(y))
                    ok.append(bool(len(s)) and bool(similar(len(np.intersect1d(s, last[1], assume_unique=True)), len(s), len(last[1]))))
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    own = with_ids(docs.select("doc_id", "text"), pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    both = pairs.join(own.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(own.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(check, "u long, v long")
