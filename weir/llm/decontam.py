"""Benchmark decontamination by a broadcast set of test n-grams.

Windows of 13 normalised benchmark words (a shorter item is one window) are
kept as a sorted set of hashes with their exact words. Each document is scanned
once; hashed hits are verified word by word, so no hit is a collision.

The benchmark goes out in blocks of at most BLOCK_WORDS words; beyond one block
the scan is chained, each block adding its hits to the row, without a shuffle.

Null and empty texts have no words and are clean. Items without words are left
out; repeated items count once. Rows that repeat are kept. An empty benchmark
leaves all clean. Extra columns are passed on by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 13
#: Words of the benchmark in one broadcast block.
BLOCK_WORDS = 1_000_000
#: A document is contaminated from this share of hit words on, as 1 in so many.
SHARE = 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(1, WINDOW + 1)], dtype=np.uint64)


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Windows:
    """The windows of one block of the benchmark."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]]):
        self.ids: dict[bytes, int] = {}
        exact: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text)]
            for at in range(max(1, len(w) - WINDOW + 1) if w else 0):
                exact.setdefault(tuple(w[at : at + WINDOW]), set()).update([] if item is None else [str(item)])
        self.exact = {k: sorted(v) for k, v in exact.items()}
        self.hashes = {n: np.unique(self._hash(np.array([k for k in self.exact if len(k) == n], dtype=np.uint64))) for n in {len(k) for k in self.exact}}

    @staticmethod
    def _hash(ids: np.ndarray) -> np.ndarray:
        return (ids * _ODD[: ids.shape[1]]).sum(axis=1, dtype=np.uint64)

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and by which items."""
        hit, items = np.zeros(len(ws), dtype=bool), set()
        ids = np.fromiter(map(self.ids.get, ws, repeat(0)), dtype=np.uint64, count=len(ws))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, hashes in self.hashes.items():
            if len(ws) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            for k in range(0, len(at), 65536):
                some = at[k : k + 65536]
                h = self._hash(ids[some[:, None] + np.arange(n)])
                near = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
                for s in some[near].tolist():
                    found = self.exact.get(tuple(ids[s : s + n].tolist()))
                    if found is not None:
                        hit[s : s + n] = True
                        items.update(found)
        return hit, items


def blocks(benchmark: DataFrame) -> Iterator[Windows]:
    """The benchmark as windows, at most BLOCK_WORDS words (or one item) each."""
    some, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("binary").alias("t")).where("text IS NOT NULL").distinct().toLocalIterator():
        some.append((r["item_id"], bytes(r["t"])))
        size += len(words(some[-1][1]))
        if size >= BLOCK_WORDS:
            yield Windows(some)
            some, size = [], 0
    if some or not size:
        yield Windows(some)


def _scanned(docs: DataFrame, benchmark: DataFrame, last: Callable[[pa.RecordBatch, list[np.ndarray], list[list[str]]], pa.RecordBatch], schema) -> DataFrame:
    """last(rows, hit words, items) of every slice of docs, after all blocks; earlier blocks add two columns to the rows."""
    n, text_at = len(docs.columns), docs.columns.index("text")
    extra = [f"{x}_{k}" for k in range(n + 1) for x in ("hits", "items")]
    names = [x for x in extra if x.lower() not in {c.lower() for c in docs.columns}][:2]
    carried = T.StructType([*docs.schema.fields, T.StructField(names[0], T.BinaryType()), T.StructField(names[1], T.ArrayType(T.StringType()))])
    out, ahead = docs, iter(blocks(benchmark))
    block, first = next(ahead), True
    while block is not None:
        after = next(ahead, None)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, final=after is None) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for whole in batches:
                for k in range(0, whole.num_rows, 256):
                    batch = whole.slice(k, 256)
                    hits, items = [], []
                    for i, text in enumerate(batch.column(text_at).cast(pa.binary())):
                        hit, found = index.scan(words(text.as_py()))
                        if not first:
                            hit |= np.frombuffer(batch.column(n)[i].as_py(), dtype=bool)
                            found |= set(batch.column(n + 1)[i].as_py())
                        hits.append(hit)
                        items.append(sorted(found))
                    own = pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n])
                    if final:
                        yield last(own, hits, items)
                    else:
                        yield pa.RecordBatch.from_arrays([*own.columns, pa.array([h.tobytes() for h in hits], pa.binary()), pa.array(items, pa.list_(pa.string()))], names=carried.names)

        out = out.mapInArrow(run, schema if after is None else carried)
        block, first = after, False
    return out


def _contaminated(hit: np.ndarray) -> bool:
    k = int(hit.sum())
    return k > 0 and SHARE * k >= len(hit)


def op9_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: its words, hit words, items and verdict."""

    def last(b: pa.RecordBatch, hits: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        cols = [b.column(0), pa.array([len(h) for h in hits], pa.int64()), pa.array([int(h.sum()) for h in hits], pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array(map(_contaminated, hits), pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _scanned(docs.select("doc_id", "text"), benchmark, last, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_spans(text: bytes, hit: np.ndarray) -> bytes:
    """text without its runs of hit words, from the first word's start to the last one's end."""
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, done = [], 0
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join(out) + text[done:]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated documents; of the others, hit spans are cut out of text.

    All columns of docs are kept; no other column changes.
    """
    text_at = docs.columns.index("text")

    def last(b: pa.RecordBatch, hits: list[np.ndarray], items: list[list[str]]) -> pa.RecordBatch:
        keep = [not _contaminated(h) for h in hits]
        texts = [without_spans(t.as_py().encode(), h).decode() if k and h.any() else t.as_py() for t, h, k in zip(b.column(text_at), hits, keep)]
        cols = list(b.columns)
        cols[text_at] = pa.array(texts, cols[text_at].type)
        return pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scanned(docs, benchmark, last, docs.schema)
