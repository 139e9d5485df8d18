"""N-best encoding with a SentencePiece vocabulary, and decoding.

The pieces that match a text form a lattice. A forward pass gives the best score
from the start to each place. That score is the exact remaining cost of an A*
search from the end, so the search yields the best segmentations in order, and
a state that is met tells at once what the whole path through it loses.

No piece crosses from a word into the blank after it or holds a line feed, so
the lattice falls apart at those places (checked when a vocabulary is loaded).
Forward passes of many short parts run together, as arrays; the best path and
the loss of the first step off it are remembered by part. Only the n - 1 parts
of a text where a step off the best path loses least can be in its n best
segmentations, so only those are searched; their alternatives are merged to
those of the text. Characters outside of the vocabulary, and a literal U+2581,
become bytes, so that decoding gives back any text.

The vocabulary's scores are taken as they are; those of a BPE model are its
merge ranks, so segmentations are the best by rank, not those that merging gives.

A null text is encoded as an empty one: no pieces. Rows that repeat are kept;
an empty table gives an empty result; extra columns are kept by ``with_pieces``.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weir.llm.common import SLICE_ROWS, per_document

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What pieces have for a blank.
BLANK = "▁"
#: Segmentations of each text that the query tells.
NBEST = 4
#: Bytes of the parts that a worker remembers; the younger half outlives the older one.
REMEMBERED_BYTES = 96 << 20
#: Longer parts are searched one by one and aren't remembered.
SHORT = 64
#: Scores of pieces, by length and place, in one array of parts: 8 bytes each, and some 12 with what goes along.
ARRAY_CELLS = 1 << 18
#: Score of a character that takes bytes, below that of the worst piece.
BYTES_PENALTY = 10.0
#: Scores at or under this mark runs of blanks, which merges never reach; they get a score just below the worst piece.
UNUSED = -1e8
BLANKS_PENALTY = 5.0

_PART = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_NONE, _INF = float("-inf"), float("inf")
#: No character.
_PAD = 0x1FFFFF

#: (best score, what the first step off the best path loses, ids of the best as 32-bit numbers, the n best if searched already)
Part = tuple[float, float, bytes, list | None]


class _Trie:
    """Steps (node, character) to nodes, in an open-addressed table that arrays are looked up in."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        steps: dict[tuple[int, int], int] = {}
        self.ids, self.scores = [-1], [_NONE]
        for p, (i, s) in pieces.items():
            node = 0
            for c in p:
                node = steps.setdefault((node, ord(c)), len(self.ids))
                if node == len(self.ids):
                    self.ids.append(-1)
                    self.scores.append(_NONE)
            self.ids[node], self.scores[node] = i, s
        self.ids, self.scores = np.array(self.ids, np.int32), np.array(self.scores)
        self.bits = max(8, (4 * len(steps)).bit_length())
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys = np.array([(a << 21) | c for a, c in steps], np.int64)
        for k, slot, node in zip(keys.tolist(), self._slot(keys).tolist(), steps.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.nodes[slot] = k, node

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node after each step, -1 where there is none."""
        keys = (nodes.astype(np.int64) << 21) | chars
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.nodes[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


class Vocabulary:
    """Pieces with ids and scores, and the byte pieces."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        floor = min(s for _, _, s in pieces if s > UNUSED)
        # a blank in the keys, so that texts are searched as they are and a literal U+2581 is in no piece
        self.pieces = {p.replace(BLANK, " "): (i, s if s > UNUSED else floor - BLANKS_PENALTY) for p, i, s in pieces}
        self.byte_ids = byte_ids
        self.longest = max(map(len, self.pieces))
        # all ends of pieces; those that are no piece themselves have nothing
        self.ends: dict[str, tuple] = {p[k:]: () for p in self.pieces for k in range(1, len(p))} | self.pieces
        bad = [p for p in self.pieces if " " in p.lstrip(" ") or (len(p) > 1 and "\n" in p)]
        if bad:
            raise ValueError(f"pieces cross words, so texts can't be encoded by parts: {bad[:5]}")
        self.worst = floor - BYTES_PENALTY
        self.bytes_of = {i: p.replace(BLANK, " ").encode() for p, i, _ in pieces} | {i: bytes((b,)) for b, i in enumerate(byte_ids)}
        self.trie = _Trie(self.pieces)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, Part] = {}
        self._older: dict[str, Part] = {}
        self._size = 0

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_older": {}, "_size": 0}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [i for i in range(n) if sp.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces, so texts can't be kept whole")
        return cls([(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))], byte_ids)

    def edges(self, part: str, at: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(from, score, ids) of the pieces that end at a place, the longest first."""
        out, get, start = [], self.ends.get, at
        while start:
            start -= 1
            x = get(part[start:at])
            if x:
                out.append((start, x[1], (x[0],)))
            elif x is None:
                break
        if not out or out[0][0] < at - 1:
            out.insert(0, (at - 1, self.worst, tuple(self.byte_ids[b] for b in part[at - 1].encode())))
        return out[::-1]

    def forward(self, part: str) -> list[float]:
        """The best score from the start to each place."""
        best, get, worst = [0.0], self.ends.get, self.worst
        for at in range(1, len(part) + 1):
            x = get(part[at - 1])
            top, start = best[-1] + (x[1] if x else worst), at - 1
            while start and x is not None:
                start -= 1
                x = get(part[start:at])
                if x and best[start] + x[1] > top:
                    top = best[start] + x[1]
            best.append(top)
        return best

    def search(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first, by A* from the end; of equal ones the one with the longer last pieces first.

        As the heuristic is exact, a state that is taken from the queue leads to the start without loss; steps
        off that way are queued with what they lose, unless n - 1 others that lose less are known.
        """
        best = self.forward(part)
        met, bound = itertools.count(), [_INF] * (n - 1)  # the least losses, as a sorted list
        queue: list[tuple] = [(0.0, next(met), len(part), None)]
        out: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(out) < n:
            loss, _, at, path = heapq.heappop(queue)
            while at:
                edges = self.edges(part, at)
                values = [best[e[0]] + e[1] for e in edges]
                taken = values.index(best[at])
                for k, (start, _, ids) in enumerate(edges):
                    off = loss + best[at] - values[k]
                    if k != taken and bound and off < bound[-1]:
                        bound.insert(next(i for i, b in enumerate(bound) if off < b), off)
                        bound.pop()
                        heapq.heappush(queue, (off, next(met), start, (ids, path)))
                at, path = edges[taken][0], (edges[taken][2], path)
            ids = []
            while path is not None:
                ids.extend(path[0])
                path = path[1]
            out.append((best[-1] - loss, tuple(ids)))
        return out

    def _together(self, parts: list[str]) -> Iterator[Part]:
        """The parts, of SHORT characters at most, by one forward pass over arrays [place, part]."""
        m, size = len(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        w = int(size.max())
        chars = np.frombuffer("".join([p.ljust(w, "\0") for p in parts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(m, w).T.copy()
        chars[np.arange(w)[:, None] >= size] = _PAD
        top = min(self.longest, w)
        score, ids = np.full((top, w, m), _NONE), np.full((top, w * m), -1, np.int32)
        flat, own = chars.ravel(), score.reshape(top, w * m)
        at = np.flatnonzero(flat != _PAD)
        node = np.zeros(len(at), np.int64)
        for k in range(top):
            there = at + k * m < w * m
            at, node = at[there], node[there]
            node = self.trie.step(node, flat[at + k * m])
            at, node = at[node >= 0], node[node >= 0]
            own[k, at], ids[k, at] = self.trie.scores[node], self.trie.ids[node]
        score[0][score[0] == _NONE] = self.worst
        best, second, back = np.full((w + 1, m), _NONE), np.full((w + 1, m), _NONE), np.zeros((w + 1, m), np.int64)
        best[0] = 0
        for j in range(1, w + 1):
            for k in range(min(j, top), 0, -1):
                x = best[j - k] + score[k - 1, j - k]
                better = x > best[j]
                second[j] = np.maximum(second[j], np.where(better, best[j], x))
                best[j] = np.where(better, x, best[j])
                back[j][better] = k
        gap, here, cols = np.full(m, _INF), size.copy(), np.arange(m)
        used = np.full((m, w), -2, np.int32)
        while True:
            on = np.flatnonzero(here)
            if not len(on):
                break
            h, c = here[on], cols[on]
            gap[on] = np.minimum(gap[on], best[h, c] - second[h, c])
            k = back[h, c]
            here[on] = h - k
            used[c, h - k] = ids[k - 1, (h - k) * m + c]
        total, on = best[size, cols].tolist(), used > -2
        some, ends, raw = used[on], np.cumsum(on.sum(axis=1)).tolist(), (used == -1).any(axis=1)
        blob, start = some.astype("<i4").tobytes(), 0
        for i, (end, g) in enumerate(zip(ends, gap.tolist())):
            data = blob[4 * start : 4 * end]
            if raw[i]:
                out: list[int] = []
                for k, x in enumerate(used[i].tolist()):
                    if x >= 0:
                        out.append(x)
                    elif x == -1:
                        out.extend(self.byte_ids[b] for b in parts[i][k].encode())
                data = struct.pack(f"<{len(out)}i", *out)
            yield total[i], g, data, None
            start = end

    def learn(self, parts: set[str], n: int = 1) -> dict[str, Part]:
        """What is known of each part; what isn't yet is found, that of short parts in arrays."""
        out: dict[str, Part] = {}
        missing: list[str] = []
        for p in parts:
            x = self._known.get(p)
            if x is None:
                x = self._older.get(p)
                if x is None:
                    if len(p) <= SHORT:
                        missing.append(p)
                        continue
                    found = self.search(p, max(n, 2))
                    x = (found[0][0], found[0][0] - found[1][0] if len(found) > 1 else _INF, struct.pack(f"<{len(found[0][1])}i", *found[0][1]), found)
                else:
                    self._remember(p, x)
            out[p] = x
        missing.sort(key=len)
        at = 0
        while at < len(missing):
            w = len(missing[min(len(missing), at + 4096) - 1])
            some = missing[at : at + max(1, ARRAY_CELLS // (w * min(w, self.longest)))][:4096]
            for p, x in zip(some, self._together(some)):
                out[p] = x
                self._remember(p, x)
            at += len(some)
        return out

    def _remember(self, part: str, x: Part) -> None:
        # a string of wide characters takes four bytes each; objects and the table's entry take some 300
        self._size += 4 * len(part) + len(x[2]) + 300
        if self._size > REMEMBERED_BYTES // 2:
            self._older, self._known, self._size = self._known, {}, 0
        self._known[part] = x

    @staticmethod
    def parts(text: str) -> list[str]:
        return _PART.findall(" " + text) if text else []

    def segmented(self, texts: list[str], n: int) -> Iterator[list[tuple[float, bytes]]]:
        """The n best (score, ids as 32-bit numbers) of each text, best first; fewer where there are no more."""
        split = [self.parts(t) for t in texts]
        known = self.learn(set(itertools.chain.from_iterable(split)), n)
        searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        for parts in split:
            rows = [known[p] for p in parts]
            ids = [r[2] for r in rows]
            score = sum(map(itemgetter(0), rows))
            out = [(score, b"".join(ids))]
            # choices are (loss, ((part, alternative), ...))
            kept: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
            for _, k in heapq.nsmallest(n - 1, ((r[1], k) for k, r in enumerate(rows) if r[1] < _INF)) if n > 1 else ():
                p = parts[k]
                if p not in searched:
                    searched[p] = rows[k][3] or self.search(p, n)
                ways = searched[p]
                kept = heapq.nsmallest(n, ((loss + ways[0][0] - s, pick + ((k, a),) if a else pick) for loss, pick in kept for a, (s, _) in enumerate(ways)), key=itemgetter(0))
            for loss, pick in kept[1:]:
                own = list(ids)
                for k, a in pick:
                    x = searched[parts[k]][a][1]
                    own[k] = struct.pack(f"<{len(x)}i", *x)
                out.append((score - loss, b"".join(own)))
            yield out

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, best first."""
        return [(s, np.frombuffer(b, "<i4").tolist()) for s, b in next(self.segmented([text], n))]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The text of ids, without the blank that encoding puts before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))[1:]


def op7_pieces(docs: DataFrame, model: str = MODEL, n: int = NBEST) -> DataFrame:
    """One row a document: of its n best segmentations the counts, scores and digests of ids, and whether decoding the best gives the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(rows: list) -> list[tuple]:
        v, out = shared.value, []
        texts = [(raw or b"").decode("utf-8", "replace") for _, raw in rows]
        for (i, raw), text, found in zip(rows, texts, v.segmented(texts, n)):
            back = v.decode(np.frombuffer(found[0][1], "<i4"))
            digests = [hashlib.sha256(b).hexdigest() for _, b in found]
            out.append((i, len(text), len(found[0][1]) // 4, digests[0], found[0][0], found[1][0] if len(found) > 1 else None, [s for s, _ in found], digests, hashlib.sha256(back).hexdigest(), back == (raw or b"")))
        return out

    schema = "doc_id long, n_chars long, n_pieces long, ids_sha256 string, best_score double, second_score double, nbest_scores array<double>, nbest_sha256 array<string>, decoded_sha256 string, round_trip boolean"
    return per_document(docs, run, ["doc_id", "text"], schema)


def with_pieces(docs: DataFrame, model: str = MODEL, n: int = 1) -> DataFrame:
    """docs with column pieces, the ids of each text's best segmentation, and for n over 1 nbest, those of the n best. Columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    added = ["pieces", "nbest"][: 1 + (n > 1)]
    kept = [c for c in docs.columns if c not in added]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(k, SLICE_ROWS)
                found = [[np.frombuffer(x, "<i4") for _, x in s] for s in v.segmented([t.as_py() or "" for t in b.column(at)], n)]
                one = pa.list_(pa.int32())
                cols = [pa.array([x[0] for x in found], one), pa.array(found, pa.list_(one))][: len(added)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *added])

    src = docs.select(*[f"`{c}`" for c in kept])
    ids = T.ArrayType(T.IntegerType())
    return src.mapInArrow(run, T.StructType([*src.schema.fields, *[T.StructField(c, t) for c, t in zip(added, (ids, T.ArrayType(ids)))]]))


def vocabulary(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(piece, id, score) of a model's usable pieces."""
    v = Vocabulary.load(model)
    return spark.createDataFrame([(p, i, s) for p, (i, s) in v.pieces.items()], "piece string, id int, score double")
