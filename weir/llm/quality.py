"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its bytes (unigram
and hashed bigram counts, then a learned layer), a gated attention network
weighs the passages, and a logistic layer scores their weighted mean. Labels are
of documents only; the weights of passages are learnt from them.

A null or empty text is one empty passage and is scored like any other. Without
labels of both kinds the score is the share of label 1 (0.5 without any). Rows
that repeat are scored alike; an empty table gives an empty result; contrary
labels of one document are all learnt. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import held_out, per_document

#: Bounds of the sample of labelled rows on which the model is fitted: rows, and bytes of their texts in all.
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 96 << 20
#: Bytes of a passage; a last passage of under half of it joins the one before.
PASSAGE_BYTES = 512
BIGRAMS = 256
DIM = 256 + BIGRAMS
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.004, 1e-4
#: Passages encoded at once when scoring.
BLOCK = 2048
THRESHOLD = 0.7


def encode(text: bytes | None) -> Iterator[np.ndarray]:
    """Counts [passage, DIM] of bytes and hashed bigrams, as square roots of shares, in blocks."""
    b = np.frombuffer(text or b"", np.uint8)
    n = max(1, (len(b) + PASSAGE_BYTES // 2 - 1) // PASSAGE_BYTES)
    for first in range(0, n, BLOCK):
        k = min(BLOCK, n - first)
        part = b[first * PASSAGE_BYTES : None if first + k == n else (first + k) * PASSAGE_BYTES]
        at = np.minimum(np.arange(len(part)) // PASSAGE_BYTES, k - 1) * DIM
        x = np.bincount(at + part, minlength=k * DIM).reshape(k, DIM).astype(np.float32)
        if len(part) > 1:
            two = (part[:-1].astype(np.int64) * 31 + part[1:] * 17) % BIGRAMS
            x += np.bincount(at[1:] + 256 + two, minlength=k * DIM).reshape(k, DIM)
        yield np.sqrt(x / np.maximum(x[:, :256].sum(axis=1, keepdims=True), 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights of the encoder (W, b), the gated attention (V, U, w) and the classifier (c, d)."""

    def __init__(self, rng: np.random.Generator, bias: float):
        self.p = {
            "W": rng.normal(0, 0.1, (DIM, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, GATE)), "U": rng.normal(0, 0.2, (HIDDEN, GATE)),
            "w": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.1, HIDDEN), "d": np.array([bias]),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, v, u, (v * u) @ p["w"]

    def score(self, text: bytes | None) -> float:
        """Score of a whole text; blocks of passages are merged as a running soft maximum."""
        top, mass, mean = -np.inf, 0.0, np.zeros(HIDDEN, np.float64)
        for x in encode(text):
            h, _, _, s = self.attend(x)
            new = max(top, float(s.max()))
            e = np.exp(s - new)
            scale = np.exp(top - new)
            mass, mean, top = mass * scale + float(e.sum()), mean * scale + e @ h, new
        return float(_sigmoid(mean / mass @ self.p["c"] + self.p["d"][0]))

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags; bag k has the passages from starts[k] on."""
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        bag = np.repeat(np.arange(len(starts)), sizes)
        h, v, u, s = self.attend(x)
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        dl = ((_sigmoid(z @ p["c"] + p["d"][0]) - y) / len(y)).astype(np.float32)
        dz = dl[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dg = ds[:, None] * p["w"]
        dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ ds, "c": z.T @ dl, "d": np.array([dl.sum()])}


def fit(bags: list[np.ndarray], labels: list[int]) -> Model | float:
    """A model, or the constant score where there is only one kind of label."""
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(6)
    share = float(y.mean())
    model = Model(rng, np.log(share / (1 - share)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, steps = 0, EPOCHS * -(-len(bags) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            sizes = [len(bags[k]) for k in own]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            g = model.gradients(np.concatenate([bags[k] for k in own]).astype(np.float32), starts, y[own])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, v in model.p.items():
                d = g[k].astype(np.float32) + DECAY * v * (k not in ("b", "d"))
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                v -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """Fits on whole texts, every passage of them, of labelled rows that aren't held out.

    The rows are drawn by the hash of doc_id over all such rows, repeated ones once: as many of the first SAMPLE_DOCS
    as have SAMPLE_BYTES in all. Only their keys and sizes, then their texts, reach the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    drawn = known.orderBy(F.xxhash64("doc_id"), "quality").limit(SAMPLE_DOCS)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "quality", "h", F.octet_length("text").alias("n")).distinct()
    own, left = [], SAMPLE_BYTES
    for r in sizes.orderBy(F.xxhash64("doc_id"), "quality", "h", "n").limit(SAMPLE_DOCS).collect():
        left -= r["n"]
        if left < 0:
            break
        own.append((r["doc_id"], r["quality"], r["h"]))
    if not own:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(sorted({(i, h) for i, _, h in own}), "doc_id long, h long")
    got = texts.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    text = {(r["doc_id"], r["h"]): r["text"].encode() for r in got.collect()}
    return fit([np.concatenate(list(encode(text[i, h]))).astype(np.float16) for i, _, h in own], [q for _, q, _ in own])


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(rows: list) -> list[tuple]:
        model = shared.value
        scores = [model if isinstance(model, float) else model.score(t) for _, t in rows]
        return [(r[0], s, int(s >= THRESHOLD)) for r, s in zip(rows, scores)]

    scored = per_document(docs, run, ["doc_id", "text"], "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
