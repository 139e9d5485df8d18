"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are grouped once (copies never meet each other), the 64 bits are
split into partitions of correlated bits, and each fingerprint allots its own
threshold to each partition by dynamic programming over estimated candidate
counts, so that the thresholds sum to ``tau - partitions + 1``. A link within
``tau`` bits must then show in some partition within that partition's
threshold; probes are verified on all 64 bits.

Buckets above HOT fingerprints are not paired: their members and probers go
through an exact linear way, as two fingerprints differ in at most two bits
just when their radius-1 balls meet (65 keys each, at most 65 members a key).

Nulls and texts without words have fingerprint zero and link like any other;
repeated rows are kept; an empty table gives an empty result; extra columns of
the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import connected_components, cut, per_document, spread_join

TAU = 2
#: Fingerprints in one bucket beyond which it takes the linear way.
HOT = 256
#: Bits of the histogram on which candidate counts are estimated.
CELL_BITS = 10
_SEED = 42


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of a text's 3-word shingles, as a signed integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    return majority(np.array([digest(s, _SEED) for s in shingles], dtype=np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that over half of some hashes have, as a signed integer; 0 for none."""
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):  # long texts in bounded memory
        bits += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    return per_document(docs, lambda rows: [(i, fingerprint(t)) for i, t in rows], ["doc_id", "text"], "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and the 64 x 64 matrix of bits set together.

    One matrix a task is summed by Spark; 4,096 numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        n = 0
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            total += x.T @ x
            n += len(x)
        flat = np.append(total.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(flat)], names=["k", "c"])

    rows = fps.select("fp").mapInArrow(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect()
    flat = np.zeros(4097)
    for k, c in rows:
        flat[k] = c
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, correlated bits together, most balanced bit first in each."""
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for i in range(m):
        size = len(left) // (m - i)
        first = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group, key=lambda b: (abs(p[b] - 0.5), b)))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def histograms(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each partition, counts over the values of its first CELL_BITS bits."""
    cells = []
    for i, g in enumerate(groups):
        code = F.lit(0).cast("long")
        for k, b in enumerate(g[:CELL_BITS]):
            code = code.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), k))
        cells.append(F.struct(F.lit(i).alias("i"), code.alias("c")))
    out = [np.zeros(1 << min(CELL_BITS, len(g))) for g in groups]
    for i, c, n in fps.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.i", "x.c").count().collect():
        out[i][c] = n
    return out


def costs(groups: list[list[int]], hists: list[np.ndarray], n: int, both: np.ndarray) -> list[np.ndarray]:
    """Per partition: estimated cost [cell, threshold + 1] of probing, thresholds -1 to TAU."""
    p = both.diagonal() / max(n, 1)
    agree = np.clip(p**2 + (1 - p) ** 2, 0.5, 1 - 1e-9)
    tables = []
    for g, h in zip(groups, hists):
        c = min(CELL_BITS, len(g))
        rest = agree[g[c:]]
        ratio = (1 - rest) / rest
        e = [1.0, ratio.sum(), (ratio.sum() ** 2 - (ratio**2).sum()) / 2]
        at = np.arange(len(h))
        near = [h, sum((h[at ^ (1 << j)] for j in range(c)), np.zeros(len(h))), sum((h[at ^ (1 << j) ^ (1 << k)] for j, k in itertools.combinations(range(c), 2)), np.zeros(len(h)))]
        base, w = rest.prod(), len(g)
        shells = [base * sum(near[a] * e[r - a] for a in range(r + 1)) for r in range(TAU + 1)]
        sizes = [1, w, w * (w - 1) // 2]
        table = np.zeros((len(h), TAU + 2))
        for t in range(TAU + 1):
            table[:, t + 1] = table[:, t] + shells[t] + sizes[t]
        tables.append(table)
    return tables


def allocate(fps: np.ndarray, groups: list[list[int]], tables: list[np.ndarray]) -> np.ndarray:
    """Thresholds [fingerprint, partition], the cheapest that sum to TAU - m + 1, by dynamic programming."""
    m, n = len(groups), len(fps)
    bits = _bits(fps).astype(np.int64)
    top = TAU + 1  # thresholds are kept as 0..top for -1..TAU; the total is then TAU + 1
    best = np.full((n, top + 1), np.inf)
    best[:, 0] = 0
    choice = []
    for g, table in zip(groups, tables):
        c = min(CELL_BITS, len(g))
        cell = bits[:, g[:c]] @ (1 << np.arange(c))
        cost = table[cell]
        new, pick = np.full((n, top + 1), np.inf), np.zeros((n, top + 1), dtype=np.int8)
        for s in range(top + 1):
            for t in range(s + 1):
                x = best[:, s - t] + cost[:, t]
                better = x < new[:, s]
                new[better, s] = x[better]
                pick[better, s] = t
        best = new
        choice.append(pick)
    out, s = np.zeros((n, m), dtype=np.int64), np.full(n, top)
    for i in range(m - 1, -1, -1):
        out[:, i] = choice[i][np.arange(n), s]
        s = s - out[:, i]
    return out - 1


def probes(fps: DataFrame, groups: list[list[int]], tables: list[np.ndarray]) -> DataFrame:
    """(part, v, fp): the partition values that each fingerprint has to look up."""
    masks = [np.uint64(_mask(g)) for g in groups]
    flips = []
    for g in groups:
        one = [1 << b for b in g]
        two = [a | b for a, b in itertools.combinations(one, 2)]
        flips.append([np.array(x, dtype=np.uint64) for x in ([0], one, two)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                f = batch.column(0).slice(at, 2048).to_numpy()
                t = allocate(f, groups, tables)
                for i in range(len(groups)):
                    for r in range(TAU + 1):
                        own = f[t[:, i] >= r]
                        if len(own):
                            v = ((own.view(np.uint64) & masks[i])[:, None] ^ flips[i][r][None, :]).ravel().view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, dtype=np.int32)), pa.array(v), pa.array(np.repeat(own, len(flips[i][r])))], names=["part", "v", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, v long, fp long")


def plan(fps: DataFrame) -> tuple[list[list[int]], list[np.ndarray]]:
    """The partitions and cost tables that are cheapest for these fingerprints, of 2 to 4 partitions."""
    n, both = bit_statistics(fps)
    found, splits = [], [partitions(n, both, m) for m in (2, 3, 4)]
    counted = iter(histograms(fps, [g for groups in splits for g in groups]))
    for groups in splits:
        m, hists = len(groups), [next(counted) for _ in groups]
        tables = costs(groups, hists, n, both)
        # thresholds are allotted for each cell alone; the mean over fingerprints is what a probe costs
        mean = [(h[:, None] * t).sum(axis=0) / max(n, 1) for h, t in zip(hists, tables)]
        cost = min(sum(mean[i][t] for i, t in enumerate(a)) for a in itertools.product(range(TAU + 2), repeat=m) if sum(a) == TAU + 1)
        found.append((cost, m, groups, tables))
    _, _, groups, tables = min(found, key=lambda x: x[:2])
    return groups, tables


def links(fps: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints, enough to connect all within TAU bits."""
    groups, tables = plan(fps)
    index = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("v")) for i, g in enumerate(groups)])).alias("x"), "fp").select("x.part", "x.v", "fp")
    probe = probes(fps, groups, tables)
    hot = cut(index.groupBy("part", "v").count().where(F.col("count") > HOT).select("part", "v"))
    cold, ask = index, probe
    dense = None
    if not hot.isEmpty():
        cold = index.join(hot, ["part", "v"], "left_anti")
        dense = index.join(hot, ["part", "v"], "left_semi").select("fp").union(probe.join(hot, ["part", "v"], "left_semi").select("fp")).distinct()
    pairs = (
        ask.withColumnRenamed("fp", "u")
        .join(cold.withColumnRenamed("fp", "v2"), ["part", "v"])
        .where((F.col("v2") < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v2"))) <= TAU))
        .select("u", F.col("v2").alias("v"))
    )
    if dense is not None:
        near = dense.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])).alias("key"))
        least = near.groupBy("key").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        pairs = pairs.union(near.join(least, "key").where("fp <> v").select(F.col("fp").alias("u"), "v"))
    return pairs


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    docs_fp = cut(fingerprints(docs))
    fps = cut(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    comp = connected_components(links(fps))
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    # only fingerprints in components of their own kind need the smallest id of others
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = rooted.join(least, "root").select("fp", "n", "component_id")
    return spread_join(docs_fp, table, "fp")


def op1_simhash(docs: DataFrame) -> DataFrame:
    out = simhash_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

