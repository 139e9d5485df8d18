import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weir.llm import common, neardup, simhash


def brute(texts):
    """doc_id to component, by comparing all pairs of fingerprints."""
    fp = {i: slow_fingerprint(t) for i, t in texts}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fp), 2):
        if bin(fp[a] ^ fp[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def slow_fingerprint(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def documents():
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 60))) for _ in range(60)]
    out = list(base)
    for b in base:
        w = b.split()
        for _ in range(3):
            v = list(w)
            if v:
                v[r.randrange(len(v))] = "zz"
            out.append(" ".join(v))
    out += base[:20] + [None, "", " \t\n", "One", "one", "ONE two", "É é"]
    return list(enumerate(out))


def test_against_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("hot", [1, 3, 10**9])
def test_hot_buckets_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(2)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), k)) for s in seeds for k in (0, 1, 1, 2, 2, 3, 4)}
    signed = [simhash._signed(f) for f in fps]
    df = common.cut(spark.createDataFrame([(f,) for f in signed], "fp long"))
    comp = {x.node: x.root for x in common.connected_components(simhash.links(df)).collect()}
    root = {f: f for f in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(signed), 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {f: comp.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_allocation_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    fps = rng.integers(-(1 << 62), 1 << 62, 500)
    bits = simhash._bits(fps).astype(float)
    for m in (2, 3, 4):
        groups = simhash.partitions(500, bits.T @ bits, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        tables = simhash.costs(groups, [np.full(1 << min(10, len(g)), 0.5) for g in groups], 500, bits.T @ bits)
        t = simhash.allocate(fps, groups, tables)
        assert (t.sum(axis=1) == simhash.TAU - m + 1).all() and t.min() >= -1


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a b c d e", 1), (1, "a b c d e", 2), (2, "x y z", 3), (None, "a b c d e", 4)], "doc_id long, text string, component_id int")
    assert sorted(r.component_id for r in neardup.keep_first(df).collect()) == [2, 3, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.op1_simhash(df).count() == 0 and neardup.keep_first(df).count() == 0


def test_components_of_chains(spark):
    e = spark.range(50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = common.connected_components(e.union(spark.createDataFrame([(100, 101), (None, 5)], "u long, v long"))).collect()
    assert {r.root for r in got if r.node <= 50} == {0} and {r.root for r in got if r.node > 50} == {100}


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_without_ids(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "LEAST_BITS", bits)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    df = spark.range(1000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "id AS w", "id AS bits").repartition(3)
    ids = spark.range(0, 1000, 3).select(F.col("id").alias("doc_id"))
    got = common.without_ids(df, ids)
    assert got.columns == df.columns
    assert sorted(r.w for r in got.collect()) == [i for i in range(1000) if i % 3 or i == 7]


def roots_of(fps, pairs):
    root = {f: f for f in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {f: find(f) for f in fps}


def near_pairs(fps):
    a = np.array(fps, dtype=np.int64).view(np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2):
            yield fps[i], fps[i + 1 + int(j)]


def crowd(n, same, seed):
    """Distinct fingerprints that share some bits: in the partitions of those bits all are one bucket."""
    r = random.Random(seed)
    free = [b for b in range(64) if b not in same]
    out = set()
    while len(out) < n:
        x = sum(1 << b for b in free if r.random() < 0.5)
        out.add(x - (1 << 64) if x >> 63 else x)
        if r.random() < 0.2:
            y = x ^ (1 << r.choice(free)) ^ (1 << r.choice(free))
            out.add(y - (1 << 64) if y >> 63 else y)
    return sorted(out)


@pytest.mark.parametrize("shared", [range(20), range(44), range(8, 60)])
def test_crowded_buckets_against_brute_force(spark, shared):
    """Thousands of fingerprints in one bucket of one or several partitions: more than HOT, by the linear way."""
    fps = crowd(2500 if len(shared) < 50 else 1000, set(shared), len(shared))
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)).collect()
    assert all(bin((u ^ v) & (1 << 64) - 1).count("1") <= 4 for u, v in got)
    assert roots_of(fps, [(r.u, r.v) for r in got]) == roots_of(fps, near_pairs(fps))


def test_unequal_thresholds_on_skewed_bits(spark):
    """Where a group of bits says nothing, it gets the threshold -1, and fewer candidates are met than with equal thresholds."""
    fps = crowd(3000, set(range(16)), 5)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    groups, tables = simhash.plan(df)
    a = np.array(fps, dtype=np.int64)
    t = simhash.allocate(a, groups, tables)
    assert (t.sum(axis=1) == simhash.TAU - len(groups) + 1).all() and len({tuple(x) for x in t.tolist()}) >= 1
    assert (t.min(axis=1) < t.max(axis=1)).mean() > 0.9
    met = {}
    for i, g in enumerate(groups):
        v = a.view(np.uint64) & np.uint64(sum(1 << b for b in g))
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        met[i] = n[at]
    dealt = sum(met[i][t[:, i] >= 0].sum() for i in met)
    flat = sum(met[i].sum() for i in met)
    assert dealt < 0.5 * flat


@pytest.mark.parametrize("spokes", [5, 4000])
def test_hub_of_edges(spark, spokes):
    edges = [(0, k) for k in range(1, spokes)] + [(10**6 + k, 10**6 + k + 1) for k in range(30)] + [(7, None), (8, 8)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, spokes)} | {10**6 + k + 1: 10**6 for k in range(30)}


def test_very_long_text_and_extra_columns(spark):
    long = "lorem ipsum dolor " * 60_000
    df = spark.createDataFrame([(1, long, 5, "x"), (2, long.upper(), 6, "y"), (None, "a", 7, "z"), (3, "é" * 300_000, 8, "n")], "doc_id long, text string, component_id int, v string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(df).collect()}
    assert got[1] == got[2] == (f"{slow_fingerprint(long):016x}", 1) and set(got) == {1, 2, 3, None}
