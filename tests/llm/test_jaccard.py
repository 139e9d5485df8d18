import itertools
import random

import numpy as np
import pytest

from weir.llm import jaccard, neardup


def slow_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(texts):
    """ids that stay, by comparing all pairs of sets."""
    s = {i: slow_set(t) for i, t in texts}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] == s[b] or 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [i for i in sorted(root) if find(i) == i]


def documents():
    r = random.Random(3)
    line = " ".join(f"licence{k}" for k in range(12))
    out = [None, "", " \t", "One two", "one TWO", "a b c d e"]
    for n in [3, 6, 8, 9, 10, 20, 40, 60, 120, 300] * 4:
        w = [f"w{r.randrange(400)}" for _ in range(n)]
        out.append(" ".join(w))
        for edits in (0, 1, 1, 2, 3, 5, 8, 14):
            v = list(w)
            for _ in range(edits):
                at = r.randrange(len(v))
                v[at : at + r.randint(0, 1)] = [f"e{r.randrange(9)}"]
            out.append(" ".join(v) + f" {line}" * (edits == 3))
    return list(enumerate(out))


@pytest.mark.parametrize("frequent", [0, 200_000])
def test_near_copies_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = documents()
    want = kept(docs)
    got = sorted(r.doc_id for r in neardup.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == want and len(want) < 0.8 * len(docs)


def test_edited_copy_goes_and_other_columns_stay(spark):
    w = [f"w{k}" for k in range(200)]
    edited = list(w)
    edited[20] = edited[90] = edited[150] = "x"
    df = spark.createDataFrame([(2, " ".join(edited), "b"), (1, " ".join(w), "a"), (None, " ".join(w), "n"), (3, " ".join(w[:120]), "c")], "doc_id long, text string, source string")
    assert sorted(r.source for r in neardup.keep_first(df).collect()) == ["a", "c", "n"]


def test_batches_cut_anywhere():
    import numpy as np
    import pyarrow as pa

    rows = sorted((s, n, i, root) for i, (s, n, root) in enumerate([(1, 10, 0), (2, 10, 1), (2, 11, 2), (2, 12, 3), (3, 10, 4), (5, 20, 5), (5, 21, 6), (5, 30, 7), (6, 9, 8), (6, 9, 8), (7, 9, 9), (7, 9, 9), (7, 9, 10)]))
    # of one root, or of sizes too far apart: no pair
    want = {(1, 2), (2, 3), (1, 3), (5, 6), (10, 12), (11, 12)}
    kinds = ((0, pa.int64()), (2, pa.int64()), (1, pa.int32()), (3, pa.int64()))
    for many in (2, 64):
        jaccard._MANY, was = many, jaccard._MANY
        for step in range(1, 16):
            parts = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + step]], t) for c, t in kinds], names=["shingle", "doc_id", "n", "root"]) for k in range(0, len(rows), step)]
            got = [tuple(map(int, x)) for b in jaccard._meet(iter(parts)) for x in np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]).T]
            assert sorted(got) == sorted(want)
        jaccard._MANY = was


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_groups_of_edited_copies_are_not_paired(spark, monkeypatch, rounds):
    """300 edits of one text: stars join them, so that hardly a pair is left, and the result is the same without stars."""
    r = random.Random(6)
    w = [f"w{k}" for k in range(100)]
    texts = [" ".join(w)]
    for _ in range(300):
        v = list(w)
        v[r.randrange(100)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(v))
    seen = []
    real = jaccard.candidates
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "candidates", lambda d, s, n: seen.append(real(d, s, n)) or seen[0])
    if not rounds:
        monkeypatch.setattr(neardup, "_fingerprint_links", lambda keys: keys.select(keys.doc_id.alias("u"), keys.doc_id.alias("v")).limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.doc_id for x in neardup.keep_first(docs).collect()] == [0]
    n = seen[0].count()
    assert n > 20_000 if not rounds else n < (2_000 if rounds == 2 else 15_000)


def test_empty_tables_and_awkward_rows(spark):
    schema = "doc_id long, text string, root string, n string"
    assert neardup.keep_first(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "a", "x"), (2, "", "b", "x"), (None, None, "c", "x"), (3, "w " * 200_000, "d", "x"), (3, "w " * 200_000, "e", "x"), (4, "W " * 150_000, "f", "x")]
    assert sorted(x.root for x in neardup.keep_first(spark.createDataFrame(rows, schema)).collect()) == ["a", "c", "d", "e"]


def test_shingles_of_many_texts_are_those_of_each(monkeypatch):
    r = random.Random(4)
    texts = [b" ".join(r.choice([b"a", b"B", b"\xe9\xff", b"q" * 65, b"Q" * 64, b"longer"]) for _ in range(r.randrange(12))) for _ in range(200)]
    texts += [None, b"", b" \n\t", b" x\x0by\x0cz\x1cu \rv w  ", b"x" * 5000 + b" a b c d e"]
    sets = []
    for t in texts:
        words = (t or b"").lower().split()
        sets.append({tuple(words[k : k + jaccard.SHINGLE]) for k in range(max(1, len(words) - jaccard.SHINGLE + 1))} if words else set())
    for chunk in (jaccard._CHUNK, 7):
        monkeypatch.setattr(jaccard, "_CHUNK", chunk)
        got = jaccard.shingles_of(texts)
        assert [x.tolist() for x in got] == [jaccard.shingles(t).tolist() for t in texts]
        assert [len(x) for x in got] == [len(x) for x in sets]
        # equal hashes for equal shingles, and no others
        assert len(np.unique(np.concatenate(got))) == len(set().union(*sets))
        for i in range(len(texts)):
            for j in range(i):
                assert len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j])
