import random
import string

import pytest

from tests.llm.held import secret_cases
from weir.llm import secrets

R = random.Random(5)
B62 = string.ascii_letters + string.digits


def some(n, chars=B62):
    return "".join(R.choice(chars) for _ in range(n))


LONG = some(1000)
LETTERS = "".join(c for c in some(300, string.ascii_letters)) + "7" + some(40)
DOTTED = "spring.datasource.hikari.primary.password=Hunter2abc9"
JWT = "eyJ" + some(30) + "." + some(700) + "." + some(40, string.ascii_letters)
BODY = "\n".join(some(64, B62 + "+/") for _ in range(200))
PEM = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{some(32, '0123456789ABCDEF')}\n\n{BODY}\n-----END RSA PRIVATE KEY-----"
CASES = {
    "token": (f"access_token = {LONG} end", "access_token = [SECRET] end"),
    "late digit": (f"access_token = {LETTERS} end", "access_token = [SECRET] end"),
    "dotted name": (f"{DOTTED} end", "spring.datasource.hikari.primary.password=[SECRET] end"),
    "web token": (f"see {JWT} end", "see [SECRET] end"),
    "encrypted block": (f"a {PEM} b", "a [SECRET] b"),
    "two blocks": (f"-----BEGIN PRIVATE KEY----- lost {PEM} b", "-----BEGIN PRIVATE KEY----- lost [SECRET] b"),
}


@pytest.mark.parametrize("case", CASES)
def test_no_part_of_a_secret_stays(spark, case):
    text, want = CASES[case]
    assert secrets.mask(spark.createDataFrame([(1, text, "src0")], "doc_id long, text string, source string")).first().text == want


def test_long_runs_end(spark):
    texts = ["key" * 200_000, "a" * 500_000, "-----BEGIN PRIVATE KEY-----" * 20_000, "eyJ-" * 100_000]
    df = spark.createDataFrame([(i, t, "src0") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert secrets.op5_secrets(df).count() == 4 and len(secrets.op5_secrets(df).select("masked_sha256").collect()) == 4


def test_formats_not_trained_on(spark):
    rows = secret_cases()
    df = spark.createDataFrame([(i, t, p) for i, (_, t, p, _, _) in enumerate(rows)], "doc_id long, text string, source string")
    whole = alarms = 0
    for x in secrets.findings(df).select("doc_id", "text", "_s").collect():
        _, _, _, value, label = rows[x.doc_id]
        at = x.text.find(value)
        if label:
            whole += any(s.start <= at and at + len(value) <= s.end for s in x._s)
        else:
            alarms += bool(x._s)
    n = sum(y for *_, y in rows)
    assert whole / n >= 0.9 and whole / (whole + alarms) >= 0.9


def test_features_by_hand(spark):
    """The forest's features of a candidate, against plain Python."""
    from pyspark.sql import functions as F

    words, steps = set(secrets.dictionary()), secrets.transitions()
    for v in ["passwordForHome", "x9Kq2mZt7Lw4", "0123-4567", "ABCdefGHI", "é" * 20 + "a1", "z"]:
        d = spark.createDataFrame([(v, "token = ", "", "src/test")], "value string, left string, right string, path string")
        x = d.select(secrets.features(F.struct("value", "left", "right"), F.col("path")).alias("x")).first().x
        import re

        runs = [w.lower() for w in re.findall("[A-Z]?[a-z]{2,}|[A-Z]{3,}", v)]
        low = v.lower()
        s = [steps[(ord(a) - 96) * 27 + ord(b) - 96] for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
        assert len(x) == secrets.FEATURES and x[0] == len(v) and x[7] == len(set(v)) / min(len(v), 64)
        assert x[5] == sum(len(w) for w in runs if w in words) / len(v)
        assert abs(x[17] - (sum(s) / len(s) if s else 0)) < 1e-9
        assert x[12] == 1 and x[15] == 1 and x[16] == 1


def test_query_is_what_the_operator_finds(spark):
    """Counts, places and the digest of the query, against the findings and texts cut by hand."""
    import hashlib

    docs = spark.createDataFrame([(i, t, "src0") for i, (t, _) in enumerate(CASES.values())] + [(99, None, None), (100, "", "s")], "doc_id long, text string, source string")
    every = {r.doc_id: (r.text or "", r._s, r._n) for r in secrets.findings(docs).collect()}
    for x in secrets.op5_secrets(docs).collect():
        text, s, n = every[x.doc_id]
        out, done = "", 0
        for f in s:
            if f.start >= done:
                out += text[done : f.start] + secrets.MASK
            done = max(done, f.end)
        assert x.spans == ",".join(f"{f.start}:{f.end}" for f in s) and (x.n_secrets, x.n_candidates) == (len(s), n)
        assert x.masked_sha256 == hashlib.sha256((out + text[done:]).encode()).hexdigest()
