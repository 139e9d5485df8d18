"""Secret scanning with a random forest, with DataFrame functions only.

Generators with high recall propose candidates: values assigned to names that
sound secret, long tokens that hold a digit, known key formats and private-key blocks.
A random forest on length, character transitions, dictionary coverage, the
document's path (its source) and neighbouring words removes false findings. It
is fitted on generated labelled findings (a fixed number) and runs as SQL
expressions.

A null text has no findings and stays null where text is returned. Rows that
repeat are kept; an empty table gives an empty result; extra columns are kept
by ``mask`` and ignored otherwise. A missing ``source`` is an empty path.
"""

from __future__ import annotations

import itertools
import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import trees
from weir.llm.spans import flag, found, only, replaced

#: Generated findings of each template.
EXAMPLES = 36
#: Mean vote of the trees from which on a candidate is a secret.
THRESHOLD = 0.6
CONTEXT = 32
MASK = "[SECRET]"

# A run is entered at its start and taken whole, never given back: no length is cut, and long runs cost linear time.
_SOUNDS = "key|token|secret|passwd|password|pwd|credential|auth|bearer"
_NAME = rf"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?(?:{_SOUNDS}))[A-Za-z0-9_.-]++[\"']? {{0,2}}"
_ASSIGNED = rf"(?i){_NAME}(?::=|[:=]) {{0,2}}[\"'`]?([^\s\"'`,;]{{8,}}+)"
_TOKEN = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+"
_FORMAT = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[0-9A-Za-z_-]{35,}+|eyJ[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)*+)"
_PEM = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
_KNOWN = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}.*|-----BEGIN [\s\S]*)$"
_CUE = r"key|token|secret|passw|pwd|credential|auth|bearer|login"
_ANTI = r"(?<![a-z])(?:sha|commit|checksum|md5|hash|uuid|guid|digest|etag|isbn|order|invoice|revision|build|integrity|color|image|base64,|version|id\b)"
_MOCK = r"example|dummy|placeholder|changeme|sample|your[-_]?|xxxx|<|\$\{|\btest|todo|1234567"
#: A public tokenizer's vocabulary whose ids go by frequency: its first whole words are the dictionary.
WORDS_FILE, WORDS = "/opt/tokenizers/word_bpe_49k.json", 4000
#: Runs of letters that could be words: of small letters, with a capital before them or not, or of capitals.
_RUN = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"


@lru_cache(maxsize=4)
def dictionary(path: str = WORDS_FILE) -> tuple[str, ...]:
    """Words of three letters or more, the most frequent ones."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (re.fullmatch("([a-z]{3,})</w>", x) for x in sorted(ids, key=ids.get))
    return tuple(itertools.islice((m[1] for m in words if m), WORDS))


@lru_cache(maxsize=4)
def transitions(path: str = WORDS_FILE) -> tuple[float, ...]:
    """log2 of the chance of each letter after each letter (27 x 27, 0 is a word's end) in the dictionary."""
    n = np.full((27, 27), 0.1)
    for w in dictionary(path):
        at = [0, *(ord(c) - 96 for c in w), 0]
        np.add.at(n, (at[:-1], at[1:]), 1)
    return tuple(np.log2(n / n.sum(axis=1, keepdims=True)).ravel().round(2).tolist())


def candidates(text: Column, path: Column) -> Column:
    """(start, end, x) of each candidate; x are its features."""
    assigned = found(text, _ASSIGNED, F.lower(text).rlike(f"{_NAME}[:=]"))
    assigned = F.transform(assigned, lambda c: F.struct((c["end"] - F.length(F.regexp_extract(c["value"], _ASSIGNED, 1))).alias("start"), c["end"].alias("end"), F.regexp_extract(c["value"], _ASSIGNED, 1).alias("value")))
    token = found(text, _TOKEN, text.rlike("[A-Za-z0-9_+/=-]{16}") & text.rlike("[0-9]"))
    known = found(text, _FORMAT)
    pem = found(text, _PEM, F.contains(text, F.lit("PRIVATE KEY")))
    every = F.concat(pem, known, assigned, token)
    # the same place is proposed once, the first generator's first
    every = F.element_at(F.transform(F.array(every), lambda e: F.filter(e, lambda c, i: ~F.exists(F.slice(e, F.lit(1), i), lambda o: (o["start"] == c["start"]) & (o["end"] == c["end"])))), 1)
    around = F.transform(
        every,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
            F.lower(F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))).alias("left"), F.lower(F.substring(text, c["end"] + 1, F.lit(12))).alias("right"),
        ),
    )
    return F.transform(around, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), features(c, path).alias("x")))


FEATURES = 19


def _covered(v: Column) -> Column:
    """How many letters of v are in words of the dictionary."""
    runs = F.transform(F.regexp_extract_all(v, F.lit(_RUN), F.lit(0)), F.lower)
    return F.aggregate(F.filter(runs, lambda w: w.isin(*dictionary())), F.lit(0), lambda n, w: n + F.length(w))


def _transitions(low: Column) -> Column:
    """The mean score of the steps between the letters of v; 0 without any."""
    table = F.split(F.lit(",".join(map(str, transitions()))), ",").cast("array<double>")

    def mean(codes: Column) -> Column:
        steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.when(a.between(1, 26) & b.between(1, 26), F.get(table, a * 27 + b)))
        steps = F.filter(steps, lambda x: x.isNotNull())
        return F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps)).otherwise(0.0)

    codes = F.transform(F.split(low, ""), lambda c: F.ascii(c) - 96)
    return F.element_at(F.transform(F.array(codes), mean), 1)


def features(c: Column, path: Column) -> Column:
    v, left, right = c["value"], c["left"], c["right"]
    n = F.greatest(F.length(v), F.lit(1))
    low = F.lower(v)
    changes = F.size(F.split(v, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])", -1)) - 1
    x = [
        F.length(v), F.length(only(v, "0-9")) / n, F.length(only(v, "A-Z")) / n, F.length(only(v, "a-z")) / n, changes / n,
        _covered(v) / n, F.length(only(low, "aeiou")) / n, F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)),
        flag(v.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")), flag(v.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")), flag(v.rlike("^[0-9_+/=-]++$")), flag(v.rlike(_KNOWN)),
        flag(left.rlike(_CUE)), flag(left.rlike(_ANTI)), flag(low.rlike(_MOCK) | left.rlike(_MOCK) | right.rlike(_MOCK)), flag(left.rlike(r"[:=]>? {0,2}[\"'`]?$|bearer $")), flag(F.lower(path).rlike("test|example|fixture|docs|mock")),
        _transitions(low), F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")) / n,
    ]
    return F.array(*[f.cast("double") for f in x])


def _examples() -> list[tuple[str, str, int]]:
    """(text, path, label): labelled findings; real secrets, and what is often taken for one."""
    r = random.Random(11)
    s = lambda a, k: "".join(r.choice(a) for _ in range(k))
    hexa, up, low, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    b62 = up + low + digit
    w = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "sch", "ung", "eau", "ion", "ado"]) for _ in range(r.randint(1, 5)))
    name = lambda: r.choice(["token", "api_key", "secret", "password", "auth_token", "AWS_SECRET_ACCESS_KEY", "client_secret", "db_passwd", "apikey", "access_token"])
    is_ = lambda: r.choice([" = ", "=", ": ", ":", " := "])
    q = lambda x: r.choice(['"{}"', "'{}'", "{}"]).format(x)
    uuid = lambda: "-".join(s(hexa, k) for k in (8, 4, 4, 4, 12))
    yes = [
        lambda: name() + is_() + q(s(hexa, r.choice([32, 40, 40, 64]))),
        lambda: name() + is_() + q(s(b62, r.randint(20, 48))),
        lambda: name() + is_() + q(s(b62 + "+/", 40)),
        lambda: "token = " + '"' + s(hexa, 40) + '"',
        lambda: r.choice(["password", "passwd", "db_pwd"]) + is_() + q(s(b62 + "!@#%&*", r.randint(10, 18))),
        lambda: r.choice(["password", "app.db.password", "passwd", "PGPASSWORD"]) + is_() + q((w() + w()).capitalize()[:7].ljust(5, "n") + s(digit, r.randint(1, 3)) + s(b62 + "!@", r.randint(2, 6))),
        lambda: q("AKIA" + s(up + digit, 16)),
        lambda: q("ghp_" + s(b62, 36)),
        lambda: q("sk_live_" + s(b62, 24)),
        lambda: "xoxb-" + s(digit, 12) + "-" + s(b62, 24),
        lambda: "Authorization: Bearer " + s(b62, r.randint(24, 60)),
        lambda: "eyJ" + s(b62, 30) + "." + s(b62, 40) + "." + s(b62, 30),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + s(b62 + "+/", 120) + "\n-----END RSA PRIVATE KEY-----",
    ]
    no = [
        lambda: r.choice(["commit ", "sha1: ", "revision ", "sha256=", "checksum: ", "md5 = ", "etag: "]) + s(hexa, r.choice([32, 40, 64])),
        lambda: r.choice(["id=", "uuid: ", "request ", ""]) + uuid(),
        lambda: name() + is_() + q(r.choice(["your_api_key_here", "changeme123", "xxxxxxxxxxxxxxxx", "example-token-1234", "placeholder0", "${SECRET_TOKEN_1}", "<your-token-1>", "dummy_password1"])),
        lambda: name() + is_() + q(r.choice(["getTokenFromStore", "config.secret_value", "os.environ", "request.headers", "undefined", "user_password_field", "data-item-list"])),
        lambda: r.choice(["order ", "invoice ", "card ", "tracking ", ""]) + s(digit, r.randint(16, 22)),
        lambda: r.choice(["", "page ", "see "]) + "-".join(w() for _ in range(4)) + "-" + s(digit, 4),
        lambda: "_".join(w() for _ in range(4)) + s(digit, 2),
        lambda: "src/" + "/".join(w() for _ in range(4)) + s(digit, 1),
        lambda: "data:image/png;base64," + s(b62 + "+/", 80),
        lambda: r.choice(["build ", "version "]) + s(digit, 8) + "-" + s(hexa, 12),
        lambda: "=" * r.randint(8, 30) + s(digit, 1) + "-" * 12,
        lambda: w() + s(digit, 2) + "/" + w() + w() + w() + w(),
    ]
    out = []
    for label, makers in ((1, yes), (0, no)):
        for make in makers:
            for k in range(EXAMPLES):
                before, after = (" ".join(w() for _ in range(r.randint(0, 5))) for _ in range(2))
                end = r.choice(["", ".", "###", "***", "%%%", "!!"]) if make not in yes[4:6] else ""
                path = r.choice(["src0", "src7", "src/app", "web"]) if label or k % 3 else r.choice(["tests/fixtures", "docs/example"])
                out.append((f"{before} {make()}{end} {after}".strip(), path, label))
    r.shuffle(out)
    return out


@lru_cache(maxsize=4)
def _fitted(app: str) -> list:
    """The forest, fitted once an application on candidates that the same expressions propose."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, *e) for i, e in enumerate(_examples())], "i int, text string, path string, y int")
    got = rows.select("i", "y", F.explode(candidates(F.col("text"), F.col("path"))).alias("c")).select("i", "y", "c.x").collect()
    got.sort(key=lambda g: (g["i"], g["x"]))
    return trees.forest(np.array([g["x"] for g in got]), np.array([g["y"] for g in got]))


def findings(docs: DataFrame) -> DataFrame:
    """docs with _n (candidates) and _s: the secrets as sorted (start, end, p), overlapping ones all kept."""
    grown = _fitted(docs.sparkSession.sparkContext.applicationId)
    path = F.coalesce("source", F.lit("")) if "source" in docs.columns else F.lit("")
    df = docs.withColumn("_c", candidates(F.coalesce("text", F.lit("")), path))
    p = lambda x: trees.total(grown, lambda k: F.get(x, F.lit(k))) / len(grown)
    scored = F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), p(c["x"]).alias("p")))
    return df.withColumn("_s", F.array_sort(F.filter(scored, lambda c: c["p"] >= THRESHOLD))).withColumn("_n", F.size("_c")).drop("_c")


def _masked() -> Column:
    return F.when(F.size("_s") > 0, replaced(F.col("text"), F.col("_s"), lambda s: F.lit(MASK))).otherwise(F.col("text"))


def op5_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: candidates, secrets, their places, the highest vote and the digest of the masked text."""
    told = F.array_join(F.transform("_s", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return findings(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.col("_n").cast("long").alias("n_candidates"), F.size("_s").cast("long").alias("n_secrets"), told.alias("spans"),
        F.array_max(F.transform("_s", lambda s: s["p"])).alias("top_vote"), F.sha2(F.coalesce(_masked(), F.lit("")).cast("binary"), 256).alias("masked_sha256"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by MASK; rows and other columns stay."""
    path = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    found_ = findings(docs.select(F.struct("*").alias("row"), "text", path.alias("source")))
    return found_.select(*[(_masked() if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
