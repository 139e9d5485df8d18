"""Personal data by candidate gradient boosting, with DataFrame functions only.

Strict patterns find what is personal for certain (base spans, always kept).
Looser generators, several of each kind, propose further, overlapping spans:
masked, quoted and non-ASCII addresses, numbers without a country code or with
an extension, cards with odd separators, long, masked and mapped network
addresses. Boosted trees judge each by its format and its neighbouring words;
their scores are calibrated on held-out examples, and a span is taken from the
threshold of PRECISION on. The trees are fitted on generated examples (a
fixed number) and run as SQL expressions.

A null text is empty and has no spans. Rows that repeat are kept; an empty
table gives an empty result; extra columns are ignored. Counts are of base
spans; ``spans`` has all.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import trees
from weir.llm.spans import flag, found, luhn, only, overlaps, replaced

KINDS = ("email", "ip", "card", "phone")
#: Generated examples of each template, and the share held out for calibration.
EXAMPLES, HELD = 48, 4
PRECISION = 0.98
#: Characters of context on either side.
CONTEXT = 28

_W = "A-Za-z0-9._%+-"
#: The contract's patterns. A run is entered at its start or where the last match ended, and never
#: given back, so long runs cost linear time and no stack.
BASE = {
    "email": rf"(?:\G|(?<![{_W}]))[{_W}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_AT, _DOT = r"(?: ?[\[({](?:at|AT)[\])}] ?| at | ?@ ?)", r"(?: ?[\[({](?:dot|DOT)[\])}] ?| dot |\.)"
_L = r"\p{L}\p{N}"
_GROUPED = r"(?<![0-9A-Za-z+.-])(?:00[1-9]|\(?0?[0-9]{2,4}\)?[ ./-])(?:[ ()./-]*+[0-9]++)++(?![0-9A-Za-z])"
#: Generators of each kind and what a text must have for them. They take runs whole; what a format allows is checked after the match.
LOOSE = {
    "email": [
        (rf"(?<![{_W}])[{_W}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", r"[\[({](?:at|AT)[\])}]| at [A-Za-z0-9-]++(?:\.[A-Za-z0-9]| dot )|[A-Za-z0-9] ?@ ?[A-Za-z0-9]"),
        (rf"(?<![{_L}._%+-])[{_L}._%+-]++@[{_L}-]++(?:\.[{_L}-]++)++", rf"[{_L}]@[{_L}]"),
        (rf"\"[^\"@\n]++\"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "\"@"),
    ],
    "ip": [
        (r"(?<![0-9A-Fa-f:.\[\]])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
        (r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\[dot\] ?)[0-9]{1,3}){3}(?![0-9])", r"[0-9](?:\[|\(| \[)(?:\.|dot)"),
        (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", r":[0-9]{1,3}\.[0-9]"),
    ],
    "card": [
        (r"(?<![0-9])[0-9](?:[ ./_-]{0,3}[0-9])++(?![0-9])", r"[0-9](?:[ ./_-]{0,3}[0-9]){12}"),
        (r"(?<![0-9])[0-9]++(?![0-9])", r"[0-9]{13}"),
        (r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}(?![0-9])", r"[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}"),
        (r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])", r"3[47][0-9]{2}[ -]?[0-9]{6}"),
    ],
    "phone": [
        (_GROUPED, r"(?:^|[^0-9A-Za-z+.-])(?:00[1-9]|\(?0?[0-9]{2,4}\)?[ ./-])[0-9 ()./-]{4}"),
        (_GROUPED.removesuffix("(?![0-9A-Za-z])") + r" ?(?:ext|x|Ext)\.? ?[0-9]++", r"[0-9] ?(?:ext|x|Ext)\.? ?[0-9]"),
        (r"(?<![0-9A-Za-z+.,:/_-])[0-9]++(?![0-9A-Za-z.,:/_-])", r"(?i)(?:phone|tel|call|fax|mobil|cell|dial|sms)[a-z:. ]{0,12}[0-9]{7}"),
    ],
}
_DIGITS = {"card": (13, 19), "phone": (7, 19)}
_CUES = {"email": "mail|contact|write|reach|address", "ip": r"\bip|host|server|addr|login from|client", "card": "card|visa|credit|debit|pay|amex", "phone": "phone|tel|call|fax|mobil|cell|dial|sms"}
_ANTI = r"order|invoice|isbn|ref|serial|sku|build|version|track|score|date|time|total|page|room|ticket|part no|mac\b"
FEATURES = 16


def base(text: Column) -> dict[str, Column]:
    out = {k: found(text, BASE[k], F.contains(text, F.lit("@")) if k == "email" else text.rlike(_GUARD[k])) for k in KINDS}
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    out["ip"] = F.filter(out["ip"], lambda s: s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
    digits = lambda s: only(s["value"], "0-9")
    cards = F.transform(out["card"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), digits(s).alias("d")))
    cards = F.filter(F.filter(cards, lambda s: F.length(s["d"]).between(16, 19)), lambda s: luhn(s["d"]))
    out["card"] = F.transform(cards, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    out["phone"] = F.filter(out["phone"], lambda s: F.length(digits(s)).between(8, 15))
    return out


def features(c: Column) -> Column:
    """Format and context of a candidate (kind, value, left, right) as an array of doubles."""
    v, left, right = c["value"], F.lower(c["left"]), F.lower(c["right"])
    d, a = only(v, "0-9"), only(v, "A-Za-z")
    cue = F.lit(False)
    for k, name in enumerate(KINDS):
        cue = cue | ((c["kind"] == k) & left.rlike(_CUES[name]))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    x = [
        c["kind"], F.length(v), F.length(d), F.length(a), F.length(v) - F.length(d) - F.length(a), flag(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
        F.size(F.array_distinct(F.split(d, ""))),
        flag(v.rlike(r"^(?:00|\(|0)")), flag(cue), flag(left.rlike(_ANTI)), flag(left.rlike("[a-z0-9/=_#-]$")), flag(right.rlike("^[a-z0-9/=_-]")),
        F.length(F.regexp_extract(v, "([A-Za-z0-9-]+)$", 1)), F.array_max(F.transform(F.concat(groups, F.array(F.lit(""))), lambda g: F.length(g))), F.size(groups), flag(F.lower(v).rlike(r"[\[({](?:at|dot|\.)[\])}]| dot ")),
    ]
    return F.array(*[f.cast("double") for f in x])


def candidates(text: Column, taken: Column) -> Column:
    """Loose spans (kind, start, end, x) that meet no taken one (kind, start, end), unless they hold one of their own kind and more."""

    def proposed(k: int) -> Column:
        s = F.concat(*[found(text, pattern, text.rlike(guard)) for pattern, guard in LOOSE[KINDS[k]]])
        if KINDS[k] in _DIGITS:
            s = F.filter(s, lambda c: F.length(only(c["value"], "0-9")).between(*_DIGITS[KINDS[k]]))
        s = F.filter(s, lambda c: ~F.exists(taken, lambda b: overlaps(c, b) & ((b["kind"] != k) | (c["start"] > b["start"]) | (c["end"] < b["end"]) | (c["end"] - c["start"] == b["end"] - b["start"]))))
        return F.transform(
            F.array_distinct(s),
            lambda c: F.struct(
                F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"),
                F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT))).alias("left"), F.substring(text, c["end"] + 1, F.lit(CONTEXT)).alias("right"),
            ),
        )

    parts = [proposed(k) for k in range(len(KINDS))]
    return F.transform(F.concat(*parts), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), features(c).alias("x")))


TAKEN = "array<struct<kind:int,start:int,end:int>>"


def _examples() -> list[tuple[str, int]]:
    """(text, kind): texts with candidates that are personal by one kind, or (kind -1) that look alike and aren't."""
    r = random.Random(3)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    h = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))

    def card(k: int, ok: bool) -> str:
        s = r.choice("3456") + n(k - 2)
        t = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(s))))
        c = (-t) % 10
        return s + str(c if ok else (c + r.randint(1, 9)) % 10)

    def spaced(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "io", "example"])
    yes = [
        ("email", lambda: f"{w()}.{w()}{r.choice([' [at] ', '(at)', ' (at) ', '[at]'])}{w()}{r.choice([' [dot] ', '(dot)', '.', ' dot '])}{tld()}"),
        ("email", lambda: f"{w()}{n(2)} at {w()} dot {tld()}"),
        ("email", lambda: f"mail {w()} @ {w()}.{tld()}"),
        ("email", lambda: f"{w()}{r.choice('éüñøç')}{w()}@{w()}{r.choice(['', 'ö'])}.{tld()}"),
        ("email", lambda: f'"{w()} {w()}"@{w()}.{tld()}'),
        ("ip", lambda: ":".join(h() for _ in range(8))),
        ("ip", lambda: f"host {h()}:{h()}::{h()}:{h()}"),
        ("ip", lambda: "[.]".join(str(r.randint(1, 255)) for _ in range(4))),
        ("ip", lambda: f"::ffff:{'.'.join(str(r.randint(1, 255)) for _ in range(4))}"),
        ("card", lambda: f"{r.choice(['card', 'visa', 'paid by', 'credit card no'])} {spaced(card(16, True), r.choice(['.', '  ', '/', '_', ' - ']))}"),
        ("card", lambda: f"{r.choice(['amex card', 'amex', 'card', 'pay with'])} {card(15, True)}"),
        ("card", lambda: f"{card(16, True)} {card(16, True)}{r.choice(['', ' cards', ' paid'])}"),
        ("phone", lambda: f"{r.choice(['tel', 'phone:', 'call', 'fax', 'mobile'])} {r.choice(['(' + n(3) + ') ', n(3) + '-', n(3) + '.'])}{n(3)}-{n(4)}{r.choice(['', '', ' ext ' + n(2), ' x' + n(3)])}"),
        ("phone", lambda: f"({n(3)}) {n(3)}-{n(4)}"),
        ("phone", lambda: f"call 00{r.randint(1, 9)}{n(1)} {n(3)} {n(4)} {n(2)}"),
        ("phone", lambda: f"tel 0{n(2)}/{n(3)} {n(4)}"),
        ("phone", lambda: f"{r.choice(['phone', 'call', 'sms to', 'mobile:', 'tel.'])} 0{n(r.randint(8, 10))}"),
    ]
    no = [
        lambda: f"{w()} at {w()}.{w()}",
        lambda: f"we met at {w()}.{w()[0].upper()}{w()}",
        lambda: f"{w()} @ {w()}.{n(2)}",
        lambda: f"{r.randint(0, 23)}:{n(2)}::{n(2)}",
        lambda: f"mac {':'.join((h() + '0')[:2] for _ in range(8))}",
        lambda: f"{r.choice(['order', 'ref', 'tracking', 'serial', ''])} {spaced(card(r.randint(13, 19), False), r.choice(['', '-', '.', ' ', '/']))}",
        lambda: card(r.choice([13, 15, 16, 16, 16, 19]), False),
        lambda: f"{card(16, False)} {card(16, False)}",
        lambda: f"isbn {n(3)}-{n(1)}-{n(5)}-{n(3)}-{n(1)}",
        lambda: f"{r.choice(['order', 'invoice', 'ticket', 'ref'])} {n(3)}-{n(3)}-{n(4)}",
        lambda: f"{r.choice(['date', 'on', 'since', ''])} {r.randint(10, 31)}.{r.randint(10, 12)}.{r.randint(1950, 2030)} {r.randint(10, 23)}",
        lambda: f"{r.randint(1950, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}",
        lambda: f"total {n(2)} {n(3)} {n(3)} {n(2)}",
        lambda: f"scores {n(2)} - {n(2)} {n(2)} - {n(2)}",
        lambda: f"version {n(2)}.{n(2)}.{n(4)}.{n(2)}.{n(2)}",
        lambda: f"{n(3)} {n(2)} {n(2)} {n(3)} {n(2)}",
        lambda: f"{r.choice(['phone number of the order', 'call id', 'ticket', 'invoice'])} {n(r.choice([7, 8, 12, 14]))}",
        lambda: f"we met {w()} at {w()}.{tld()[0]}{w()} and {w()} at {w()}.",
    ]
    out = []
    for kind, make in [*yes, *((None, m) for m in no)]:
        for _ in range(EXAMPLES):
            before, after = (" ".join(w() for _ in range(r.randint(0, 4))) for _ in range(2))
            out.append((f"{before} {make()} {after}".strip(), -1 if kind is None else KINDS.index(kind)))
    r.shuffle(out)
    return out


@lru_cache(maxsize=4)
def _fitted(app: str) -> tuple[float, list, float, float, float]:
    """(bias, trees, a, b, threshold), fitted once an application on candidates that the same expressions propose."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(_examples())], "i int, text string, y int")
    none = F.array().cast(TAKEN)
    got = rows.select("i", "y", F.explode(candidates(F.col("text"), none)).alias("c")).select("i", (F.col("y") == F.col("c.kind")).cast("int").alias("y"), "c.x").collect()
    got.sort(key=lambda g: (g["i"], g["x"]))
    x, y, i = np.array([g["x"] for g in got]), np.array([g["y"] for g in got], float), np.array([g["i"] for g in got])
    test = i % HELD == 0
    bias, grown = trees.boost(x[~test], y[~test])
    s = bias + sum(trees.predict(t, x[test]) for t in grown)
    a, b = trees.platt(s, y[test])
    return bias, grown, a, b, trees.threshold(1 / (1 + np.exp(-(a * s + b))), y[test], PRECISION)


def find(docs: DataFrame) -> DataFrame:
    """docs with email, ip, card, phone (base spans) and extra (kind, start, end, p)."""
    bias, grown, a, b, least = _fitted(docs.sparkSession.sparkContext.applicationId)
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns({f"_{k}": c for k, c in base(text).items()})
    df = df.withColumn("_c", candidates(text, F.concat(*map(_kinded, KINDS))))
    p = lambda x: 1 / (1 + F.exp(-(F.lit(a) * (F.lit(bias) + trees.total(grown, lambda k: F.get(x, F.lit(k)))) + F.lit(b))))
    df = df.withColumn("_c", F.transform("_c", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), p(c["x"]).alias("p"))))
    df = df.withColumn("_c", F.filter("_c", lambda c: c["p"] >= least))
    # of overlapping spans the likeliest stays; ties by length, then by place
    better = lambda o, c: overlaps(o, c) & (F.struct(o["p"], o["end"] - o["start"], -o["start"], -o["kind"]) > F.struct(c["p"], c["end"] - c["start"], -c["start"], -c["kind"]))
    return df.withColumn("_c", F.filter("_c", lambda c: ~F.exists(F.col("_c"), lambda o: better(o, c))))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _kinded(name: str) -> Column:
    return F.transform(f"_{name}", lambda s: F.struct(F.lit(KINDS.index(name)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def op3_pii(docs: DataFrame) -> DataFrame:
    found_ = find(docs.select("doc_id", "text"))
    own = F.concat(*map(_kinded, KINDS))
    extra = F.transform("_c", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found_.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_told(own).cast("binary"), 256).alias("base_sha256"), _told(F.concat(own, extra)).alias("spans"), F.size("_c").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; overlapping spans become one."""
    every = F.array_sort(F.concat(*[F.transform(_kinded(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))) for k in KINDS], F.transform("_c", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    marked = replaced(F.col("text"), F.col("_c"), lambda s: F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]")))
    out = find(docs.select(F.struct("*").alias("row"), "text")).withColumn("_c", every)
    return out.select(*[(F.when(F.size("_c") > 0, marked).otherwise(F.col("text")) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
