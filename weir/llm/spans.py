"""Places of pattern matches, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Matches placed in one inner loop; keeps very many matches of one text near linear.
_CHUNK = 256


def empty() -> Column:
    return F.array().cast(SPAN)


def found(text: Column, pattern: str, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as [start, end) in code points with their text; none where ``when`` isn't true.

    The pieces between matches and the matches themselves give all places.
    """
    pieces, matches = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("value")))
    pairs = F.filter(pairs, lambda x: x["value"].isNotNull())
    start = lambda spans: F.struct(F.lit(0).alias("at"), spans.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["skip"]
        b = a + F.length(x["value"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value")))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty().alias("out")), one)
        return F.element_at(F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out"))), 1)

    def placed(p: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int")), lambda k: F.slice(p, k * _CHUNK + 1, F.lit(_CHUNK)))
        return F.flatten(F.aggregate(parts, start(F.array().cast(f"array<{SPAN}>")), chunk, lambda acc: acc["out"]))

    # pairs is evaluated once, as the one element of an array
    spans = F.element_at(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(empty())), 1)
    guard = text.rlike(pattern) if when is None else when
    return F.when(F.coalesce(guard, F.lit(False)), spans).otherwise(empty())


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def only(c: Column, chars: str) -> Column:
    """c without anything but chars (a character class)."""
    return F.regexp_replace(c, f"[^{chars}]", "")


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def replaced(text: Column, spans: Column, mark) -> Column:
    """text with sorted spans (start, end) replaced by mark(span); a span that begins inside an earlier one only widens it."""
    widest = lambda i: F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"]))
    parts = F.transform(
        spans,
        lambda s, i: F.when(i == 0, F.concat(F.substring(text, F.lit(1), s["start"]), mark(s)))
        .when(s["start"] >= widest(i), F.concat(F.substring(text, widest(i) + 1, s["start"] - widest(i)), mark(s)))
        .otherwise(""),
    )
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))
