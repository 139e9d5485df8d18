"""Running aggregates over all rows in order, without one task for all of them.

Rows are cut into ranges of the whole order key at quantiles of a sample, so
that a leading key of few values, or of text, is no matter. An aggregate runs
within a range, where it is one task's window; what all earlier ranges give is
one value a range, known from one aggregate query, and is put in as a constant.
Where the sample has one key in many places, a hash of the row decides ties.
The sample brings SAMPLED keys a range to the driver, the totals one value.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.functions.aggs import aggregate
from weir.functions.exprs import Value
from weir.plans import types as L

#: At least so many ranges, and at most MOST; one for each RANGE_BYTES that the tables have on disk.
RANGES, MOST, RANGE_BYTES = 128, 1024, 4 << 20
SAMPLED = 32
#: Below this many bytes of the tables on disk (whatever columns are read of them) one window is one task's work anyway.
SMALL = 4 << 20
_ids = itertools.count()
#: How an aggregate continues from what came before it.
_JOIN = {"count": lambda a, b: a + b, "sum": lambda a, b: a + b, "min": F.least, "max": F.greatest, "and": lambda a, b: a & b, "or": lambda a, b: a | b}
_JOIN_PLAIN = {"count": lambda a, b: a + b, "sum": lambda a, b: a + b, "min": min, "max": max, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def spreads(r, name: str) -> bool:
    """Whether this aggregate can and need be spread."""
    return name in _JOIN and in_ranges(r)


def in_ranges(r) -> bool:
    """Whether rows in order can and need be cut into ranges."""
    if r.scope or not r.order or r.df.isStreaming or not _keys(r):
        return False
    plan = r.df._jdf.queryExecution().optimizedPlan()
    # limits and totals are known to be small; a filter or a choice of columns says little about rows
    return _bytes(plan) > SMALL // 64 and _read(plan) > SMALL


def _bytes(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def _read(plan) -> int:
    leaves = plan.collectLeaves()
    return sum(_bytes(leaves.apply(i)) for i in range(leaves.size()))


def _keys(r) -> list[tuple[str, bool, bool]]:
    """The order's keys up to the first that has no plain comparison."""
    out = []
    for o in r.order:
        if not isinstance(r.df.schema[o[0]].dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            break
        out.append(o)
    return out


def _told(c: Column, kind: T.DataType) -> Column:
    """A key as text from which _literal makes it again."""
    return F.hex(c) if isinstance(kind, (T.StringType, T.BinaryType)) else c.cast("string")


def _literals(texts: list[str | None], kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.array(*[F.unhex(F.lit(x).cast("string")).cast("string") for x in texts])
    return F.array(*[F.unhex(F.lit(x).cast("string")) if isinstance(kind, T.BinaryType) else F.lit(x).cast("string").cast(kind) for x in texts])


def ranges(r, tie: Column | None = None) -> tuple[Column, list[Column]]:
    """Each row's range, counted in the order of rows, and the order within ranges; rows of equal keys (and ties) share a range.

    Constants bound the ranges, so every query that has them agrees. Found once for all aggregates of an operator,
    and put into hidden columns of r, so that a query works them out once.
    """
    if "_ranges" not in r.__dict__:
        h = f"__range{next(_ids)}"
        at, by, tie = _ranges(r, tie)
        r.df = r.df.withColumns({h: at} if tie is None else {h: at, f"{h}tie": tie})
        r.__dict__["_ranges"] = F.col(h), by if tie is None else [*by, F.col(f"{h}tie")]
    return r.__dict__["_ranges"]


def _ranges(r, tie: Column | None) -> tuple[Column, list[Column], Column | None]:
    size = _read(r.df._jdf.queryExecution().optimizedPlan())
    n = max(RANGES, min(MOST, size // RANGE_BYTES)) if size < 1 << 50 else RANGES
    keys = [(F.col(h), r.df.schema[h].dataType, desc, first) for h, desc, first in _keys(r)]
    by = r.order_by()

    def bounds() -> list[tuple]:
        some = r.df.select(*[c.alias(f"k{i}") for i, (c, *_) in enumerate(keys)]).orderBy(F.rand(7)).limit(SAMPLED * n)
        order = [getattr(F.col(f"k{i}"), f"{'desc' if desc else 'asc'}_nulls_{'first' if first else 'last'}")() for i, (_, _, desc, first) in enumerate(keys)]
        got = [tuple(x) for x in some.orderBy(*order).select(*[_told(F.col(f"k{i}"), k) for i, (_, k, *_) in enumerate(keys)]).collect()]
        return [got[k * len(got) // n] for k in range(1, n)] if got else []

    found = bounds()
    if len(keys) == len(r.order) and _crowded(found):
        if tie is None:
            plain = [F.col(f"`{f.name}`") for f in r.df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
            tie = F.xxhash64(*plain)
        keys.append((tie, T.LongType(), False, False))
        found = bounds()
    found = list(dict.fromkeys(found))
    if not found:
        return F.lit(0), by, tie
    arrays = [_literals([b[i] for b in found], k) for i, (_, k, *_) in enumerate(keys)]

    def after(at: Column) -> Column:
        """Whether a row comes after the bound at a place."""
        out = None
        for i in range(len(keys) - 1, -1, -1):
            (c, _, desc, first), b = keys[i], F.get(arrays[i], at)
            before = F.when(c.isNull(), F.lit(not first)).otherwise((b > c) if desc else (b < c))
            if any(x[i] is None for x in found):
                before = F.when(b.isNull(), c.isNotNull() & F.lit(first)).otherwise(before)
            out = before if out is None else before | (b.eqNullSafe(c) & out)
        return out

    steps = [1 << k for k in range(len(found).bit_length() - 1, -1, -1)]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: i + F.when((i + step <= len(found)) & after(i + step - 1), step).otherwise(0))
    return at, by, tie


def _crowded(found: list[tuple]) -> bool:
    """Whether a key is in so many places of the sample that its range would be four times as large as others."""
    return any(found[i] == found[i + 3] for i in range(len(found) - 3))


def exact_sum(arg: Value, where: Column | None) -> Column | None:
    """The sum of integers that can't overflow on the way, for a total that is null where it doesn't fit; None for others."""
    if arg is None or arg.missing or not (L.is_int(L.under(arg.type)) or L.is_prim(L.under(arg.type), "duration")):
        return None
    c = arg.col.cast("decimal(38,0)")
    ok = where if arg.err is None else ~F.coalesce(arg.err, F.lit(False)) if where is None else where & ~F.coalesce(arg.err, F.lit(False))
    return F.sum(c if ok is None else F.when(ok, c))


def running(r, name: str, arg: Value | None, where: Column | None, to: str = "bigint") -> Value:
    """A running aggregate by ranges; exact sums are given as a type that they may not fit (then null)."""
    v = aggregate(name, arg, where)
    wide = exact_sum(arg, where) if name == "sum" else None
    col, kind = (v.col, L.spark_type(v.type)) if wide is None else (wide, T.DecimalType(38, 0))
    at, by = ranges(r)
    totals = {x["p"]: x["v"] for x in r.df.groupBy(at.alias("p")).agg(col.alias("v")).collect()}
    before, earlier = None, []
    for p in range(max(totals, default=-1) + 1):
        earlier.append(before)
        x = totals.get(p)
        if x is not None:
            before = x if before is None else _JOIN_PLAIN[name](before, x)
    w = Window.partitionBy(at).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    own = col.over(w)
    if any(x is not None for x in earlier):
        known = F.get(F.array(*[F.lit(x).cast(kind) for x in earlier]), at)
        own = F.when(own.isNull(), known).when(known.isNull(), own).otherwise(_JOIN[name](own, known))
    return Value(own if wide is None else own.try_cast(to), v.type, ntz=v.ntz)


def first_of_runs(r, key: Column) -> DataFrame:
    """Rows whose key differs from that of the row before, in order.

    Rows are compared within their ranges; the key that a range ends with is known to the next one from a side query,
    which brings one key a range to the driver. A hash of the key decides ties, so both see the same last row.
    """
    at, by = ranges(r, F.xxhash64(key))
    rows = r.df.withColumns({"__p": at, "__k": key})
    w = Window.partitionBy("__p").orderBy(*by)
    ends = sorted(rows.withColumn("__more", F.lead(F.lit(1)).over(w)).where("__more IS NULL").select("__p", "__k").collect(), key=lambda x: x["__p"])
    schema = T.StructType([T.StructField("__after", T.IntegerType()), T.StructField("__before", rows.schema["__k"].dataType)])
    before = r.df.sparkSession.createDataFrame([(b["__p"], a["__k"]) for a, b in zip(ends, ends[1:])], schema)
    last = F.lag("__k").over(w)
    # what earlier ranges end with is joined to the first rows alone
    firsts = rows.withColumn("__last", last).where(F.col("__last").isNull() | ~F.col("__k").eqNullSafe(F.col("__last")))
    df = firsts.join(F.broadcast(before), F.col("__p") == F.col("__after"), "left")
    return df.where(F.col("__last").isNotNull() | ~F.col("__k").eqNullSafe(F.col("__before"))).select(*r.df.columns)
