"""The aggregate functions, as grouped, windowed and in-array aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.exprs import Value
from weir.lang.lexer import QueryError
from weir.plans import types as L


def _kept(arg: Value, where: Column | None) -> Column | None:
    """Where the argument counts: its filter holds and it doesn't fail."""
    ok = where
    if arg.err is not None:
        fine = ~F.coalesce(arg.err, F.lit(False))
        ok = fine if ok is None else ok & fine
    return ok


def _only(c: Column, ok: Column | None) -> Column:
    return c if ok is None else F.when(ok, c)


def aggregate(name: str, arg: Value | None, where: Column | None, ordered: Callable[..., Column] | None = None) -> Value:
    """A grouped (or windowed) aggregate; ordered turns a collected column into its ordered list."""
    if name == "count":
        if arg is None:
            return Value(F.count(F.lit(1) if where is None else F.when(where, 1)), L.UINT64)
        # nulls count, only absent values don't
        if arg.missing:
            return Value(F.count(F.when(F.lit(False), 1)), L.UINT64)
        ok = _kept(arg, where)
        return Value(F.count(F.lit(1) if ok is None else F.when(ok, 1)), L.UINT64)
    if arg is None:
        raise QueryError(f"{name}() needs an argument")
    if arg.missing:
        return Value(F.max(F.lit(None).cast("string")), L.NULL)
    ok = _kept(arg, where)
    t = L.under(arg.type)
    c = _only(arg.col, ok)
    numeric = L.is_number(t) or L.is_prim(t, "duration")
    if name == "sum":
        if not numeric:
            return Value(F.max(F.lit(None).cast("bigint")), L.NULL)
        if L.is_float(t):
            return Value(F.sum(c.cast("double")), L.FLOAT64)
        return Value(F.try_sum(c.cast("bigint")), L.DURATION if L.is_prim(t, "duration") else L.UINT64 if t[1][0] == "u" else L.INT64)
    if name in ("min", "max"):
        if not (numeric or L.is_prim(t, "time")):
            return Value(F.max(F.lit(None).cast("bigint")), L.NULL)
        return Value((F.min if name == "min" else F.max)(c), t, ntz=arg.ntz)
    if name == "avg":
        if L.is_prim(t, "string"):
            return Value(F.avg(c.try_cast("double")), L.FLOAT64)
        if not numeric:
            return Value(F.max(F.lit(None).cast("double")), L.NULL)
        return Value(F.avg(c.cast("double")), L.FLOAT64)
    if name == "any":
        return Value(F.any_value(c, True), arg.type, ntz=arg.ntz)
    if name in ("and", "or"):
        if not L.is_prim(t, "bool"):
            return Value(F.bool_and(F.lit(None).cast("boolean")), L.BOOL)
        return Value((F.bool_and if name == "and" else F.bool_or)(c), L.BOOL)
    if name == "collect":
        got = ordered(c, "map<" not in L.spark_type(arg.type).simpleString()) if ordered is not None else F.collect_list(c)
        return Value(F.nullif(got, F.array().cast(f"array<{L.spark_type(arg.type).simpleString()}>")), ("array", arg.type))
    if name == "union":
        return Value(F.nullif(F.array_sort(F.collect_set(c)), F.array().cast(f"array<{L.spark_type(arg.type).simpleString()}>")), ("set", arg.type))
    if name == "dcount":
        null = arg.col.isNull() if ok is None else ok & arg.col.isNull()
        return Value(F.approx_count_distinct(c) + F.coalesce(F.max(null.cast("bigint")), F.lit(0)), L.UINT64)
    if name == "collect_map":
        entries = F.map_entries(c)
        got = F.flatten(ordered(entries, "map<" not in L.spark_type(t[2]).simpleString()) if ordered is not None else F.collect_list(entries))
        # the last entry of a key wins
        keys = F.array_distinct(F.transform(got, lambda x: x["key"]))
        values = F.transform(keys, lambda k: F.element_at(F.filter(got, lambda x: x["key"] == k), -1)["value"])
        return Value(F.when(F.size(keys) > 0, F.map_from_arrays(keys, values)), arg.type)
    if name == "fuse":
        return Value(F.max(F.lit(L.text(arg.type))), L.TYPE)
    raise QueryError(f"no such aggregate: {name}")


def in_array(name: str, c: Column, t: L.Type) -> Value:
    """An aggregate of an array's elements."""
    u = L.under(t)
    some = F.filter(c, lambda x: x.isNotNull())
    if name == "count":
        return Value(F.when(c.isNotNull(), F.size(c).cast("bigint")), L.UINT64)
    if name == "sum":
        out = L.FLOAT64 if L.is_float(u) else L.DURATION if L.is_prim(u, "duration") else L.INT64
        st = L.spark_type(out)
        return Value(F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast(st), lambda a, x: F.try_add(a, x.cast(st)))), out)
    if name in ("min", "max"):
        return Value((F.array_min if name == "min" else F.array_max)(c), t)
    if name == "avg":
        return Value(F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(some)), L.FLOAT64)
    if name == "any":
        return Value(F.get(some, F.lit(0)), t)
    if name in ("and", "or"):
        got = F.forall(some, lambda x: x) if name == "and" else F.exists(some, lambda x: x)
        return Value(F.when(F.size(some) > 0, got), L.BOOL)
    if name == "collect":
        return Value(F.when(F.size(some) > 0, some), ("array", t))
    if name == "union":
        return Value(F.when(F.size(some) > 0, F.array_sort(F.array_distinct(some))), ("set", t))
    if name == "dcount":
        return Value(F.size(F.array_distinct(c)).cast("bigint"), L.UINT64)
    if name == "fuse":
        return Value(F.lit(L.text(t)), L.TYPE)
    raise QueryError(f"{name} can't be used in an expression over an array")
