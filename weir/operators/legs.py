"""Legs of a fork or switch that only filter and project: one pass over their common input.

Each leg's last operator is run on a probe of the input, which keeps the fields
it would have projected to. A switch then is a case distinction for each field,
a fork an array of records that is exploded; either reads its input once. Legs
of other shapes have no such plan and stay relations of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.exprs import Value, boolean_of, error_col, error_type, lower, members
from weir.lang.lexer import QueryError
from weir.operators import rel as R
from weir.operators.rel import Rel
from weir.plans import types as L


class Legs(list):
    """Relations of legs, and the one relation that all of them together are."""

    whole: Rel | None = None


class _Fields(Exception):
    def __init__(self, fields: dict[str, Value] | None):
        self.fields = fields


@dataclass
class _Probe(Rel):
    def project(self, fields: dict[str, Value]) -> Rel:
        raise _Fields(fields)

    def yielding(self, v: Value) -> Rel:
        raise _Fields(members(v) if L.under(v.type)[0] == "record" and L.under(v.type)[1] else None)


def _plain(v: Value) -> Value:
    """A value as project gives it to a column."""
    t, c = (error_type(v), error_col(v)) if v.missing else (v.type, v.col)
    return Value(c.cast("string") if L.is_prim(t, "null") else c, t, ntz=v.ntz)


def _leg(r: Rel, body: tuple, plan, ops: dict[str, Callable]) -> tuple[Column, dict[str, Value]] | None:
    """(condition, fields) of a leg, or None where it does more than filter and project."""
    if body[1]["decls"]:
        return None
    keep, steps = F.lit(True), list(body[1]["ops"])
    while steps and steps[0][0] == "where" and not steps[0][1].get("search") and steps[0][1]["expr"][0] not in ("term", "regexp", "glob"):
        v = boolean_of(lower(steps.pop(0)[1]["expr"], r.env(plan.env)))
        keep = keep & (F.lit(False) if v.missing else F.coalesce(v.col, F.lit(False)))
    if not steps or steps == [("pass", {})]:
        return keep, {n: _plain(v) for n, v in r.columns().items()}
    (name, a), *more = steps
    if more or name not in ("cut", "put", "drop", "rename", "yield") or (name == "yield" and len(a["exprs"]) != 1):
        return None
    try:
        # an aggregate that runs along the rows of a leg isn't a projection, and fails as on a stream
        ops[name](_Probe(r.df, r.type, r.order, r.scope, r.locals, r.sorted_by), a, replace(plan, streaming=True))
    except _Fields as got:
        return None if not got.fields else (keep, {n: _plain(v) for n, v in got.fields.items()})
    except QueryError:
        return None
    return None


def together(r: Rel, bodies: list[tuple], index: Column | None, plan, ops: dict[str, Callable], fitted: Callable, target_of: Callable) -> Rel | None:
    """The legs as one relation: of a switch, where index tells a row's leg, or of a fork, where each leg has all rows."""
    if not r.is_record or not all(b[0] == "scope" for b in bodies):
        return None
    legs = [_leg(r, b, plan, ops) for b in bodies]
    if any(x is None for x in legs):
        return None
    target = target_of([f for _, f in legs])
    kinds = {n: next((x[n] for _, x in legs if n in x and x[n].type == t and x[n].ntz), Value(F.lit(None), t)) for n, t in target.items()}

    def column(fields: dict[str, Value], n: str) -> Column:
        st = "timestamp_ntz" if kinds[n].ntz else L.spark_type(target[n])
        return fitted(fields[n], target[n]).col.cast(st) if n in fields else F.lit(None).cast(st)

    if index is None:
        some = None
        for keep, _ in legs:
            some = keep if some is None else some | keep
        rows = F.array(*[F.when(keep, F.struct(*[column(f, n).alias(n) for n in target])) for keep, f in legs])
        df = r.df.where(some).select(*r.hidden, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("__e"))
        out = {n: Value(F.col("__e").getField(n), t, ntz=kinds[n].ntz) for n, t in target.items()}
        whole = replace(r, df=df, type=("record", []), order=[], sorted_by=()).project(out)
        return replace(whole, df=whole.df.drop("__e"), order=[])
    h = f"{R.HIDDEN}leg"
    at = index
    df = r.df.withColumn(h, at)
    keep = F.lit(False)
    cols: dict[str, Column] = {}
    for i, (own, f) in enumerate(legs):
        here = F.col(h) == i
        keep = keep | (here & own)
        for n in target:
            cols[n] = F.when(here, column(f, n)) if i == 0 else cols[n].when(here, column(f, n))
    inner = replace(r, df=df.where(keep), order=[], sorted_by=())
    out = inner.project({n: Value(c, target[n], ntz=kinds[n].ntz) for n, c in cols.items()})
    return replace(out, df=out.df.drop(h), order=[])
