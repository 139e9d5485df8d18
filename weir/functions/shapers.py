"""Shapers: records rebuilt at plan time from their own type and a target type."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions.exprs import Value, cast, failed, members, record
from weir.plans import types as L
from weir.plans.types import Type


def shaped(v: Value, t: Type, steps: tuple[str, ...]) -> Value:
    """v after cast, crop, fill and order, as far as steps name them; other values are only cast."""
    want = L.under(t)
    have = L.under(v.type)
    if v.missing:
        return v
    if want[0] == "record" and have[0] == "record":
        targets = dict(want[1])
        fields: dict[str, Value] = {}
        for n, x in members(v).items():
            if n in targets:
                fields[n] = shaped(x, targets[n], steps)
            elif "crop" not in steps:
                fields[n] = x
        if "fill" in steps:
            for n, x in want[1]:
                if n not in fields:
                    fields[n] = Value(F.lit(None).cast(L.spark_type(x)), x)
        if "order" in steps:
            # fields that the target doesn't name come last, by name
            names = [n for n, _ in want[1] if n in fields] + sorted(n for n in fields if n not in targets)
            fields = {n: fields[n] for n in names}
        out = record(fields)
        named = "cast" in steps and t[0] == "named" and out.type == want
        c = out.col if v.col is None else F.when(v.col.isNotNull(), out.col)
        return Value(c, t if named else out.type, err=failed(*fields.values()), message="shape: a field can't be cast")
    if want[0] in ("array", "set") and have[0] in ("array", "set"):
        probe = shaped(Value(F.lit(None).cast(L.spark_type(have[1])), have[1]), want[1], steps)
        c = F.transform(v.col, lambda x: shaped(Value(x, have[1]), want[1], steps).col)
        is_set = want[0] == "set" and "cast" in steps
        return Value(F.array_sort(F.array_distinct(c)) if is_set else c, ("set" if is_set else have[0], probe.type), err=v.err)
    return cast(v, t) if "cast" in steps else v
