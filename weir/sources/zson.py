"""The text format at plan time."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.dynamic import values as V
from weir.functions.exprs import Value
from weir.plans import types as L


def parse_value(s: str) -> Value:
    """A text that is known when planning, as a typed literal."""
    from weir.sources.readers import plain

    v = V.parse(s)
    data = plain(v, v.type)

    def lit(x: object, t: tuple):
        u = L.under(t)
        st = L.spark_type(u)
        if x is None:
            return F.lit(None).cast(st)
        if u[0] == "record":
            return F.struct(*[lit(x[n], y).alias(n) for n, y in u[1]])
        if u[0] in ("array", "set"):
            return F.array(*[lit(y, u[1]) for y in x]).cast(st)
        if u[0] == "map":
            return F.map_from_arrays(F.array(*[lit(a, u[1]) for a, _ in x]), F.array(*[lit(b, u[2]) for _, b in x]))
        if L.is_prim(u, "time"):
            return F.timestamp_micros(F.lit(x))
        if L.is_prim(u, "bytes"):
            return F.lit(bytearray(x))
        if u[0] == "error":
            return F.struct(F.lit(x["message"]).alias("message"), F.lit(x["on"]).cast("string").alias("on"))
        return F.lit(x).cast(st)

    return Value(lit(data, v.type), v.type, const=data if not isinstance(data, (dict, list)) else s)
