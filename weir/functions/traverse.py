"""Traversal of nested values inside an expression, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.aggs import in_array
from weir.functions.exprs import Env, Value, boolean_of, const_of, lower, members, record, unify
from weir.lang.lexer import QueryError
from weir.plans import types as L


def elements(v: Value) -> tuple[Column, L.Type]:
    """What is traversed of a value, as an array: elements, {key,value} of a map or record, or the value itself."""
    t = L.under(v.type)
    if v.missing:
        return F.array().cast("array<string>"), L.NULL
    if t[0] in ("array", "set"):
        return v.col, t[1]
    if t[0] == "map":
        return F.map_entries(v.col), ("record", [("key", t[1]), ("value", t[2])])
    if t[0] == "record":
        fields = members(v)
        et, cols = unify(list(fields.values()))
        c = F.array(*[F.struct(F.array(F.lit(n)).alias("key"), x.alias("value")) for n, x in zip(fields, cols)])
        return c, ("record", [("key", ("array", L.STRING)), ("value", et)])
    return F.when(v.col.isNotNull(), F.array(v.col)), v.type


def all_elements(vs: list[Value]) -> tuple[Column, L.Type]:
    got = [elements(v) for v in vs]
    if len(got) == 1:
        return got[0]
    t = got[0][1]
    for _, x in got[1:]:
        t = x if L.is_prim(t, "null") else t if L.is_prim(x, "null") or t == x else L.promote(t, x) if L.is_number(t) and L.is_number(x) else L.STRING
    st = L.spark_type(t).simpleString()
    return F.concat(*[F.coalesce(c, F.array()).cast(f"array<{st}>") for c, _ in got]), t


def over_expression(args: dict, env: Env) -> Value:
    """(over e | body): an array of what the body gives, or the value of its last aggregate."""
    c, t = all_elements([lower(e, env) for e in args["exprs"]])
    env = env.child({n: lower(e, env) for n, e in args["locals"]})
    body = args["body"][1]["ops"] if args["body"] else []
    for name, a in body:
        item = lambda x, t=t: env.inside(Value(x, t))
        if name in ("where", "search"):
            c = F.filter(c, _one(lambda x: F.coalesce(boolean_of(lower(a["expr"], item(x))).col, F.lit(False))))
        elif name in ("yield", "name", "put", "cut"):
            if name == "yield" and len(a["exprs"]) != 1:
                raise QueryError("one expression can be yielded here")

            def one(x: Column, t=t, a=a, name=name) -> Value:
                scope = env.inside(Value(x, t))
                if name == "yield":
                    return lower(a["exprs"][0], scope)
                if name == "name":
                    return lower(("field", a["name"]), scope)
                fields = members(Value(x, t)) if name == "put" else {}
                for target, e in a["fields"]:
                    fields[(target or e)[-1]] = lower(e, scope)
                return record(fields)

            new = one(F.lit(None).cast(L.spark_type(t))).type
            c, t = F.transform(c, _one(lambda x: one(x).col)), new
        elif name == "call":
            e = ("call", a["name"], a["args"])
            new = lower(e, item(F.lit(None).cast(L.spark_type(t)))).type
            c, t = F.transform(c, _one(lambda x: lower(e, item(x)).col)), new
        elif name == "sort" and not a["by"]:
            c = F.array_sort(c)
            c = F.reverse(c) if a["reverse"] else c
        elif name in ("head", "tail"):
            n = int(const_of(lower(a["n"], env), "the number of values"))
            c = F.slice(c, 1, n) if name == "head" else F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), F.lit(n))
        elif name == "pass":
            pass
        elif name == "summarize" and not a["keys"]:
            got = {}
            for target, (_, agg, arg, where) in a["aggs"]:
                inner, it = c, t
                if where is not None:
                    inner = F.filter(inner, _one(lambda x: F.coalesce(boolean_of(lower(where, item(x))).col, F.lit(False))))
                if arg is not None and arg != ("this",):
                    it = lower(arg, item(F.lit(None).cast(L.spark_type(t)))).type
                    inner = F.transform(inner, _one(lambda x: lower(arg, item(x)).col))
                got[target[-1] if target else agg] = in_array(agg, inner, it)
            if len(got) == 1 and a["aggs"][0][0] is None:
                v = next(iter(got.values()))
            else:
                v = record(got)
            rest = body[body.index((name, a)) + 1 :]
            for n2, a2 in rest:
                scope = env.inside(v)
                if n2 == "yield" and len(a2["exprs"]) == 1:
                    v = lower(a2["exprs"][0], scope)
                elif n2 != "pass":
                    raise QueryError(f"{n2} can't follow an aggregate here")
            return v
        else:
            raise QueryError(f"{name} can't be used in an expression; give it as an operator")
    return Value(c, ("array", t))


def _one(f):
    """A function of exactly one argument, as Spark gives a second one an index."""
    return lambda x: f(x)
