"""Operators to DataFrame transformations.

A sequence maps a list of relations (one, or the legs of a fork) to another.
Sorting is recorded and only done where rows leave the pipeline or an operator
takes the first of them, so sorts that nothing reads cost nothing.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.functions.aggs import aggregate
from weir.functions.exprs import Env, Value, boolean_of, const_of, error_col, lower, members, record, search_term, to_text, unify
from weir.functions.traverse import all_elements
from weir.lang.lexer import QueryError
from weir.lang.parser import AGGREGATES, field_name
from weir.operators import rel as R
from weir.operators.legs import Legs, together
from weir.operators.pruning import with_filters
from weir.operators.rel import Rel
from weir.operators.running import exact_sum, first_of_runs, in_ranges
from weir.operators.running import running as spread
from weir.operators.running import spreads
from weir.plans import types as L

_ids = itertools.count()


def _hidden(what: str) -> str:
    return f"{R.HIDDEN}{what}{next(_ids)}"


@dataclass
class Plan:
    """What a query needs from outside, and its side results."""

    #: gives the relation of a source operator
    source: object
    env: Env
    ops: dict[str, tuple[list[str], tuple, Env]] = field(default_factory=dict)
    outputs: dict[str, Rel] = field(default_factory=dict)
    strict: bool = False
    #: streaming input: no global order, no row numbers
    streaming: bool = False
    depth: int = 0


def run_scope(scope: tuple, rels: list[Rel] | None, plan: Plan) -> list[Rel]:
    decls, ops = scope[1]["decls"], scope[1]["ops"]
    plan = replace(plan, ops=dict(plan.ops), env=replace(plan.env, names=dict(plan.env.names), funcs=dict(plan.env.funcs), types=dict(plan.env.types)))
    for d in decls:
        if d[0] == "const":
            v = lower(d[2], replace(plan.env, fields={}, this=lambda: Value(F.lit(None).cast("string"), L.NULL)))
            plan.env.names[d[1]] = v
        elif d[0] == "type":
            plan.env.types[d[1]] = plan.env.resolve(d[2])
        elif d[0] == "func":
            plan.env.funcs[d[1]] = (d[2], d[3], None)
        else:
            plan.ops[d[1]] = (d[2], d[3], plan.env)
    for op in with_filters(ops):
        rels = run_op(op, rels, plan)
    return rels if rels is not None else []


def combined(rels: list[Rel]) -> Rel:
    """The legs as one relation: fields of all, absent ones null; order is lost."""
    if len(rels) == 1:
        return rels[0]
    if isinstance(rels, Legs) and rels.whole is not None:
        return rels.whole
    if not rels:
        raise QueryError("there is no input")
    if not all(r.is_record for r in rels):
        if any(r.is_record for r in rels):
            rels = [r if not r.is_record else r.yielding(Value(F.to_json(r.this().col), L.STRING)) for r in rels]
        t, _ = unify([r.this() for r in rels])
        rels = [r.yielding(replace(r.this(), col=to_text(r.this()) if L.is_prim(t, "string") and r.type != t else r.this().col.cast(L.spark_type(t)), type=t)) for r in rels]
    else:
        target = _merged([L.under(r.type)[1] for r in rels])
        out = []
        for r in rels:
            have = r.columns()
            fields = {n: _fitted(have[n], t) if n in have else Value(F.lit(None).cast(_spark_of(n, rels, t)), t) for n, t in target.items()}
            out.append(r.project(fields))
        rels = out
    first = rels[0]
    scope = first.scope
    keep = [*scope, *[h for h in first.hidden if h not in scope and all(h in r.hidden for r in rels)]]
    df = None
    for r in rels:
        shown = [c for c in r.df.columns if not c.startswith(R.HIDDEN)]
        d = r.df.select(*keep, *[F.col(R._q(c)) for c in shown])
        df = d if df is None else df.unionByName(d, allowMissingColumns=True)
    return Rel(df, first.type, [], scope, first.locals)


def _merged(records: list[list[tuple[str, L.Type]]]) -> dict[str, L.Type]:
    """The fields of all records; of unlike types the wider one, or text."""
    target: dict[str, L.Type] = {}
    for fields in records:
        for n, x in fields:
            t = x if n not in target else target[n] if target[n] == x else L.promote(target[n], x) if L.is_number(target[n]) and L.is_number(x) else L.merge(target[n], x)
            target[n] = t if L.under(t)[0] != "union" else L.STRING
    return target


def _legs(r: Rel, bodies: list[tuple], index, rels: list[Rel], plan: Plan) -> Legs:
    out = Legs(rels)
    out.whole = together(r, bodies, index, plan, _OPS, _fitted, lambda legs: _merged([[(n, v.type) for n, v in f.items()] for f in legs])) if len(rels) > 1 else None
    return out


def _spark_of(n: str, rels: list[Rel], t: L.Type):
    """The Spark type of a field where some leg has it (a timestamp may lack a zone)."""
    for r in rels:
        if n in r.df.columns and dict(L.under(r.type)[1])[n] == t:
            return r.df.schema[n].dataType
    return L.spark_type(t)


def _fitted(v: Value, t: L.Type) -> Value:
    from weir.functions.shapers import shaped

    if v.type == t:
        return v
    if L.is_prim(t, "string"):
        return Value(to_text(v), t)
    if L.under(t)[0] == "record":
        return shaped(v, t, ("cast", "fill", "order"))
    return Value(v.col.cast(L.spark_type(t)), t)


def run_op(op: tuple, rels: list[Rel] | None, plan: Plan) -> list[Rel] | None:
    name, a = op
    if name == "scope":
        return run_scope(op, rels, plan)
    if name in ("pool", "file", "get"):
        return [plan.source(name, a)]
    if name == "fromall":
        out = []
        for (kind, args), body in a["trunks"]:
            got = rels if kind == "pass" else [plan.source(kind, args)]
            out += run_scope(body, got, plan) if body is not None else got
        return out
    if name == "fork":
        r = combined(rels)
        return _legs(r, a["legs"], None, [combined(run_scope(leg, [r], plan)) for leg in a["legs"]], plan)
    if name == "join" and a["right"] is None:
        if len(rels) != 2:
            raise QueryError("join needs two inputs")
        return [join(rels[0], rels[1], a, plan)]
    if name == "join":
        return [join(combined(rels), combined(run_scope(a["right"], None, plan)), a, plan)]
    if name == "merge":
        return [merge(rels, a, plan)]
    if name == "name":
        n = a["name"]
        if n in plan.ops:
            return run_op(("call", {"name": n, "args": []}), rels, plan)
        r = combined(rels)
        if n in r.columns() or n in r.env(plan.env).names or (not r.is_record):
            return [yield_(r, {"exprs": [("field", n)]}, plan)]
        return [where(r, {"expr": ("term", "string", n), "search": True}, plan)]
    if name == "call":
        if a["name"] in plan.ops:
            return call_op(a, rels, plan)
        e = ("call", a["name"], a["args"])
        r = combined(rels)
        v = lower(e, r.env(plan.env))
        from weir.lang.parser import BOOL_FUNCTIONS

        return [where(r, {"expr": e}, plan)] if a["name"] in BOOL_FUNCTIONS else [r.yielding(v)]
    if name == "switch":
        return switch(combined(rels), a, plan)
    if name == "combine":
        return [combined(rels)]
    return [_OPS[name](combined(rels), a, plan)]


def call_op(a: dict, rels: list[Rel], plan: Plan) -> list[Rel]:
    params, body, _ = plan.ops[a["name"]]
    if len(params) != len(a["args"]):
        raise QueryError(f"{a['name']}: expected {len(params)} arguments")
    if plan.depth > 32:
        raise QueryError(f"{a['name']}: an operator can't call itself")
    bound = dict(zip(params, a["args"]))
    return run_scope(substitute(body, bound), rels, replace(plan, depth=plan.depth + 1))


def substitute(tree, bound: dict):
    """A syntax tree with the parameters of an operator replaced by their arguments."""
    if isinstance(tree, tuple) and len(tree) == 2 and tree[0] == "field" and tree[1] in bound:
        return bound[tree[1]]
    if isinstance(tree, tuple) and len(tree) == 2 and tree[0] == "name" and isinstance(tree[1], dict) and tree[1].get("name") in bound:
        return ("yield", {"exprs": [bound[tree[1]["name"]]]})
    if isinstance(tree, tuple):
        return tuple(substitute(x, bound) for x in tree)
    if isinstance(tree, list):
        return [substitute(x, bound) for x in tree]
    if isinstance(tree, dict):
        return {k: substitute(v, bound) for k, v in tree.items()}
    return tree


# projection and filtering


def where(r: Rel, a: dict, plan: Plan) -> Rel:
    env = _running(r, plan)
    e = a["expr"]
    if a.get("search") or e[0] in ("term", "regexp", "glob"):
        return r.filter(search_term(e, env))
    v = boolean_of(lower(e, env))
    return r.filter(v.col if not v.missing else F.lit(False))


def search(r: Rel, a: dict, plan: Plan) -> Rel:
    return where(r, {"expr": a["expr"]}, plan)


def put_path(fields: dict[str, Value], path: list[str], v: Value) -> None:
    """Sets a nested field in a record's fields, making records on the way."""
    n = path[0]
    if len(path) == 1:
        fields[n] = v
        return
    inner = members(fields[n]) if n in fields and L.under(fields[n].type)[0] == "record" else {}
    put_path(inner, path[1:], v)
    fields[n] = record(inner)


def lvalue(e: tuple, env: Env) -> list[str]:
    if e[0] == "field":
        return [e[1]]
    if e[0] == "this":
        return []
    if e[0] == "dot":
        return [*lvalue(e[1], env), e[2]]
    if e[0] == "index":
        return [*lvalue(e[1], env), str(const_of(lower(e[2], env), "the name of a field"))]
    if e[0] in ("call", "agg", "cast"):
        return [field_name(e)]
    raise QueryError("a field is needed on the left of ':='")


def cut(r: Rel, a: dict, plan: Plan) -> Rel:
    env = _running(r, plan)
    fields: dict[str, Value] = {}
    for target, e in a["fields"]:
        v = lower(e, env)
        if not v.quiet:
            path = lvalue(target if target is not None else e, env) if target is not None or e[0] in ("field", "dot", "index", "this") else [field_name(e)]
            put_path(fields, path, v)
    return r.project(fields)


def put(r: Rel, a: dict, plan: Plan) -> Rel:
    if not r.is_record:
        raise QueryError("put: the input isn't a record")
    env = _running(r, plan)
    fields = r.columns()
    new = [(lvalue(t, env), lower(e, env)) for t, e in a["fields"]]
    for path, v in new:
        put_path(fields, path, v)
    out = r.project(fields)
    return replace(out, sorted_by=() if any(p[0] in r.sorted_by for p, _ in new) else out.sorted_by)


def _dropped(fields: dict[str, Value], path: list[str]) -> None:
    n = path[0]
    if n not in fields:
        return
    if len(path) == 1:
        del fields[n]
        return
    inner = members(fields[n])
    if inner:
        _dropped(inner, path[1:])
        if inner:
            fields[n] = record(inner)
        else:
            del fields[n]


def drop(r: Rel, a: dict, plan: Plan) -> Rel:
    env, fields = r.env(plan.env), r.columns()
    for e in a["fields"]:
        _dropped(fields, lvalue(e, env))
    if not fields and r.columns():
        return replace(r, df=r.df.where(F.lit(False)))
    return r.project(fields)


def rename(r: Rel, a: dict, plan: Plan) -> Rel:
    env, fields = r.env(plan.env), r.columns()
    for t, e in a["fields"]:
        new, old = lvalue(t, env), lvalue(e, env)
        if new[:-1] != old[:-1]:
            raise QueryError("rename: a field can't move to another record")
        fields = _renamed(fields, old, new[-1])
    return r.project(fields)


def _renamed(fields: dict[str, Value], path: list[str], new: str) -> dict[str, Value]:
    n = path[0]
    if n not in fields:
        return fields
    if len(path) > 1:
        return {k: record(_renamed(members(v), path[1:], new)) if k == n else v for k, v in fields.items()}
    if new in fields and new != n:
        raise QueryError(f"rename: duplicate field: {new!r}")
    return {new if k == n else k: v for k, v in fields.items()}


def yield_(r: Rel, a: dict, plan: Plan) -> Rel:
    env = _running(r, plan)
    vs = [v for v in (lower(e, env) for e in a["exprs"]) if not v.quiet]
    if not vs:
        return replace(r, df=r.df.where(F.lit(False)))
    if len(vs) == 1:
        if L.under(vs[0].type)[0] == "record" and a["exprs"][0][0] == "record":
            # a record literal is a projection
            fields: dict[str, Value] = {}
            for x in a["exprs"][0][1]:
                if x[0] == "spread":
                    fields.update(r.columns() if x[1][0] == "this" else members(lower(x[1], env)))
                else:
                    fields[x[1]] = lower(x[2], env)
            fields = {n: v for n, v in fields.items() if not v.quiet}
            return r.project(fields) if fields else r.yielding(vs[0])
        return r.yielding(vs[0])
    if all(L.under(v.type)[0] == "record" for v in vs):
        t = vs[0].type
        for v in vs[1:]:
            t = L.merge(t, v.type)
        from weir.functions.shapers import shaped

        cols = [shaped(v, t, ("cast", "fill", "order")).col for v in vs]
    else:
        t, cols = unify(vs)
    return r.yielding(Value(F.explode(F.array(*cols)), t)) if L.under(t)[0] != "record" else _exploded(r, F.array(*cols), t)


def _exploded(r: Rel, c, t: L.Type, outer: bool = False) -> Rel:
    """One row for each element of an array column."""
    df = r.df.select(*r.hidden, F.explode(c).alias("__e"))
    out = replace(r, df=df, type=("record", []), sorted_by=())
    return out.yielding(Value(F.col("__e"), t))


def pass_(r: Rel, a: dict, plan: Plan) -> Rel:
    return r


def assert_(r: Rel, a: dict, plan: Plan) -> Rel:
    """Rows for which it doesn't hold carry an error with the expression and the row; under strict the query fails."""
    v = boolean_of(lower(a["expr"], r.env(plan.env)))
    ok = F.coalesce(v.col, F.lit(False))
    if plan.strict:
        return r.filter(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit(f"assertion failed: {a['text']}: "), F.to_json(r.this().col) if r.is_record else to_text(r.this())))))
    err = F.when(~ok, F.struct(F.lit(f"assertion failed: {a['text']}").alias("message"), (F.to_json(r.this().col) if r.is_record else to_text(r.this())).alias("on")))
    fields = r.columns() if r.is_record else {"this": r.this()}
    return r.project({**fields, "error": Value(err, ("error", L.STRING))})


def fuse(r: Rel, a: dict, plan: Plan) -> Rel:
    return r  # all rows of a relation have its one type already


def shape_op(r: Rel, a: dict, plan: Plan) -> Rel:
    """Floats that hold whole numbers only become integers; the one pass over the data is an aggregate."""
    if not r.is_record:
        return r
    floats = {n: v for n, v in r.columns().items() if L.is_float(v.type)}
    if not floats or plan.streaming:
        return r
    whole = r.df.agg(*[F.bool_and(v.col == F.floor(v.col)).alias(n) for n, v in floats.items()]).first()
    fields = {n: Value(v.col.cast("bigint"), L.INT64) if n in floats and whole[n] else v for n, v in r.columns().items()}
    return r.project(fields)


def sample(r: Rel, a: dict, plan: Plan) -> Rel:
    """One value of each type: a relation has one."""
    v = lower(a["expr"], r.env(plan.env))
    if a["expr"][0] == "this":
        return replace(r, df=r.df.limit(1))
    out = r.yielding(v)
    return replace(out, df=out.df.limit(1), order=[])


# order


def sort(r: Rel, a: dict, plan: Plan) -> Rel:
    env = r.env(plan.env)
    by = a["by"]
    if not by:
        by = [(e, None) for e in _guessed(r)]
    order, cols, names = [], {}, []
    for e, direction in by:
        v = lower(e, env)
        desc = (direction == "desc") != a["reverse"]
        first = a["nulls"] == "first"
        c = v.col
        t = L.under(v.type)
        if L.is_prim(t, "ip"):
            from weir.functions.exprs import ip_key

            c = ip_key(c)
        elif t[0] == "map":
            c = F.array_sort(F.map_entries(c))
        h = _hidden("ord")
        cols[h] = c
        order.append((h, desc, first))
        names.append(e[1] if e[0] == "field" else None)
    df = r.df.select("*", *[c.alias(h) for h, c in cols.items()])
    # the sort is stable: an earlier order decides ties
    return replace(r, df=df, order=order + r.order, sorted_by=tuple(names) if all(names) else ())


def _guessed(r: Rel) -> list[tuple]:
    if not r.is_record:
        return [("this",)]
    fields = L.under(r.type)[1]
    for test in (L.is_int, L.is_float, lambda t: not L.is_prim(t, "time") and L.under(t)[0] == "prim"):
        for n, t in fields:
            if test(t):
                return [("field", n)]
    return [("field", fields[0][0])] if fields else []


def head(r: Rel, a: dict, plan: Plan) -> Rel:
    n = _count(a["n"], r, plan)
    if r.scope:
        h = _hidden("rn")
        df = r.df.withColumn(h, F.row_number().over(_scoped(r))).where(F.col(h) <= n).drop(h)
        return replace(r, df=df)
    df = r.df.orderBy(*r.order_by()) if r.order else r.df
    return replace(r, df=df.limit(n))


def tail(r: Rel, a: dict, plan: Plan) -> Rel:
    n = _count(a["n"], r, plan)
    r = _ordered(r)
    back = [_reverse(o) for o in r.order]
    if r.scope:
        h = _hidden("rn")
        w = Window.partitionBy(*r.scope).orderBy(*[R._directed(F.col(c), d, f) for c, d, f in back])
        return replace(r, df=r.df.withColumn(h, F.row_number().over(w)).where(F.col(h) <= n).drop(h))
    return replace(r, df=r.df.orderBy(*[R._directed(F.col(c), d, f) for c, d, f in back]).limit(n))


def _reverse(o: tuple[str, bool, bool]) -> tuple[str, bool, bool]:
    return (o[0], not o[1], not o[2])


def _ordered(r: Rel) -> Rel:
    """With an order: the place in the scan where none was given."""
    if r.order:
        return r
    h = _hidden("ord")
    return replace(r, df=r.df.withColumn(h, F.monotonically_increasing_id()), order=[(h, False, False)])


def _scoped(r: Rel):
    r_order = r.order_by()
    w = Window.partitionBy(*r.scope) if r.scope else Window.partitionBy()
    return w.orderBy(*r_order) if r_order else w.orderBy(F.lit(0))


def _count(e: tuple, r: Rel, plan: Plan) -> int:
    n = const_of(lower(e, r.env(plan.env)), "the number of values")
    if not isinstance(n, int) or n < 0:
        raise QueryError("the number of values must be a positive integer")
    return n


def top(r: Rel, a: dict, plan: Plan) -> Rel:
    by = a["by"] or [e for e in _guessed(r)]
    out = sort(replace(r, order=[]), {"by": [(e, "desc") for e in by], "reverse": False, "nulls": None}, plan)
    return head(out, {"n": a["n"]}, plan)


def uniq(r: Rel, a: dict, plan: Plan) -> Rel:
    """Adjacent repeats. Rows sorted by all their fields are grouped, which needs no order; else neighbours are compared in order."""
    fields = r.columns() if r.is_record else {"this": r.this()}
    names = list(fields)
    if set(names) <= set(r.sorted_by) and r.order:
        # keys of the order that are fields themselves are had again after grouping
        again = {h: n for (h, _, _), n in zip(r.order, r.sorted_by) if n in fields and not L.is_prim(fields[n].type, "ip") and L.under(fields[n].type)[0] != "map"}
        g = r.df.groupBy(*r.scope, *[F.col(R._q(n)) for n in names]).agg(F.count(F.lit(1)).alias("__count"), *[F.any_value(h).alias(h) for h in r.hidden if h not in r.scope and h not in again])
        out = replace(r, df=g.withColumns({h: F.col(R._q(n)) for h, n in again.items()}))
    else:
        r = _ordered(r)
        key = F.struct(*[F.to_json(v.col) if L.under(v.type)[0] == "map" else v.col for v in fields.values()])
        if not a["count"] and in_ranges(r):
            return replace(r, df=first_of_runs(r, key))
        h, k = _hidden("new"), _hidden("grp")
        df = r.df.withColumn(h, F.coalesce(~key.eqNullSafe(F.lag(key).over(_scoped(r))), F.lit(True)) | F.lag(F.lit(1)).over(_scoped(r)).isNull())
        if not a["count"]:
            return replace(r, df=df.where(h).drop(h))
        w = _scoped(r).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(k, F.sum(F.col(h).cast("bigint")).over(w))
        g = df.groupBy(*r.scope, k).agg(F.count(F.lit(1)).alias("__count"), *[F.min_by(F.col(R._q(c)), F.struct(*[F.col(o[0]) for o in r.order])).alias(c) for c in r.df.columns if c not in r.scope])
        out = replace(r, df=g.drop(k))
    if not a["count"]:
        return replace(out, df=out.df.drop("__count"))
    v = {"value": record(out.columns()) if r.is_record else out.this(), "count": Value(F.col("__count"), L.UINT64)}
    done = out.project(v)
    return replace(done, df=done.df.drop("__count"), sorted_by=())


def merge(rels: list[Rel], a: dict, plan: Plan) -> Rel:
    r = combined(rels)
    return sort(r, {"by": a["by"], "reverse": False, "nulls": None}, plan)


# grouping


def _list_in_order(r: Rel):
    """Collects a column as a list in the order of rows."""
    if not r.order:
        return None

    def collect(c, sortable=True):
        got = F.collect_list(F.when(c.isNotNull(), F.struct(*[F.col(o[0]) for o in r.order], c.alias("_v"))))
        if sortable and all(not desc and not first for _, desc, first in r.order):
            # nulls last, and then by value, as structs are ordered
            keyed = F.collect_list(F.when(c.isNotNull(), F.struct(*[x for o in r.order for x in (F.col(o[0]).isNull().alias(f"{o[0]}n"), F.col(o[0]).alias(o[0]))], c.alias("_v"))))
            return F.transform(F.array_sort(keyed), lambda x: x["_v"])

        def compare(x, y):
            out = F.lit(0)
            for i in range(len(r.order) - 1, -1, -1):
                h, desc, first = r.order[i]
                p, q = x[h], y[h]
                s = 1 if not desc else -1
                n = -1 if first else 1
                out = F.when(p.isNull() & q.isNull(), out).when(p.isNull(), n).when(q.isNull(), -n).when(p < q, -s).when(p > q, s).otherwise(out)
            return out

        return F.transform(F.array_sort(got, compare), lambda x: x["_v"])

    return collect


def summarize(r: Rel, a: dict, plan: Plan) -> Rel:
    env = r.env(plan.env)
    keys: dict[str, Value] = {}
    for target, e in a["keys"]:
        v = lower(e, env)
        if v.quiet:
            return replace(r, df=r.df.where(F.lit(False)))
        path = lvalue(target, env) if target is not None else lvalue(e, env) if e[0] in ("field", "dot", "index") else [field_name(e)]
        name = ".".join(path)
        keys[name] = v
    renamed: list[tuple[list[str], str]] = []
    aggs: dict[str, Value] = {}
    for target, (_, name, arg, cond) in a["aggs"]:
        v = None if arg is None else lower(arg, env)
        w = None if cond is None else F.coalesce(boolean_of(lower(cond, env)).col, F.lit(False))
        path = lvalue(target, env) if target is not None else [name]
        n = ".".join(path)
        base, k = n, 2
        while n in aggs:  # two aggregates of one name
            n, k = f"{base}_{k}", k + 1
        aggs[n] = aggregate(name, v, w, _list_in_order(r))
        renamed.append((path, n))
    pre = r.df
    gk = []
    from weir.functions.exprs import error_type

    types: list[tuple[str, L.Type]] = []
    for n, v in keys.items():
        t = error_type(v) if v.missing else v.type
        c = error_col(v) if v.missing else v.col
        c = c.cast("string") if L.is_prim(t, "null") else c
        gk.append(c.alias(f"__k_{n}"))
        types.append((n, t))
    local_cols = [c for c in r.hidden if c.startswith(f"{R.HIDDEN}local")]
    if aggs:
        g = pre.groupBy(*r.scope, *gk).agg(*[v.col.alias(f"__a_{n}") for n, v in aggs.items()], *[F.any_value(c).alias(c) for c in local_cols])
    else:
        g = pre.select(*r.scope, *local_cols, *gk).distinct()
    cols = [F.col(c) for c in (*r.scope, *local_cols)]
    for n, t in types:
        meta = L.metadata(t)
        cols.append(F.col(R._q(f"__k_{n}")).alias(n, metadata=meta) if meta else F.col(R._q(f"__k_{n}")).alias(n))
    for n, v in aggs.items():
        types.append((n, v.type))
        meta = L.metadata(v.type)
        c = F.col(R._q(f"__a_{n}"))
        cols.append(c.alias(n, metadata=meta) if meta else c.alias(n))
    out = Rel(g.select(*cols), ("record", types), [], r.scope, r.locals)
    if len(aggs) == 1 and not keys and a["aggs"][0][0] is None:
        only = next(iter(out.columns().values()))
        return out.yielding(only)
    nested = [(p, n) for p, n in [*(([*k.split(".")], k) for k in keys), *renamed] if len(p) > 1]
    if nested:
        have, fields = out.columns(), {}
        for n, v in have.items():
            p = next((p for p, m in nested if m == n), [n])
            put_path(fields, p, v)
        out = out.project(fields)
    return out


def _running(r: Rel, plan: Plan) -> Env:
    """The scope of an operator's expressions, where an aggregate runs along the rows in order."""

    def running(name: str, arg: Value | None, where: object) -> Value:
        if plan.streaming:
            raise QueryError("a running aggregate needs a bounded input")
        if spreads(r, name):
            return spread(r, name, arg, where)
        if name == "avg" and arg is not None and not arg.missing and L.is_int(L.under(arg.type)) and spreads(r, "sum"):
            # of integers, whose sums are exact, so that ranges don't change the rounding
            total, many = (spread(r, k, arg, F.coalesce(where, F.lit(False)) & arg.col.isNotNull() if where is not None else arg.col.isNotNull(), "double") for k in ("sum", "count"))
            return Value(total.col / F.nullif(many.col, F.lit(0)), L.FLOAT64)
        w = _scoped(r if r.order else _unordered(r)).rowsBetween(Window.unboundedPreceding, 0)
        v = aggregate(name, arg, where)
        wide = exact_sum(arg, where) if name == "sum" else None
        if wide is not None:
            return replace(v, col=wide.over(w).try_cast("bigint"))
        return replace(v, col=v.col.over(w)) if name not in ("collect", "union", "dcount", "collect_map") else _running_list(name, arg, where, w)

    return replace(r.env(plan.env), running=running)


def _running_list(name, arg, where, w) -> Value:
    c = arg.col if where is None else F.when(where, arg.col)
    got = F.collect_list(c).over(w)
    if name == "collect":
        return Value(got, ("array", arg.type))
    if name == "union":
        return Value(F.array_sort(F.array_distinct(got)), ("set", arg.type))
    if name == "dcount":
        return Value(F.size(F.array_distinct(got)).cast("bigint"), L.UINT64)
    raise QueryError("collect_map can't run along rows")


def _unordered(r: Rel) -> Rel:
    return replace(r, order=[], scope=r.scope)


# several inputs


def join(left: Rel, right: Rel, a: dict, plan: Plan) -> Rel:
    style = a["style"]
    le, re_ = a["on"]
    if style == "right":
        left, right, le, re_ = right, left, re_, le
    lenv, renv = left.env(plan.env), right.env(plan.env)
    lk, rk = lower(le, lenv), lower(re_, renv)
    # rows without the key are in neither side, and keys of unlike types are never equal
    never = lk.missing or rk.missing or (not (L.is_number(lk.type) and L.is_number(rk.type)) and lk.type != rk.type and not L.is_prim(lk.type, "null") and not L.is_prim(rk.type, "null"))
    if never and style in ("inner", "anti"):
        return replace(left, df=left.df.where(F.lit(False))) if lk.missing or style == "inner" else left
    fields = left.columns()
    new: dict[str, Value] = {}
    if style != "anti":
        for target, e in a["fields"]:
            v = lower(e, renv)
            path = lvalue(target, renv) if target is not None else lvalue(e, renv) if e[0] in ("field", "dot", "index") else [field_name(e)]
            new[path[-1]] = v
    jk = _hidden("jk")
    sel = [rk.col.alias(jk)] + [v.col.alias(f"__r_{n}") for n, v in new.items() if not v.missing]
    rdf = right.df.select(*sel)
    if never:
        left = replace(left, df=left.df.where(F.lit(not lk.missing)))
        for n, v in new.items():
            name, k = n, 2
            while name in fields:
                name, k = f"{n}_{k}", k + 1
            st = L.spark_type(v.type)
            fields[name] = v if v.missing else Value(F.lit(None).cast("timestamp_ntz" if v.ntz else st), v.type, ntz=v.ntz)
        return left.project(fields)
    how = {"inner": "inner", "left": "left", "right": "left", "anti": "left_anti"}[style]
    # null matches null, as the join key of a hash join
    df = left.df.join(rdf, lk.col.eqNullSafe(F.col(jk)), how)
    out = replace(left, df=df)
    if style == "anti":
        return out
    for n, v in new.items():
        name, k = n, 2
        while name in fields:
            name, k = f"{n}_{k}", k + 1
        fields[name] = v if v.missing else Value(F.col(R._q(f"__r_{n}")), v.type, ntz=v.ntz)
    done = out.project(fields)
    return replace(done, df=done.df.drop(jk, *[f"__r_{n}" for n in new]))


def switch(r: Rel, a: dict, plan: Plan) -> list[Rel]:
    """Each row goes to its first case; the default takes the rest, wherever it stands."""
    env = r.env(plan.env)
    value = None if a["value"] is None else lower(a["value"], env)
    index = None
    default = None
    for i, (case, _) in enumerate(a["cases"]):
        if case is None:
            default = i
            continue
        if value is not None:
            from weir.functions.exprs import equals

            c = equals(value, lower(case, env))
        else:
            c = F.coalesce(boolean_of(lower(case, env)).col, F.lit(False))
        index = F.when(c, i) if index is None else index.when(c, i)
    if value is not None and value.missing:
        index = F.lit(None).cast("int")
        default = None
    h = _hidden("case")
    index = F.lit(default) if index is None else index.otherwise(F.lit(default).cast("int")) if default is not None and value is None or (value is not None and not value.missing and default is not None) else index
    routed = r.df.withColumn(h, index)
    out = []
    for i, (_, body) in enumerate(a["cases"]):
        leg = replace(r, df=routed.where(F.col(h) == i).drop(h))
        out.append(combined(run_scope(body, [leg], plan)))
    return _legs(r, [body for _, body in a["cases"]], index, out, plan) if index is not None else out


# nested values


def over(r: Rel, a: dict, plan: Plan) -> Rel:
    env = r.env(plan.env)
    c, t = all_elements([lower(e, env) for e in a["exprs"]])
    if a["body"] is None:
        return _exploded(r, c, t)
    scope = _hidden("scope")
    locals_, cols = dict(r.locals), []
    for n, e in a["locals"]:
        h = _hidden("local")
        v = lower(e, env)
        cols.append(v.col.alias(h))
        locals_[n] = Value(F.col(h), v.type, ntz=v.ntz)
    pos = _hidden("ord")
    base = r.df.select(*r.hidden, *cols, F.monotonically_increasing_id().alias(scope), c.alias("__c"))
    df = base.select(*[x for x in base.columns if x != "__c"], F.posexplode("__c").alias(pos, "__e"))
    inner = replace(r, df=df, type=("record", []), scope=[*r.scope, scope], locals=locals_, order=[(pos, False, False)])
    inner = inner.yielding(Value(F.col("__e"), t))
    out = combined(run_scope(a["body"], [inner], plan))
    drop_ = [scope] + [v.col for n, v in locals_.items() if n not in r.locals]
    df = out.df
    df = df.drop(scope, *[h for h in df.columns if h.startswith(f"{R.HIDDEN}local") and h not in r.hidden])
    del drop_
    order = [o for o in r.order if o[0] in df.columns]
    return Rel(df, out.type, order, r.scope, r.locals)


def explode(r: Rel, a: dict, plan: Plan) -> Rel:
    """Every value of a type that lies in the expressions."""
    env = r.env(plan.env)
    want = env.resolve(a["type"])
    parts = []

    def walk(v: Value) -> None:
        t = L.under(v.type)
        if v.missing:
            return
        if t == L.under(want):
            parts.append(F.array(v.col))
        elif t[0] == "record":
            for x in members(v).values():
                walk(x)
        elif t[0] in ("array", "set") and L.under(t[1]) == L.under(want):
            parts.append(v.col)
        elif t[0] == "map":
            if L.under(t[1]) == L.under(want):
                parts.append(F.map_keys(v.col))
            if L.under(t[2]) == L.under(want):
                parts.append(F.map_values(v.col))
        elif t[0] in ("array", "set") and L.under(t[1])[0] in ("record", "array"):
            inner: list = []

            def leaf(x, ty=t[1]):
                nonlocal parts
                kept, parts = parts, []
                walk(Value(x, ty))
                got, parts = parts, kept
                return F.concat(*got) if got else None

            if leaf(F.lit(None).cast(L.spark_type(t[1]))) is not None:
                parts.append(F.flatten(F.transform(v.col, lambda x: leaf(x))))
            del inner

    for e in a["exprs"]:
        walk(lower(e, env))
    if not parts:
        return replace(r.project({a["as"]: Value(F.lit(None).cast(L.spark_type(want)), want)}), df=r.project({a["as"]: Value(F.lit(None).cast(L.spark_type(want)), want)}).df.where(F.lit(False)))
    st = L.spark_type(want).simpleString()
    c = F.filter(F.concat(*[F.coalesce(p, F.array()).cast(f"array<{st}>") for p in parts]), lambda x: x.isNotNull())
    return r.project({a["as"]: Value(F.explode(c), want)})


# side results


def output(r: Rel, a: dict, plan: Plan) -> Rel:
    plan.outputs[a["name"]] = r
    return r


def debug(r: Rel, a: dict, plan: Plan) -> Rel:
    v = lower(a["expr"], r.env(plan.env))
    plan.outputs["debug"] = r if a["expr"][0] == "this" else r.yielding(v)
    return r


def load(r: Rel, a: dict, plan: Plan) -> Rel:
    return of_df(plan.source("load", {**a, "df": r.result(ordered=False)}))


def of_df(df: DataFrame) -> Rel:
    return R.of(df)


_OPS = {
    "where": where, "search": search, "cut": cut, "put": put, "drop": drop, "rename": rename, "yield": yield_, "pass": pass_, "assert": assert_, "fuse": fuse, "shape": shape_op, "sample": sample,
    "sort": sort, "head": head, "tail": tail, "top": top, "uniq": uniq, "summarize": summarize, "over": over, "explode": explode, "output": output, "debug": debug, "load": load,
}

__all__ = ["AGGREGATES", "Plan", "run_scope"]
