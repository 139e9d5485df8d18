"""Pipelines over self-describing values, on lists and on Spark.

On Spark a sequence is a DataFrame (v: a value's text, k: bytes that give its
place). Operators on single values run together in one Arrow pass; grouping
adds up partial states before its shuffle; sorting is by encoded keys.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.dynamic import values as V
from weir.dynamic.evaluate import Scope, boolean, evaluate, field_name, get, truth
from weir.dynamic.values import NULL, Val, failure
from weir.lang.lexer import QueryError
from weir.lang.parser import parse
from weir.operators.lower import substitute
from weir.plans import types as L

SCHEMA = "v string, k binary"
#: Groups that a task holds before it passes them on.
HELD = 100_000


def traverse(v: Val) -> list[Val]:
    """The elements of a value."""
    u = L.under(v.type)
    if V.is_missing(v) or v.data is None:
        return []
    if u[0] in ("array", "set"):
        return v.data
    if u[0] == "map":
        return [V.record({"key": k, "value": x}) for k, x in v.data]
    if u[0] == "record":
        return [V.record({"key": V.array([V.string(n)]), "value": x}) for n, x in v.data.items()]
    return [v]


def path_of(e: tuple, this: Val, s: Scope) -> list[str]:
    if e[0] == "field":
        return [e[1]]
    if e[0] == "this":
        return []
    if e[0] == "dot":
        return [*path_of(e[1], this, s), e[2]]
    if e[0] == "index":
        return [*path_of(e[1], this, s), str(evaluate(e[2], this, s).data)]
    return [field_name(e)]


def put_path(v: Val, path: list[str], x: Val) -> Val:
    fields = dict(v.data) if L.under(v.type)[0] == "record" and v.data is not None else {}
    n = path[0]
    fields[n] = x if len(path) == 1 else put_path(fields.get(n, V.record({})), path[1:], x)
    return V.record(fields)


# operators on one value: value -> values


def _where(a, v, s):
    x = evaluate(a["expr"], v, s)
    if L.under(x.type) == L.BOOL:
        return [v] if x.data else []
    return [] if V.is_missing(x) or V.is_quiet(x) or x.data is None else [x if V.is_error(x) else failure("not type bool", x)]


def _search(a, v, s):
    return [v] if truth(evaluate(a["expr"], v, s)) else []


def _cut(a, v, s):
    out = V.record({})
    for t, e in a["fields"]:
        x = evaluate(e, v, s)
        if not V.is_quiet(x):
            out = put_path(out, path_of(t if t is not None else e, v, s) or ["this"], x)
    return [out] if out.data else []


def _put(a, v, s):
    if L.under(v.type)[0] != "record":
        return [v if V.is_error(v) else failure("put: not a record", v)]
    new = [(path_of(t, v, s), evaluate(e, v, s)) for t, e in a["fields"]]
    for p, x in new:
        if not V.is_quiet(x):
            v = put_path(v, p, x)
    return [v]


def _dropped(v: Val, path: list[str]) -> Val:
    if L.under(v.type)[0] != "record" or v.data is None or path[0] not in v.data:
        return v
    fields = dict(v.data)
    if len(path) == 1:
        del fields[path[0]]
    else:
        x = _dropped(fields[path[0]], path[1:])
        if L.under(x.type)[0] == "record" and not x.data:
            del fields[path[0]]
        else:
            fields[path[0]] = x
    return V.record(fields)


def _drop(a, v, s):
    if L.under(v.type)[0] != "record":
        return [v]
    for e in a["fields"]:
        v = _dropped(v, path_of(e, v, s))
    return [v] if v.data else []


def _renamed(v: Val, path: list[str], new: str) -> Val:
    if L.under(v.type)[0] != "record" or v.data is None or path[0] not in v.data:
        return v
    if len(path) > 1:
        return V.record({n: _renamed(x, path[1:], new) if n == path[0] else x for n, x in v.data.items()})
    if new in v.data and new != path[0]:
        return failure(f"rename: duplicate field: \"{new}\"", v)
    return V.record({new if n == path[0] else n: x for n, x in v.data.items()})


def _rename(a, v, s):
    for t, e in a["fields"]:
        v = _renamed(v, path_of(e, v, s), path_of(t, v, s)[-1])
    return [v]


def _yield(a, v, s):
    return [x for x in (evaluate(e, v, s) for e in a["exprs"]) if not V.is_quiet(x)]


def _assert(a, v, s):
    ok = evaluate(a["expr"], v, s)
    return [v] if truth(ok) else [V.error(V.record({"message": V.string("assertion failed"), "expr": V.string(a["text"]), "on": v}))]


def _over(a, v, s):
    items = [x for e in a["exprs"] for x in traverse(evaluate(e, v, s))]
    if a["body"] is None:
        return items
    return run_values(a["body"], items, s.child({n: evaluate(e, v, s) for n, e in a["locals"]}))


def _explode(a, v, s):
    want = s.resolve(a["type"])
    out = []

    def walk(x):
        u = L.under(x.type)
        if u == L.under(want):
            out.append(V.record({a["as"]: x}))
        elif x.data is None or u[0] == "prim":
            return
        elif u[0] == "record":
            for y in x.data.values():
                walk(y)
        elif u[0] in ("array", "set"):
            for y in x.data:
                walk(y)
        elif u[0] == "map":
            for k, y in x.data:
                walk(k)
                walk(y)

    for e in a["exprs"]:
        walk(evaluate(e, v, s))
    return out


def _name(a, v, s):
    return _yield({"exprs": [("field", a["name"])]}, v, s)


def _call(a, v, s):
    from weir.lang.parser import BOOL_FUNCTIONS

    e = ("call", a["name"], a["args"])
    return _where({"expr": e}, v, s) if a["name"] in BOOL_FUNCTIONS else _yield({"exprs": [e]}, v, s)


ROW = {"where": _where, "search": _search, "cut": _cut, "put": _put, "drop": _drop, "rename": _rename, "yield": _yield, "assert": _assert, "over": _over, "explode": _explode, "pass": lambda a, v, s: [v], "name": _name, "call": _call}


# aggregates: (new state, add a value, join two states, result)


def _add(a: Val | None, v: Val, op) -> Val | None:
    u = L.under(v.type)
    if v.data is None or not (L.is_number(u) or u in (L.DURATION, L.TIME)):
        return a
    if a is None:
        return v if op is not sum or not L.is_int(u) else Val(L.UINT64 if u[1][0] == "u" else L.INT64, v.data)
    t = a.type if a.type == v.type or not (L.is_number(a.type) and L.is_number(v.type)) else L.promote(a.type, v.type)
    x = a.data + v.data if op is sum else op(a.data, v.data)
    return Val(t, float(x) if L.is_float(t) else x)


def _mean(st, v):
    x = v.data
    if L.under(v.type) == L.STRING and x is not None:
        try:
            x = float(x)
        except ValueError:
            return st
    elif x is None or not (L.is_number(v.type) or L.under(v.type) == L.DURATION):
        return st
    return (st[0] + x, st[1] + 1)


def _both(op):
    return lambda st, v: st if L.under(v.type) != L.BOOL or v.data is None else v.data if st is None else op(st, v.data)


_AGGS: dict[str, tuple[Callable, Callable, Callable, Callable]] = {
    "count": (lambda: 0, lambda st, v: st + 1, lambda a, b: a + b, lambda st: Val(L.UINT64, st)),
    "sum": (lambda: None, lambda st, v: _add(st, v, sum), lambda a, b: b if a is None else a if b is None else _add(a, b, sum), lambda st: st or NULL),
    "min": (lambda: None, lambda st, v: _add(st, v, min), lambda a, b: b if a is None else a if b is None else _add(a, b, min), lambda st: st or NULL),
    "max": (lambda: None, lambda st, v: _add(st, v, max), lambda a, b: b if a is None else a if b is None else _add(a, b, max), lambda st: st or NULL),
    "avg": (lambda: (0, 0), _mean, lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda st: Val(L.FLOAT64, st[0] / st[1] if st[1] else None)),
    "any": (lambda: None, lambda st, v: v if st is None or st.data is None else st, lambda a, b: b if a is None or a.data is None and b is not None else a, lambda st: st or NULL),
    "and": (lambda: None, _both(lambda a, b: a and b), lambda a, b: b if a is None else a if b is None else a and b, lambda st: Val(L.BOOL, None) if st is None else boolean(st)),
    "or": (lambda: None, _both(lambda a, b: a or b), lambda a, b: b if a is None else a if b is None else a or b, lambda st: Val(L.BOOL, None) if st is None else boolean(st)),
    "collect": (list, lambda st, v: st if v.data is None else [*st, v] if len(st) < 1 else (st.append(v) or st), lambda a, b: a + b, lambda st: V.array(st) if st else Val(("array", L.NULL), None)),
    "union": (dict, lambda st, v: st if v.data is None else {**st, V.text(v): v} if len(st) < 1 else (st.__setitem__(V.text(v), v) or st), lambda a, b: {**a, **b}, lambda st: V.vset(list(st.values())) if st else Val(("set", L.NULL), None)),
    "dcount": (set, lambda st, v: st | {V.text(v)} if not st else (st.add(V.text(v)) or st), lambda a, b: a | b, lambda st: Val(L.UINT64, len(st))),
    "collect_map": (list, lambda st, v: st + (v.data or []) if L.under(v.type)[0] == "map" else st, lambda a, b: a + b, lambda st: V.vmap(st) if st else NULL),
    "fuse": (list, lambda st, v: st if v.type in st else [*st, v.type], lambda a, b: a + [t for t in b if t not in a], lambda st: Val(L.TYPE, V.fuse_types(st))),
}


class Grouping:
    """The states of a summarize operator's groups."""

    def __init__(self, a: dict, s: Scope):
        self.a, self.s = a, s
        self.names = [".".join(path_of(t, NULL, s)) if t is not None else e[1] for t, e in a["aggs"]]
        self.groups: dict[str, tuple[list[Val], list]] = {}

    def add(self, v: Val) -> None:
        keys = [evaluate(e, v, self.s) for _, e in self.a["keys"]]
        if any(V.is_quiet(k) for k in keys):
            return
        k = "\x00".join(map(V.text, keys))
        if k not in self.groups:
            self.groups[k] = (keys, [_AGGS[e[1]][0]() for _, e in self.a["aggs"]])
        st = self.groups[k][1]
        for i, (_, (_, name, arg, where)) in enumerate(self.a["aggs"]):
            if where is not None and not truth(evaluate(where, v, self.s)):
                continue
            x = v if arg is None else evaluate(arg, v, self.s)
            if arg is not None and (V.is_missing(x) or V.is_quiet(x)):
                continue
            st[i] = _AGGS[name][1](st[i], x)

    def join(self, k: str, keys: list[Val], states: list) -> None:
        if k not in self.groups:
            self.groups[k] = (keys, states)
            return
        mine = self.groups[k][1]
        for i, (_, e) in enumerate(self.a["aggs"]):
            mine[i] = _AGGS[e[1]][2](mine[i], states[i])

    def results(self) -> list[Val]:
        out = []
        groups = self.groups
        if not groups and not self.a["keys"]:
            groups = {"": ([], [_AGGS[e[1]][0]() for _, e in self.a["aggs"]])}
        for keys, states in groups.values():
            vals = [_AGGS[e[1]][3](st) for (_, e), st in zip(self.a["aggs"], states)]
            if len(vals) == 1 and not keys and self.a["aggs"][0][0] is None:
                out.append(vals[0])
                continue
            r = V.record({})
            for (t, e), k in zip(self.a["keys"], keys):
                r = put_path(r, path_of(t if t is not None else e, NULL, self.s) or ["this"], k)
            for n, x in zip(self.names, vals):
                r = put_path(r, n.split("."), x)
            out.append(r)
        return out


# sequences on lists


def declare(scope: tuple, s: Scope, ops: dict) -> Scope:
    s = Scope(dict(s.names), dict(s.funcs), dict(s.types), s.depth)
    for d in scope[1]["decls"]:
        if d[0] == "const":
            s.names[d[1]] = evaluate(d[2], NULL, s)
        elif d[0] == "type":
            s.types[d[1]] = s.resolve(d[2])
        elif d[0] == "func":
            s.funcs[d[1]] = (d[2], d[3])
        else:
            ops[d[1]] = (d[2], d[3])
    return s


def sort_key(a: dict, s: Scope) -> Callable[[Val], bytes]:
    def f(v: Val) -> bytes:
        out = b""
        for e, direction in a["by"] or [(("this",), None)]:
            x = evaluate(e, v, s)
            if V.is_missing(x):
                x = NULL
            desc = (direction == "desc") != a["reverse"]
            null = x.data is None and L.under(x.type)[0] != "error"
            first = a["nulls"] == "first"
            b = b"" if null else V.sort_bytes(x)
            if desc:
                b = bytes(255 - c for c in b) + b"\xff" * 2
            out += (b"\x00" if null and first else b"\x02" if null else b"\x01") + b
        return out

    return f


def guessed(a: dict, vs: list[Val]) -> dict:
    if a["by"]:
        return a
    t = L.under(vs[0].type) if vs else L.NULL
    if t[0] == "record":
        for test in (L.is_int, L.is_float, lambda x: not L.is_prim(x, "time")):
            for n, x in t[1]:
                if test(x):
                    return {**a, "by": [(("field", n), None)]}
    return a


def run_values(scope: tuple, vs: list[Val], s: Scope, ops: dict | None = None) -> list[Val]:
    """A sequence over a list of values."""
    ops = dict(ops or {})
    s = declare(scope, s, ops)
    legs: list[list[Val]] = [vs]
    for name, a in scope[1]["ops"]:
        one = [v for leg in legs for v in leg]
        if name == "scope":
            legs = [run_values((name, a), one, s, ops)]
        elif name in ("call", "name") and a["name"] in ops:
            params, body = ops[a["name"]]
            legs = [run_values(substitute(body, dict(zip(params, a.get("args", [])))), one, s, ops)]
        elif name in ROW:
            legs = [[x for v in one for x in ROW[name](a, v, s)]]
        elif name == "fork":
            legs = [run_values(leg, one, s, ops) for leg in a["legs"]]
        elif name == "switch":
            legs = [run_values(a["cases"][i][1], part, s, ops) for i, part in enumerate(routed(a, one, s))]
        elif name == "summarize":
            g = Grouping(a, s)
            for v in one:
                g.add(v)
            legs = [g.results()]
        elif name == "sort":
            legs = [sorted(one, key=sort_key(guessed(a, one), s))]
        elif name in ("head", "tail"):
            n = evaluate(a["n"], NULL, s).data
            legs = [one[:n] if name == "head" else one[-n:] if n else []]
        elif name == "top":
            by = {"by": [(e, "desc") for e in a["by"]] or [(("this",), "desc")], "reverse": False, "nulls": None}
            legs = [sorted(one, key=sort_key(by, s))[: evaluate(a["n"], NULL, s).data]]
        elif name == "merge":
            legs = [sorted(one, key=sort_key({"by": a["by"], "reverse": False, "nulls": None}, s))]
        elif name == "uniq":
            legs = [uniq(a, one)]
        elif name == "sample":
            seen: dict[str, Val] = {}
            for v in one:
                x = evaluate(a["expr"], v, s)
                seen.setdefault(L.text(x.type), x)
            legs = [list(seen.values())]
        elif name == "fuse":
            t = V.fuse_types([v.type for v in one])
            legs = [[fused(v, t) for v in one]]
        elif name == "join":
            right = run_values(a["right"], [], s, ops) if a["right"] else legs[1]
            legs = [join(a, legs[0] if not a["right"] else one, right, s)]
        elif name in ("debug", "output", "combine", "shape"):
            legs = [one]
        else:
            raise QueryError(f"{name} can't be used over values of any type")
    return [v for leg in legs for v in leg]


def routed(a: dict, vs: list[Val], s: Scope) -> list[list[Val]]:
    out: list[list[Val]] = [[] for _ in a["cases"]]
    default = next((i for i, (c, _) in enumerate(a["cases"]) if c is None), None)
    for v in vs:
        x = None if a["value"] is None else evaluate(a["value"], v, s)
        if x is not None and V.is_missing(x):
            continue
        for i, (c, _) in enumerate(a["cases"]):
            if c is not None and (truth(evaluate(c, v, s)) if x is None else V.equal(x, evaluate(c, v, s))):
                out[i].append(v)
                break
        else:
            if default is not None:
                out[default].append(v)
    return out


def uniq(a: dict, vs: list[Val]) -> list[Val]:
    out: list[tuple[Val, int]] = []
    for v in vs:
        if out and out[-1][0].type == v.type and V.text(out[-1][0]) == V.text(v):
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((v, 1))
    return [V.record({"value": v, "count": Val(L.UINT64, n)}) if a["count"] else v for v, n in out]


def fused(v: Val, t: tuple) -> Val:
    from weir.dynamic.evaluate import shaped

    return shaped(v, t, ("cast", "fill", "order")) if L.under(t)[0] == "record" and L.under(v.type)[0] == "record" else v


def join(a: dict, left: list[Val], right: list[Val], s: Scope) -> list[Val]:
    le, re_ = a["on"]
    style = a["style"]
    if style == "right":
        left, right, le, re_ = right, left, re_, le
    index: dict[str, list[Val]] = {}
    for v in right:
        k = evaluate(re_, v, s)
        if not V.is_missing(k):
            index.setdefault(join_key(k), []).append(v)
    out = []
    for v in left:
        k = evaluate(le, v, s)
        if V.is_missing(k):
            continue
        found = index.get(join_key(k), [])
        if style == "anti":
            out += [] if found else [v]
        elif not found and style != "inner":
            out.append(v)
        out += [] if style == "anti" else [joined(a, v, r, s) for r in found]
    return out


def join_key(k: Val) -> str:
    return "null" if k.data is None else str(float(k.data)) if L.is_number(k.type) else V.text(Val(L.under(k.type), k.data))


def joined(a: dict, v: Val, r: Val, s: Scope) -> Val:
    fields = dict(v.data)
    for t, e in a["fields"]:
        x = evaluate(e, r, s)
        if V.is_quiet(x):
            continue
        base = (path_of(t if t is not None else e, r, s) or ["this"])[-1]
        n, k = base, 2
        while n in fields:
            n, k = f"{base}_{k}", k + 1
        fields[n] = x
    return V.record(fields)


# sequences on Spark


def _each(df: DataFrame, f: Callable[[Val], list[Val]]) -> DataFrame:
    """f over single values, each output placed after its input's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs, ks = [], []
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, x in enumerate(f(V.parse(t))):
                    vs.append(V.text(x))
                    ks.append(k + i.to_bytes(4, "big"))
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.string()), pa.array(ks, pa.binary())], names=["v", "k"])

    return df.mapInArrow(run, SCHEMA)


def _keyed(df: DataFrame, f: Callable[[Val], bytes], name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f(V.parse(t)) for t in b.column(0).to_pylist()], pa.binary())], names=["v", "k", name])

    return df.mapInArrow(run, f"{SCHEMA}, {name} binary")


def _row_only(scope: tuple, ops: dict) -> bool:
    """Whether a sequence treats each value alone."""
    return all((n in ROW and not (n in ("call", "name") and a["name"] in ops)) or (n == "scope" and _row_only((n, a), ops)) or (n == "switch" and all(_row_only(b, ops) for _, b in a["cases"])) for n, a in scope[1]["ops"])


def _summarized(df: DataFrame, a: dict, s: Scope) -> DataFrame:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(g: Grouping) -> pa.RecordBatch:
            items = list(g.groups.items())
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.string()), pa.array([pickle.dumps(x) for _, x in items], pa.binary())], names=["g", "st"])

        g = Grouping(a, s)
        for b in batches:
            for t in b.column(0).to_pylist():
                g.add(V.parse(t))
            if len(g.groups) > HELD:
                yield out(g)
                g = Grouping(a, s)
        yield out(g)

    def final(t: pa.Table) -> pa.Table:
        g = Grouping(a, s)
        for k, st in zip(t.column("g").to_pylist(), t.column("st").to_pylist()):
            g.join(k, *pickle.loads(st))
        rs = g.results()
        return pa.table({"v": pa.array([V.text(r) for r in rs], pa.string()), "k": pa.array([k.encode() for k in g.groups] or [b""], pa.binary())})

    ordered = any(e[1] in ("collect", "any", "collect_map") for _, e in a["aggs"])
    return (df.orderBy("k").coalesce(1) if ordered and not a["keys"] else df).mapInArrow(partial, "g string, st binary").groupBy("g").applyInArrow(final, SCHEMA)


def run_spark(scope: tuple, df: DataFrame | None, s: Scope, source: Callable, ops: dict | None = None) -> DataFrame:
    ops = dict(ops or {})
    s = declare(scope, s, ops)
    legs: list[DataFrame] = [] if df is None else [df]
    pending: list = []

    def flush() -> DataFrame:
        nonlocal legs, pending
        one = legs[0]
        for n, x in enumerate(legs[1:], 1):
            one = one.union(x)
        if pending:
            seq = ("scope", {"decls": [], "ops": pending})
            one = _each(one, lambda v, seq=seq: run_values(seq, [v], s))
            pending = []
        legs = [one]
        return one

    for name, a in scope[1]["ops"]:
        if name in ("pool", "file", "get"):
            legs = [source(name, a)]
        elif _row_only(("scope", {"decls": [], "ops": [(name, a)]}), ops):
            if len(legs) > 1:
                flush()
            pending.append((name, a))
        elif name == "scope":
            legs = [run_spark((name, a), flush(), s, source, ops)]
        elif name in ("call", "name"):
            params, body = ops[a["name"]]
            legs = [run_spark(substitute(body, dict(zip(params, a.get("args", [])))), flush(), s, source, ops)]
        elif name == "fork":
            one = flush()
            legs = [run_spark(leg, one, s, source, ops) for leg in a["legs"]]
        elif name == "switch":
            one = flush()
            legs = [run_spark(body, _each(one, lambda v, i=i: routed(a, [v], s)[i]), s, source, ops) for i, (_, body) in enumerate(a["cases"])]
        elif name == "join":
            if pending or a["right"]:
                flush()
            right = run_spark(a["right"], None, s, source, ops) if a["right"] else legs[1]
            legs = [_joined(a, legs[0], right, s)]
        else:
            legs = [_global(name, a, flush(), s)]
    return flush()


def _global(name: str, a: dict, df: DataFrame, s: Scope) -> DataFrame:
    if name == "summarize":
        return _summarized(df, a, s)
    if name in ("sort", "merge", "top"):
        if name == "sort" and not a["by"]:
            a = guessed(a, [V.parse(r["v"]) for r in df.orderBy("k").limit(1).collect()])
        if name != "sort":
            a = {**a, "by": a["by"] if name == "merge" else [(e, "desc") for e in a["by"]], "reverse": False, "nulls": None}
        out = _keyed(df, sort_key(a, s), "o").select("v", F.concat("o", "k").alias("k"))
        return out.orderBy("k").limit(evaluate(a["n"], NULL, s).data) if name == "top" else out
    if name == "head":
        return df.orderBy("k").limit(evaluate(a["n"], NULL, s).data)
    if name == "tail":
        return df.orderBy(F.col("k").desc()).limit(evaluate(a["n"], NULL, s).data)
    if name == "sample":
        e = {"aggs": [(("field", "v"), ("agg", "any", a["expr"], None))], "keys": [(("field", "t"), ("call", "typeof", [a["expr"]]))]}
        return _each(_summarized(df, e, s), lambda v: [get(v, "v")])
    if name == "fuse":
        types = _summarized(df, {"aggs": [(None, ("agg", "fuse", ("this",), None))], "keys": []}, s).collect()
        t = V.parse(types[0]["v"]).data
        return _each(df, lambda v: [fused(v, t)])
    if name == "uniq":
        from pyspark.sql import Window

        # neighbours are compared in order; runs are numbered and grouped
        w = Window.orderBy("k")
        runs = df.withColumn("new", F.coalesce(F.col("v") != F.lag("v").over(w), F.lit(True))).withColumn("run", F.sum(F.col("new").cast("long")).over(w))
        g = runs.groupBy("run").agg(F.any_value("v").alias("v"), F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
        return g.select(F.concat(F.lit("{value:"), "v", F.lit(",count:"), F.col("n").cast("string"), F.lit("(uint64)}")).alias("v") if a["count"] else "v", "k")
    if name in ("debug", "output", "combine", "shape"):
        return df
    raise QueryError(f"{name} can't be used over values of any type")


def _joined(a: dict, left: DataFrame, right: DataFrame, s: Scope) -> DataFrame:
    le, re_ = a["on"]
    style = a["style"]
    if style == "right":
        left, right, le, re_ = right, left, re_, le

    def keyed(e):
        def f(v: Val) -> bytes | None:
            k = evaluate(e, v, s)
            return None if V.is_missing(k) else join_key(k).encode()

        return f

    ldf, rdf = _keyed(left, keyed(le), "j").where("j IS NOT NULL"), _keyed(right, keyed(re_), "j").where("j IS NOT NULL").select(F.col("v").alias("r"), "j")
    if style == "anti":
        return ldf.join(rdf, "j", "left_anti").select("v", "k")
    both = ldf.join(rdf, "j", "inner" if style == "inner" else "left").select("v", "k", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = [t if r is None else V.text(joined(a, V.parse(t), V.parse(r), s)) for t, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.string()), b.column(1)], names=["v", "k"])

    return both.mapInArrow(run, SCHEMA)


def of_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """A sequence of the texts in a column, in the order of the scan."""
    return df.select(F.col(column).alias("v"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0").cast("binary").alias("k"))


def query(text: str, df: DataFrame, source: Callable | None = None) -> DataFrame:
    """A pipeline over a DataFrame of texts (column v or value) of values of any type; gives column v, in order."""
    seq = df if set(df.columns) == {"v", "k"} else of_lines(df, "value" if "value" in df.columns else df.columns[0])
    return run_spark(parse(text), seq, Scope(), source or _no_source).orderBy("k").select("v")


def _no_source(name, a):
    raise QueryError("a source is needed here")
