"""Expressions to Columns.

``lower`` turns a syntax tree into a Value: a Column with a logical type, and
what is known of its absence. A field that the schema lacks is ``missing`` (its
column is null); an expression that can fail has ``err``, a Column that is true
where it does. Failing values are null; operators decide what becomes of them.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.lang.lexer import QueryError
from weir.lang.parser import field_name
from weir.plans import types as L
from weir.plans.types import Type

_UNSET = object()


@dataclass
class Value:
    col: Column
    type: Type
    missing: bool = False
    quiet: bool = False
    err: Column | None = None
    message: str = "error"
    const: object = _UNSET
    #: a timestamp without zone
    ntz: bool = False

    @property
    def known(self) -> bool:
        return self.const is not _UNSET


def missing(name: str = "missing") -> Value:
    return Value(F.lit(None).cast("string"), L.NULL, missing=True, err=F.lit(True), message="missing")


def failed(*values: Value) -> Column | None:
    """Where any of these fails."""
    errs = [v.err for v in values if v.err is not None]
    out = None
    for e in errs:
        out = e if out is None else out | e
    return out


@dataclass
class Env:
    """Names in scope: fields of this, constants and locals, functions, types; and the running order of rows."""

    fields: dict[str, Value]
    this: Callable[[], Value]
    names: dict[str, Value] = field(default_factory=dict)
    funcs: dict[str, tuple[list[str], tuple, Env | None]] = field(default_factory=dict)
    types: dict[str, Type] = field(default_factory=dict)
    #: makes a running aggregate from (name, argument Value or None, filter Column or None)
    running: Callable | None = None
    #: functions in Python that an engine was given: (env, *values) to a value
    python: dict[str, Callable] = field(default_factory=dict)
    depth: int = 0
    #: the rows, for what must be known of them when planning
    df: object = None

    def child(self, names: dict[str, Value]) -> Env:
        return replace(self, names={**self.names, **names}, depth=self.depth + 1)

    def inside(self, this: Value) -> Env:
        """The scope of an element of a traversal."""
        return replace(self, fields=members(this), this=lambda: this, running=None, df=None)

    def resolve(self, t: Type) -> Type:
        k = t[0]
        if k == "ref":
            if t[1] not in self.types:
                raise QueryError(f"no such type: {t[1]}")
            return ("named", t[1], self.types[t[1]])
        if k == "record":
            return (k, [(n, self.resolve(x)) for n, x in t[1]])
        if k in ("array", "set", "error"):
            return (k, self.resolve(t[1]))
        if k == "map":
            return (k, self.resolve(t[1]), self.resolve(t[2]))
        if k == "union":
            return (k, [self.resolve(x) for x in t[1]])
        if k == "named":
            return (k, t[1], self.resolve(t[2]))
        return t


def members(v: Value) -> dict[str, Value]:
    """The fields of a record value."""
    t = L.under(v.type)
    return {n: Value(v.col.getField(n), x) for n, x in t[1]} if t[0] == "record" else {}


def const_of(v: Value, what: str) -> object:
    if not v.known:
        raise QueryError(f"{what} must be a constant")
    return v.const


def literal(t: str, v: object) -> Value:
    if v is None:
        return Value(F.lit(None).cast("string"), L.NULL, const=None)
    if t == "time":
        when = parse_time(v)
        return Value(F.lit(when.isoformat(" ")).cast("timestamp"), L.TIME, const=when)
    if t == "bytes":
        return Value(F.lit(bytearray(v)), L.BYTES, const=v)
    if t == "int64" and not -(1 << 63) <= v < 1 << 63:
        return Value(F.lit(None).cast("bigint"), L.UINT64, const=v)
    if t == "int64":
        return Value(F.lit(v).cast("bigint"), L.INT64, const=v)
    if t == "duration":
        return Value(F.lit(v).cast("bigint"), L.DURATION, const=v)
    if t == "ip":
        v = str(ipaddress.ip_address(v))
    if t == "net":
        v = str(ipaddress.ip_network(v, strict=False))
    return Value(F.lit(v), L.prim(t), const=v)


def parse_time(s: str) -> dt.datetime:
    s = re.sub(r"(\.\d{6})\d+", r"\1", s.replace("Z", "+00:00"))
    t = dt.datetime.fromisoformat(s)
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def string(v: str) -> Value:
    return Value(F.lit(v), L.STRING, const=v)


def boolean(c: Column) -> Value:
    return Value(c, L.BOOL)


def cast_col(c: Column, a: Type, b: Type) -> Column:
    sa, sb = L.spark_type(a), L.spark_type(b)
    return c if sa == sb else c.cast(sb)


def aligned(a: Value, b: Value) -> tuple[Column, Column]:
    """Two columns of comparable Spark types."""
    if L.is_prim(a.type, "time") and L.is_prim(b.type, "time") and a.ntz != b.ntz:
        if a.known:
            return F.lit(a.const.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz"), b.col
        if b.known:
            return a.col, F.lit(b.const.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
        return a.col.cast("timestamp"), b.col.cast("timestamp")
    if L.is_number(a.type) and L.is_number(b.type):
        ca, cb = a.col, b.col
        # a literal takes the column's type, so that comparisons reach the scan
        if a.known and not b.known and L.is_int(a.type) == L.is_int(b.type):
            ca = a.col.cast(L.spark_type(b.type)) if _fits(a.const, b.type) else ca
        elif b.known and not a.known:
            cb = b.col.cast(L.spark_type(a.type)) if _fits(b.const, a.type) else cb
        return ca, cb
    return a.col, b.col


def _fits(v: object, t: Type) -> bool:
    t = L.under(t)
    if L.is_float(t):
        return isinstance(v, (int, float)) and abs(v) < 1 << 24
    if not isinstance(v, int):
        return False
    n = int(t[1].lstrip("uint"))
    return 0 <= v < 1 << n and v < 1 << 62 if t[1][0] == "u" else -(1 << (n - 1)) <= v < 1 << (n - 1)


def comparable(a: Type, b: Type) -> bool:
    a, b = L.under(a), L.under(b)
    if L.is_prim(a, "null") or L.is_prim(b, "null") or (L.is_number(a) and L.is_number(b)):
        return True
    if a[0] != b[0]:
        return False
    if a[0] in ("array", "set"):
        return comparable(a[1], b[1])
    return a == b


def equals(a: Value, b: Value) -> Column:
    if not comparable(a.type, b.type):
        return F.lit(False)
    if L.is_prim(a.type, "null") or L.is_prim(b.type, "null"):
        return a.col.isNull() & b.col.isNull()
    x, y = aligned(a, b)
    if L.under(a.type)[0] == "map":
        x, y = F.array_sort(F.map_entries(x)), F.array_sort(F.map_entries(y))
    return x.eqNullSafe(y)  # scans and hash joins take it as they take plain equality


def less(a: Value, b: Value, op: str) -> Column:
    if not comparable(a.type, b.type):
        return F.lit(False)
    x, y = aligned(a, b)
    if L.is_prim(a.type, "ip") and L.is_prim(b.type, "ip"):
        x, y = ip_key(x), ip_key(y)
    c = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if (a.known and a.const is not None) or (b.known and b.const is not None):
        return c  # null only where the other side is, which filters drop as they drop false
    return F.coalesce(c, (x.isNull() & y.isNull()) if "=" in op else F.lit(False))


def ip_key(c: Column) -> Column:
    """A string that orders addresses: v4 before v6, each numerically."""
    octets = F.split(c, r"\.")
    v4 = F.concat(F.lit("4"), *[F.lpad(F.get(octets, F.lit(i)), 3, "0") for i in range(4)])
    return F.when(c.contains("."), v4).otherwise(F.concat(F.lit("6"), v6_hex(c)))


def v6_hex(c: Column) -> Column:
    """The 32 hex digits of a v6 address without dots."""
    head, tail = F.split_part(c, F.lit("::"), F.lit(1)), F.when(c.contains("::"), F.split_part(c, F.lit("::"), F.lit(2))).otherwise("")
    groups = lambda s: F.transform(F.filter(F.split(s, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    a, b = groups(head), groups(tail)
    return F.lower(F.concat(F.array_join(a, ""), F.repeat(F.lit("0"), (F.lit(8) - F.size(a) - F.size(b)) * 4), F.array_join(b, "")))


def boolean_of(v: Value, err: bool = True) -> Value:
    """A value as an operand of logic: true or false, failing where it isn't a bool."""
    if v.missing or not L.is_prim(v.type, "bool", "null"):
        return Value(F.lit(None).cast("boolean"), L.BOOL, missing=v.missing, err=F.lit(True), message=v.message if v.missing else "not a bool")
    return Value(v.col.cast("boolean") if L.is_prim(v.type, "null") else v.col, L.BOOL, err=v.err, message=v.message)


# lowering


def lower(e: tuple, env: Env) -> Value:
    return _FORMS[e[0]](e, env)


def _lit(e, env):
    return literal(e[1], e[2])


def _field(e, env):
    n = e[1]
    if n in env.names:
        return env.names[n]
    return env.fields.get(n) or missing(n)


def _this(e, env):
    return env.this()


def get_field(v: Value, n: str) -> Value:
    t = L.under(v.type)
    if v.missing:
        return v
    if t[0] == "record":
        x = dict(t[1]).get(n)
        return Value(v.col.getField(n), x, err=v.err) if x is not None else missing(n)
    if t[0] == "map" and L.is_prim(t[1], "string"):
        c = F.try_element_at(v.col, F.lit(n))
        return Value(c, t[2], err=~F.coalesce(F.map_contains_key(v.col, F.lit(n)), F.lit(False)), message="missing")
    if t[0] == "error":
        return Value(v.col.getField(n), L.STRING) if n in ("message", "on") else missing(n)
    return missing(n)


def _dot(e, env):
    if e[1][0] == "this" and env.fields:
        return env.fields.get(e[2]) or missing(e[2])
    return get_field(lower(e[1], env), e[2])


def _index(e, env):
    v, i = lower(e[1], env), lower(e[2], env)
    t = L.under(v.type)
    if v.missing:
        return v
    if t[0] == "record":
        if i.known and isinstance(i.const, str):
            return env.fields.get(i.const, missing()) if e[1][0] == "this" and env.fields else get_field(v, i.const)
        if i.known and isinstance(i.const, int):
            n = t[1][i.const][0] if -len(t[1]) <= i.const < len(t[1]) else None
            return get_field(v, n) if n else missing()
        raise QueryError("the name of a field must be a constant")
    if t[0] in ("array", "set"):
        n = F.size(v.col)
        at = F.when(i.col < 0, i.col + n).otherwise(i.col).cast("int") if not i.known else (F.lit(i.const) if i.const >= 0 else n + F.lit(i.const))
        return Value(F.get(v.col, at), t[1], err=F.coalesce((at < 0) | (at >= n), F.lit(True)), message="missing")
    if t[0] == "map":
        k = i.col.cast(L.spark_type(t[1]))
        return Value(F.try_element_at(v.col, k), t[2], err=~F.coalesce(F.map_contains_key(v.col, k), F.lit(False)), message="missing")
    return missing()


def _slice(e, env):
    v = lower(e[1], env)
    t = L.under(v.type)
    is_text = L.is_prim(t, "string")
    if not (t[0] in ("array", "set") or is_text or L.is_prim(t, "bytes")):
        return Value(v.col, v.type, err=F.lit(True), message="sliced value is not array, set, bytes, or string")
    n = F.size(v.col) if t[0] in ("array", "set") else F.char_length(v.col) if is_text else F.octet_length(v.col)

    def bound(x, otherwise):
        if x is None:
            return otherwise
        c = lower(x, env).col.cast("int")
        return F.greatest(F.least(F.when(c < 0, c + n).otherwise(c), n), F.lit(0))

    a = bound(e[2], F.lit(0))
    size = F.greatest(bound(e[3], n) - a, F.lit(0))
    c = F.slice(v.col, a + 1, size) if t[0] in ("array", "set") else F.substring(v.col, a + 1, size)
    return Value(F.when(v.col.isNotNull(), c), v.type, err=v.err)


def _bin(e, env):
    op = e[1]
    if op in ("and", "or"):
        a, b = lower(e[2], env), lower(e[3], env)
        if a.missing and op == "or":
            return boolean_of(b)
        a, b = boolean_of(a), boolean_of(b)
        if a.missing or b.missing:
            other = b if a.missing else a
            # false and x is false, whatever x is
            return Value(F.when(~other.col, False) if op == "and" else F.when(other.col, True), L.BOOL, err=F.coalesce(other.col if op == "and" else ~other.col, F.lit(True)), message="missing")
        return Value(a.col & b.col if op == "and" else a.col | b.col, L.BOOL, err=failed(a, b))
    if op == "~":
        return match(lower(e[2], env), e[3], env)
    a, b = lower(e[2], env), lower(e[3], env)
    if a.missing or b.missing:
        return missing()
    if op == "in":
        return Value(contains(b, a), L.BOOL, err=failed(a, b))
    if op in ("==", "!="):
        c = equals(a, b)
        return Value(c if op == "==" else ~c, L.BOOL, err=failed(a, b))
    if op in ("<", "<=", ">", ">="):
        return Value(less(a, b, op), L.BOOL, err=failed(a, b))
    return arithmetic(op, a, b)


def match(v: Value, pattern: tuple, env: Env) -> Value:
    if v.missing:
        return missing()
    if not L.is_prim(v.type, "string"):
        return boolean(F.lit(False))
    return Value(F.coalesce(v.col.rlike(pattern_of(pattern, env)), F.lit(False)), L.BOOL, err=v.err)


def pattern_of(e: tuple, env: Env) -> str:
    if e[0] == "regexp":
        return java_regex(e[1])
    if e[0] == "glob":
        return glob_regex(e[1])
    v = lower(e, env)
    return java_regex(str(const_of(v, "a pattern")))


def java_regex(p: str) -> str:
    """An RE2 pattern for Java's engine; what RE2 can't do is refused."""
    if re.search(r"\(\?(?:=|!|<=|<!)", p):
        raise QueryError("look-around isn't supported in patterns")
    return p.replace("(?P<", "(?<").replace("[[:alpha:]]", r"\p{Alpha}").replace("[[:digit:]]", r"\d").replace("[[:space:]]", r"\s").replace("\\z", "\\z")


def glob_regex(g: str) -> str:
    return "^" + ".*".join(re.escape(x) for x in g.split("*")) + "$"


def contains(container: Value, v: Value) -> Column:
    """Whether v is container or lies anywhere in it."""
    t = L.under(container.type)
    if t[0] == "array" and container.known and L.under(v.type)[0] == "prim" and comparable(t[1], v.type) and not L.is_prim(t[1], "null") and not v.known:
        # a list of literals, as what scans can take
        items = [x for x in container.const if x is not None]
        if len(items) == len(container.const) and all(isinstance(x, (str, int, bool)) for x in items) and L.under(t[1])[0] == "prim" and t[1][1] in ("string", "int64", "bool") and (not L.is_int(v.type) or all(_fits(x, v.type) for x in items)) and not L.is_float(v.type):
            return v.col.isNotNull() & v.col.isin(*items)
    out = equals(container, v)
    if t[0] == "record":
        for x in members(container).values():
            out = out | contains(x, v)
    elif t[0] in ("array", "set"):
        if container.known is False and t[1] and comparable(t[1], v.type) and L.under(t[1])[0] == "prim":
            inner = F.exists(container.col, lambda x: equals(Value(x, t[1]), v))
        else:
            inner = F.exists(container.col, lambda x: contains(Value(x, t[1]), v))
        out = out | F.coalesce(inner, F.lit(False))
    elif t[0] == "map":
        out = out | F.coalesce(F.exists(F.map_keys(container.col), lambda x: contains(Value(x, t[1]), v)) | F.exists(F.map_values(container.col), lambda x: contains(Value(x, t[2]), v)), F.lit(False))
    elif L.is_prim(t, "net") and L.is_prim(v.type, "ip"):
        from weir.functions.scalar import net_contains

        out = net_contains(container, v)
    return out


def arithmetic(op: str, a: Value, b: Value) -> Value:
    err = failed(a, b)
    ta, tb = L.under(a.type), L.under(b.type)
    if L.is_prim(ta, "null") or L.is_prim(tb, "null"):
        t = tb if L.is_prim(ta, "null") else ta
        return Value(F.lit(None).cast(L.spark_type(t)), t, err=err)
    if op == "+" and L.is_prim(ta, "string") and L.is_prim(tb, "string"):
        return Value(F.concat(a.col, b.col), L.STRING, err=err, const=a.const + b.const if a.known and b.known else _UNSET)
    if L.is_prim(ta, "time") and L.is_prim(tb, "time") and op == "-":
        return Value((F.unix_micros(a.col.cast("timestamp")) - F.unix_micros(b.col.cast("timestamp"))) * 1000, L.DURATION, err=err)
    if op in "+-" and L.is_prim(ta, "time") and L.is_prim(tb, "duration"):
        us = F.call_function("div", b.col, F.lit(1000))
        c = F.timestamp_micros(F.unix_micros(a.col.cast("timestamp")) + (us if op == "+" else -us))
        return Value(c.cast("timestamp_ntz") if a.ntz else c, L.TIME, err=err, ntz=a.ntz)
    if op == "+" and L.is_prim(ta, "duration") and L.is_prim(tb, "time"):
        return arithmetic(op, b, a)
    durations = L.is_prim(ta, "duration") or L.is_prim(tb, "duration")
    if not all(L.is_number(t) or L.is_prim(t, "duration") for t in (ta, tb)):
        return Value(F.lit(None).cast("bigint"), L.INT64, err=F.lit(True), message="incompatible types")
    t = L.DURATION if durations else L.promote(ta, tb)
    if t == L.DURATION and op == "/" and ta == tb == L.DURATION:
        t = L.INT64
    st = L.spark_type(t)
    if a.known and b.known and isinstance(a.const, (int, float)) and isinstance(b.const, (int, float)) and not (op in "/%" and b.const == 0):
        v = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y if L.is_float(t) else int(x / y) if abs(x) < 1 << 52 else x // y, "%": lambda x, y: x - y * int(x / y)}[op](a.const, b.const)
        if isinstance(v, float) or -(1 << 63) <= v < 1 << 63:
            return Value(F.lit(v).cast(st), t, const=v)
    x, y = a.col.cast(st) if L.spark_type(ta) != st else a.col, b.col.cast(st) if L.spark_type(tb) != st else b.col
    if op in "/%":
        zero = y == 0
        if L.is_float(t):
            c = F.when(~zero, x / y if op == "/" else x % y)
        else:
            c = F.when(~zero, F.call_function("div", x, y).cast(st) if op == "/" else x % y)
        if b.known and b.const != 0:
            return Value(x / y if op == "/" and L.is_float(t) else F.call_function("div", x, y).cast(st) if op == "/" else x % y, t, err=err)
        zero = F.coalesce(zero, F.lit(False))
        return Value(c, t, err=zero if err is None else err | zero, message="divide by zero")
    if L.is_float(t):
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], t, err=err)
    # integers wrap in the reference; here an overflow is null rather than an exception
    return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), t, err=err)


def _un(e, env):
    v = lower(e[2], env)
    if e[1] == "!":
        b = boolean_of(v)
        return Value(~b.col, L.BOOL, missing=b.missing, err=b.err, message=b.message)
    if v.missing:
        return v
    if v.known and isinstance(v.const, (int, float)):
        return Value(F.lit(-v.const).cast(L.spark_type(v.type)), v.type, const=-v.const)
    t = L.under(v.type)
    if L.is_int(t) and t[1][0] == "u":
        t = L.prim(t[1][1:])
    if not (L.is_number(t) or L.is_prim(t, "duration")):
        return Value(v.col, v.type, err=F.lit(True), message="type incompatible with unary '-' operator")
    return Value(-v.col.cast(L.spark_type(t)), t, err=v.err)


def _cond(e, env):
    c, a, b = (lower(x, env) for x in e[1:])
    c = boolean_of(c)
    if a.missing and b.missing:
        return a
    if not (L.is_prim(a.type, "null") or L.is_prim(b.type, "null") or a.type == b.type or (L.is_number(a.type) and L.is_number(b.type))):
        # two types in one column: both as text
        a, b = cast(a, L.STRING), cast(b, L.STRING)
    t = b.type if L.is_prim(a.type, "null") else a.type if L.is_prim(b.type, "null") else a.type if a.type == b.type else L.promote(a.type, b.type)
    st = L.spark_type(t)
    keep = lambda v: F.lit(None).cast(st) if L.is_prim(v.type, "null") else v.col if v.ntz or L.spark_type(v.type) == st else v.col.cast(st)
    err = None
    if a.err is not None or b.err is not None or c.err is not None:
        err = F.when(c.err if c.err is not None else F.lit(False), True).when(c.col, a.err if a.err is not None else F.lit(False)).otherwise(b.err if b.err is not None else F.lit(False))
    return Value(F.when(c.col, keep(a)).when(~c.col, keep(b)), t, err=err, message=a.message, ntz=a.ntz or b.ntz)


def _call(e, env):
    from weir.functions.scalar import call

    return call(e[1], e[2], env)


def _record(e, env):
    fields: dict[str, Value] = {}
    for x in e[1]:
        if x[0] == "spread":
            v = lower(x[1], env)
            fields.update(env.fields if x[1][0] == "this" and env.fields else members(v))
        else:
            fields[x[1]] = lower(x[2], env)
    return record({n: v for n, v in fields.items() if not v.quiet})


def record(fields: dict[str, Value]) -> Value:
    t = ("record", [(n, error_type(v) if v.missing else v.type) for n, v in fields.items()])
    cols = [error_col(v).alias(n) if v.missing else v.col.alias(n, metadata=L.metadata(v.type)) if L.metadata(v.type) else v.col.alias(n) for n, v in fields.items()]
    return Value(F.struct(*cols) if cols else F.struct(F.lit(None).cast("string").alias("_empty")), t, err=None)


def error_type(v: Value) -> Type:
    return ("error", L.STRING)


def error_col(v: Value) -> Column:
    return F.struct(F.lit(v.message).alias("message"), F.lit(None).cast("string").alias("on"))


def unify(vs: list[Value]) -> tuple[Type, list[Column]]:
    """One element type for several values, and their columns in it; mixed types become text."""
    t = L.NULL
    for v in vs:
        if L.is_prim(t, "null") or t == v.type:
            t = v.type
        elif L.is_number(t) and L.is_number(v.type):
            t = L.promote(t, v.type)
        elif not L.is_prim(v.type, "null"):
            t = L.STRING
    st = L.spark_type(t)
    return t, [F.lit(None).cast(st) if L.is_prim(v.type, "null") else v.col if L.spark_type(v.type) == st else cast(v, t).col for v in vs]


def _list(e, env) -> tuple[Type, Column]:
    parts, run = [], []
    types: list[Value] = []
    for x in e[1]:
        v = lower(x[1], env) if x[0] == "spread" else lower(x, env)
        if x[0] == "spread":
            if run:
                parts.append(run)
                run = []
            if L.under(v.type)[0] in ("array", "set"):
                parts.append(v)
                types.append(Value(v.col, L.under(v.type)[1]))
        elif not v.quiet:
            run.append(v)
            types.append(v)
    if run:
        parts.append(run)
    if not parts:
        return L.NULL, F.array().cast("array<string>")
    t, _ = unify(types)
    st = L.spark_type(t)
    cols = [F.array(*[cast(v, t).col.cast(st) if not L.is_prim(v.type, "null") else F.lit(None).cast(st) for v in p]) if isinstance(p, list) else p.col.cast(f"array<{st.simpleString()}>") for p in parts]
    return t, cols[0] if len(cols) == 1 else F.concat(*cols)


def _array(e, env):
    t, c = _list(e, env)
    values = [x for x in e[1] if x[0] == "lit"]
    return Value(c, ("array", t), const=[x[2] for x in values] if len(values) == len(e[1]) else _UNSET)


def _set(e, env):
    t, c = _list(e, env)
    return Value(F.array_sort(F.array_distinct(c)), ("set", t))


def _map(e, env):
    pairs = [(lower(k, env), lower(v, env)) for k, v in e[1]]
    if not pairs:
        return Value(F.create_map().cast("map<string,string>"), ("map", L.NULL, L.NULL))
    kt, ks = unify([k for k, _ in pairs])
    vt, vs = unify([v for _, v in pairs])
    # later keys win
    m = F.map_from_entries(F.array(*[F.struct(k.alias("key"), v.alias("value")) for i, (k, v) in enumerate(zip(ks, vs)) if not any(_same(pairs[i][0], p[0]) for p in pairs[i + 1 :])]))
    return Value(m, ("map", kt, vt))


def _same(a: Value, b: Value) -> bool:
    return a.known and b.known and a.const == b.const


def _fstring(e, env):
    vs = [lower(x, env) for x in e[1]]
    vs = [v if L.is_prim(v.type, "string") else cast(v, L.STRING) for v in vs]
    if not vs:
        return string("")
    return Value(F.concat(*[F.coalesce(v.col, F.lit("null")) for v in vs]) if vs else F.lit(""), L.STRING, err=failed(*vs))


def _type(e, env):
    t = L.text(env.resolve(e[1]))
    return Value(F.lit(t), L.TYPE, const=env.resolve(e[1]))


def _cast(e, env):
    v = lower(e[2], env)
    if v.missing:
        return v
    return cast(v, env.resolve(e[1]))


def to_text(v: Value) -> Column:
    """A value as text, as it is written in the text format."""
    t = L.under(v.type)
    if L.is_prim(t, "string", "ip", "net", "type", "null") or t[0] == "enum":
        return v.col.cast("string")
    if L.is_prim(t, "time"):
        c = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))
    if L.is_prim(t, "duration"):
        return duration_text(v.col)
    if L.is_prim(t, "bytes"):
        return F.concat(F.lit("0x"), F.lower(F.hex(v.col)))
    if L.is_float(t):
        s = F.regexp_replace(F.regexp_replace(v.col.cast("string"), r"\.0$", "."), r"\.0E", "E")
        return s
    if t[0] in ("array", "set", "map", "record"):
        return F.to_json(v.col)
    return v.col.cast("string")


def duration_text(c: Column) -> Column:
    a = F.abs(c)
    part = lambda n, m, u: F.when(F.call_function("div", a, F.lit(n)) % m != 0, F.concat((F.call_function("div", a, F.lit(n)) % m).cast("string"), F.lit(u))).otherwise("")
    ns = {"us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}
    out = F.concat(part(ns["d"], 10**9, "d"), part(ns["h"], 24, "h"), part(ns["m"], 60, "m"), part(ns["s"], 60, "s"), part(ns["ms"], 1000, "ms"), part(ns["us"], 1000, "us"), part(1, 1000, "ns"))
    return F.when(c == 0, "0s").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), out))


def cast(v: Value, t: Type) -> Value:
    """v as type t; where it can't be, null and failing."""
    if v.missing:
        return v
    a, b = L.under(v.type), L.under(t)
    st = L.spark_type(b)
    if L.is_prim(a, "null"):
        return Value(F.lit(None).cast(st), t, err=v.err)
    if a == b:
        return Value(v.col, t, err=v.err, ntz=v.ntz, const=v.const)
    const = _UNSET
    if L.is_prim(b, "string"):
        c = to_text(v)
    elif L.is_prim(b, "time") and L.is_prim(a, "string"):
        c = F.try_to_timestamp(v.col)
    elif L.is_prim(b, "time") and (L.is_int(a) or L.is_prim(a, "duration")):
        c = F.timestamp_micros(F.call_function("div", v.col.cast("bigint"), F.lit(1000)))
    elif L.is_prim(b, "time") and L.is_float(a):
        c = F.timestamp_micros((v.col / 1000).cast("bigint"))
    elif L.is_prim(a, "time") and (L.is_int(b) or L.is_prim(b, "duration")):
        c = F.unix_micros(v.col.cast("timestamp")) * 1000
    elif L.is_prim(b, "duration") and L.is_prim(a, "string"):
        c = duration_of(v.col)
    elif L.is_prim(b, "ip") and L.is_prim(a, "string"):
        c = F.when(v.col.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$") | v.col.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"), v.col)
    elif L.is_prim(b, "net") and L.is_prim(a, "string"):
        c = F.when(v.col.rlike(r"^[0-9A-Fa-f:.]+/\d{1,3}$"), v.col)
    elif L.is_prim(b, "bytes") and L.is_prim(a, "string"):
        c = F.when(v.col.rlike("^0x(?:[0-9A-Fa-f]{2})*$"), F.unhex(F.substring(v.col, 3, 1 << 30))).otherwise(v.col.cast("binary"))
    elif L.is_prim(b, "type") or b[0] == "enum":
        c = v.col.cast("string")
    elif L.is_prim(b, "bool") and L.is_prim(a, "string"):
        c = F.when(F.lower(v.col) == "true", True).when(F.lower(v.col) == "false", False)
    elif L.is_int(b):
        base = v.col
        if L.is_prim(a, "string"):
            base = F.coalesce(v.col.try_cast("decimal(38,0)").try_cast("bigint"), F.floor(v.col.try_cast("double")).try_cast("bigint"))
        elif L.is_prim(a, "bool"):
            base = v.col.cast("int")
        c = base.try_cast("bigint")
        n = int(b[1].lstrip("uint"))
        lo, hi = (0, (1 << min(n, 63)) - 1) if b[1][0] == "u" else (-(1 << (n - 1)), (1 << (n - 1)) - 1)
        c = (F.when(c.between(lo, hi), c) if n < 64 or lo == 0 else c).cast(st)
    elif L.is_float(b) and (L.is_number(a) or L.is_prim(a, "string", "bool", "duration")):
        c = v.col.try_cast(st)
    elif b[0] == "record" and a[0] == "record":
        from weir.functions.shapers import shaped

        return shaped(v, t, ("cast",))
    elif b[0] in ("array", "set") and a[0] in ("array", "set"):
        c = F.transform(v.col, lambda x: cast(Value(x, a[1]), b[1]).col)
        c = F.array_sort(F.array_distinct(c)) if b[0] == "set" else c
    elif b[0] == "map" and a[0] == "map":
        c = F.map_from_entries(F.transform(F.map_entries(v.col), lambda x: F.struct(cast(Value(x["key"], a[1]), b[1]).col, cast(Value(x["value"], a[2]), b[2]).col)))
    elif b[0] == "union":
        return v
    elif b[0] == "error":
        c = F.struct(to_text(v).alias("message"), F.lit(None).cast("string").alias("on"))
    else:
        return Value(F.lit(None).cast(st), t, err=F.coalesce(v.col.isNotNull(), F.lit(True)), message=f"cannot cast to {L.text(t)}")
    bad = c.isNull() & v.col.isNotNull()
    safe = L.is_prim(b, "string") or (L.is_number(a) and L.is_float(b)) or (L.is_int(a) and b == L.INT64)
    err = v.err if safe else bad if v.err is None else v.err | bad
    return Value(c, t, err=err, message=f"cannot cast to {L.text(t)}", const=const)


def duration_of(c: Column) -> Column:
    from weir.lang.lexer import _UNITS

    total = F.lit(0).cast("bigint")
    for u, n in _UNITS.items():
        got = F.regexp_extract(c, rf"(\d+(?:\.\d+)?){u}(?![a-z])", 1)
        total = total + F.coalesce((F.when(got != "", got).try_cast("double") * n).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(c.rlike(r"^-?(?:\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|d|w|y))+$"), F.when(c.startswith("-"), -total).otherwise(total))


def _agg(e, env):
    if env.running is None:
        raise QueryError(f"{e[1]}() can't be used here")
    arg = None if e[2] is None else lower(e[2], env)
    where = None if e[3] is None else boolean_of(lower(e[3], env)).col
    return env.running(e[1], arg, where)


def _regexp(e, env):
    return boolean(search_term(("regexp", e[1]), env))


def _glob(e, env):
    return boolean(search_term(("glob", e[1]), env))


def _term(e, env):
    return boolean(search_term(e, env))


def search_term(e: tuple, env: Env, this: Value | None = None) -> Column:
    """Whether this holds a match: in strings and field names by pattern or part, in others by equality."""
    if e[0] in ("regexp", "glob"):
        p = java_regex(e[1]) if e[0] == "regexp" else glob_regex(e[1])
        in_text = lambda c: F.coalesce(c.rlike(p), F.lit(False))
        in_name = lambda n: bool(re.search(p, n))
        target = None
    else:
        target = literal(e[1], e[2])
        s = _term_text(e)
        in_text = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(s.lower())), F.lit(False))
        in_name = lambda n: s.lower() in n.lower()
        if e[1] == "string":
            target = None

    def walk(v: Value) -> Column | None:
        t = L.under(v.type)
        if t[0] == "record":
            out = None
            for n, x in members(v).items():
                # the path of a nested field counts as its name
                got = F.lit(True) if in_name(n) else walk(x)
                if got is not None:
                    out = got if out is None else out | got
            return out
        if t[0] in ("array", "set"):
            probe = walk(Value(F.lit(None), t[1]))
            return None if probe is None else F.coalesce(F.exists(v.col, lambda x: walk(Value(x, t[1]))), F.lit(False))
        if t[0] == "map":
            parts = [F.coalesce(F.exists(k, lambda x, y=y: walk(Value(x, y)) if True else None), F.lit(False)) for k, y in ()]
            for keys, ty in ((F.map_keys(v.col), t[1]), (F.map_values(v.col), t[2])):
                got = walk(Value(keys, ("array", ty)))
                if got is not None:
                    parts.append(got)
            out = None
            for p_ in parts:
                out = p_ if out is None else out | p_
            return out
        if L.is_prim(t, "string") or t[0] == "enum":
            return in_text(v.col)
        if target is not None and L.is_prim(t, "net") and L.is_prim(target.type, "ip"):
            return contains(v, target)
        if target is not None and L.is_prim(target.type, "net") and L.is_prim(t, "ip"):
            return F.coalesce(contains(target, v), F.lit(False))
        if target is not None and comparable(t, target.type) and not L.is_prim(t, "null"):
            return equals(v, target)
        return None

    found = walk(this if this is not None else env.this()) if this is not None or not env.fields else None
    if this is None and env.fields:
        for n, x in env.fields.items():
            got = F.lit(True) if in_name(n) else walk(x)
            if got is not None:
                found = got if found is None else found | got
    return F.lit(False) if found is None else found


def _term_text(e: tuple) -> str:
    if e[1] == "duration":
        return str(e[2])
    return "null" if e[2] is None else ("true" if e[2] is True else "false" if e[2] is False else str(e[2]))


def _overexpr(e, env):
    from weir.functions.traverse import over_expression

    return over_expression(e[1], env)


_FORMS = {
    "lit": _lit, "field": _field, "this": _this, "dot": _dot, "index": _index, "slice": _slice, "bin": _bin, "un": _un, "cond": _cond, "call": _call, "record": _record, "array": _array,
    "set": _set, "map": _map, "fstring": _fstring, "type": _type, "cast": _cast, "agg": _agg, "regexp": _regexp, "glob": _glob, "term": _term, "overexpr": _overexpr,
}

__all__ = ["Env", "Value", "cast", "field_name", "lower"]
