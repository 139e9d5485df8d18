"""The built-in functions over Values. Each gets lowered arguments, or its syntax where it decides at plan time."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from urllib.parse import unquote as _url_unquote  # noqa: F401

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.exprs import (
    Env, Value, boolean, cast, const_of, contains, equals, failed, java_regex, less, literal, lower, match, members, missing, pattern_of, record, search_term, string, to_text, unify, v6_hex,
)
from weir.lang.lexer import QueryError
from weir.plans import types as L

FUNCTIONS: dict[str, Callable] = {}
#: Functions that see syntax rather than values.
SYNTAX: dict[str, Callable] = {}
MAX_CALLS = 64


def fn(*names: str, at_least: int = 0, at_most: int | None = None):
    def add(f):
        for n in names:
            FUNCTIONS[n] = (f, at_least, at_most)
        return f

    return add


def syntax(*names: str):
    def add(f):
        for n in names:
            SYNTAX[n] = f
        return f

    return add


def call(name: str, args: list[tuple], env: Env) -> Value:
    if name in env.funcs:
        params, body, scope = env.funcs[name]
        if len(params) != len(args):
            raise QueryError(f"{name}: expected {len(params)} arguments")
        if env.depth >= MAX_CALLS:
            raise QueryError(f"{name}: recursion is too deep to unfold; give it as a Python function with Engine.function")
        return lower(body, env.child({p: lower(a, env) for p, a in zip(params, args)}))
    if name in env.python:
        return env.python[name](env, *[lower(a, env) for a in args])
    if name in SYNTAX:
        return SYNTAX[name](args, env)
    if name not in FUNCTIONS:
        raise QueryError(f"no such function: {name}")
    f, least, most = FUNCTIONS[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise QueryError(f"{name}: wrong number of arguments")
    return f(env, *[lower(a, env) for a in args])


def bad(v: Value, message: str, t=L.STRING) -> Value:
    return missing() if v.missing else Value(F.lit(None).cast(L.spark_type(t)), t, err=F.lit(True), message=message)


def text_fn(name: str, f: Callable[[Column], Column], t=L.STRING):
    def g(env, v):
        if v.missing:
            return v
        if not L.is_prim(v.type, "string", "null"):
            return bad(v, f"{name}: string arg required", t)
        return Value(f(v.col), t, err=v.err)

    FUNCTIONS[name] = (g, 1, 1)


# strings

text_fn("lower", F.lower)
text_fn("upper", F.upper)
_SPACE = r"[\s\x0B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
text_fn("trim", lambda c: F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", ""))
text_fn("rune_len", lambda c: F.coalesce(F.char_length(c), F.lit(0)).cast("bigint"), L.INT64)


@fn("split", at_least=2, at_most=2)
def _split(env, s, sep):
    if not (L.is_prim(s.type, "string", "null") and L.is_prim(sep.type, "string")):
        return bad(s, "split: string args required")
    p = F.lit(re.escape(sep.const)) if sep.known else F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))
    # Spark leaves an empty last piece where the separator is empty
    return Value(F.split(s.col, p, -1), ("array", L.STRING), err=failed(s, sep))


@fn("join", at_least=1, at_most=2)
def _join(env, a, sep=None):
    if L.under(a.type)[0] not in ("array", "set"):
        return bad(a, "join: array of string args required")
    d = F.lit("") if sep is None else sep.col
    if sep is not None and not sep.known:
        c = F.aggregate(F.transform(a.col, lambda x, i: F.concat(F.when(i > 0, d).otherwise(""), x)), F.lit(""), lambda acc, x: F.concat(acc, x))
    else:
        c = F.array_join(a.col, "" if sep is None else sep.const)
    return Value(c, L.STRING, err=failed(a))


@fn("replace", at_least=3, at_most=3)
def _replace(env, s, old, new):
    if not L.is_prim(s.type, "string", "null"):
        return bad(s, "replace: string arg required")
    return Value(F.replace(s.col, old.col, new.col), L.STRING, err=failed(s, old, new))


@fn("len", at_least=1, at_most=1)
def _len(env, v):
    t = L.under(v.type)
    if v.missing:
        return v
    if L.is_prim(t, "null"):
        c = F.lit(0)
    elif L.is_prim(t, "string", "bytes"):
        c = F.coalesce(F.octet_length(v.col), F.lit(0))
    elif L.is_prim(t, "ip"):
        c = F.when(v.col.contains("."), 4).otherwise(16)
    elif L.is_prim(t, "net"):
        c = F.when(v.col.contains("."), 8).otherwise(32)
    elif t[0] in ("array", "set", "map"):
        c = F.when(v.col.isNull(), 0).otherwise(F.size(v.col))
    elif t[0] == "record":
        c = F.lit(len(t[1]))
    else:
        return bad(v, "len: bad type", L.INT64)
    return Value(c.cast("bigint"), L.INT64, err=v.err)


@fn("levenshtein", at_least=2, at_most=2)
def _lev(env, a, b):
    return Value(F.levenshtein(a.col, b.col).cast("bigint"), L.INT64, err=failed(a, b))


@fn("base64", at_least=1, at_most=1)
def _base64(env, v):
    if L.is_prim(v.type, "bytes"):
        return Value(F.base64(v.col), L.STRING, err=v.err)
    if L.is_prim(v.type, "string"):
        ok = v.col.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
        return Value(F.when(ok, F.unbase64(v.col)), L.BYTES, err=~ok, message="base64: string argument is not base64")
    return bad(v, "base64: argument must a bytes or string type")


@fn("hex", at_least=1, at_most=1)
def _hex(env, v):
    if L.is_prim(v.type, "bytes"):
        return Value(F.lower(F.hex(v.col)), L.STRING, err=v.err)
    if L.is_prim(v.type, "string"):
        ok = v.col.rlike("^(?:[0-9A-Fa-f]{2})*$")
        return Value(F.when(ok, F.unhex(v.col)), L.BYTES, err=~ok, message="hex: string argument is not hexadecimal")
    return bad(v, "base64: argument must a bytes or string type")


def _group_count(p: str) -> int:
    return re.compile(re.sub(r"\\[pP]\{\w+\}|\(\?<(?=[A-Za-z])", lambda m: "(?P<" if m[0].startswith("(") else "x", p)).groups


@syntax("regexp")
def _regexp(args, env):
    if len(args) != 2:
        raise QueryError("regexp: expected 2 arguments")
    p, s = pattern_of(args[0], env), lower(args[1], env)
    if not L.is_prim(s.type, "string", "null"):
        return bad(s, "regexp: string required for second arg", ("array", L.STRING))
    # the groups of one match, null where there is none; every group is read from the same first match
    c = F.when(s.col.rlike(p), F.array(*[F.regexp_extract(s.col, p, i) for i in range(_group_count(p) + 1)]))
    return Value(c, ("array", L.STRING), err=s.err)


@syntax("regexp_replace")
def _regexp_replace(args, env):
    if len(args) != 3:
        raise QueryError("regexp_replace: expected 3 arguments")
    s, p, new = lower(args[0], env), pattern_of(args[1], env), lower(args[2], env)
    to = F.lit(re.sub(r"\$\{(\w+)\}", r"$\1", new.const)) if new.known else new.col
    return Value(F.regexp_replace(s.col, p, to), L.STRING, err=failed(s, new))


@syntax("grep")
def _grep(args, env):
    p = args[0]
    this = lower(args[1], env) if len(args) > 1 else None
    if p[0] == "lit" and p[1] == "string":
        p = ("term", "string", p[2])
    elif p[0] not in ("regexp", "glob"):
        v = lower(p, env)
        if not L.is_prim(v.type, "string"):
            return bad(v, "grep: pattern argument must be a string", L.BOOL)
        if v.known:
            p = ("term", "string", v.const)
        else:
            t = this if this is not None else env.this()
            c = F.contains(F.lower(to_text(t)), F.lower(v.col))
            return boolean(F.coalesce(c, F.lit(False)))
    if this is not None and this.missing:
        return this
    return boolean(search_term(p, env, this))


GROK = {
    "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*", "INT": r"[+-]?[0-9]+", "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)", "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "BASE16NUM": r"(?:0[xX])?[0-9A-Fa-f]+", "POSINT": r"\b[1-9][0-9]*\b", "NONNEGINT": r"\b[0-9]+\b", "USERNAME": r"[a-zA-Z0-9._-]+", "USER": r"%{USERNAME}", "EMAILLOCALPART": r"[a-zA-Z][a-zA-Z0-9_.+=:-]+",
    "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}", "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', "QS": r"%{QUOTEDSTRING}", "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}", "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])", "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}", "IP": r"(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?", "HOST": r"%{HOSTNAME}", "IPORHOST": r"(?:%{IP}|%{HOSTNAME})", "HOSTPORT": r"%{IPORHOST}:%{POSINT}",
    "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+", "WINPATH": r"(?:[A-Za-z]+:|\\)(?:\\[^\\?*]*)+", "PATH": r"(?:%{UNIXPATH}|%{WINPATH})", "URIPROTO": r"[A-Za-z][A-Za-z0-9+.-]+", "URIHOST": r"%{IPORHOST}(?::%{POSINT})?", "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\[\]<>-]*", "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?", "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?",
    "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b", "MONTHNUM": r"(?:0?[1-9]|1[0-2])", "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])",
    "DAY": r"(?:Mon(?:day)?|Tue(?:sday)?|Wed(?:nesday)?|Thu(?:rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)", "YEAR": r"[0-9]{2,4}", "HOUR": r"(?:2[0123]|[01]?[0-9])", "MINUTE": r"[0-5][0-9]", "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?",
    "TIME": r"%{HOUR}:%{MINUTE}(?::%{SECOND})?", "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))", "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}", "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}", "DATE": r"(?:%{DATE_US}|%{DATE_EU})", "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}", "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+",
    "SYSLOGPROG": r"%{PROG:program}(?:\[%{POSINT:pid}\])?", "SYSLOGHOST": r"%{IPORHOST}", "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGHOST:logsource} )?%{SYSLOGPROG}:", "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}",
    "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo(?:rmation)?|INFO(?:RMATION)?|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)",
    "COMMONAPACHELOG": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)',
    "COMBINEDAPACHELOG": r"%{COMMONAPACHELOG} %{QS:referrer} %{QS:agent}",
}


def grok_regex(pattern: str, own: dict[str, str]) -> tuple[str, list[str]]:
    """A pattern with numbered groups, and the name of each."""
    names: list[str] = []

    def one(m: re.Match) -> str:
        p, name = m[1], m[2]
        if p not in own and p not in GROK:
            raise QueryError(f"grok: no such pattern: {p}")
        before = len(names)
        if name:
            names.append(name)
        inner = expand(own.get(p) or GROK[p])
        if name and name in names[:before]:
            names.pop(before)
            return f"(?:{inner})"
        return f"({inner})" if name else f"(?:{inner})"

    def expand(p: str) -> str:
        # groups written in a pattern don't capture
        out, i = [], 0
        for m in re.finditer(r"%\{(\w+)(?::([^:}]+))?(?::\w+)?\}", p):
            out.append(re.sub(r"(?<!\\)\((?!\?)", "(?:", p[i : m.start()]))
            out.append(one(m))
            i = m.end()
        out.append(re.sub(r"(?<!\\)\((?!\?)", "(?:", p[i:]))
        return "".join(out)

    return expand(pattern), names


@fn("grok", at_least=2, at_most=3)
def _grok(env, p, s, defs=None):
    own = {}
    if defs is not None:
        for line in str(const_of(defs, "grok definitions")).splitlines():
            if line.strip():
                n, _, body = line.strip().partition(" ")
                own[n] = body.strip()
    regex, names = grok_regex(str(const_of(p, "a grok pattern")), own)
    ok = F.coalesce(s.col.rlike(regex), F.lit(False))
    c = F.struct(*[F.regexp_extract(s.col, regex, i + 1).alias(n) for i, n in enumerate(names)]) if names else F.struct(F.lit(None).cast("string").alias("_empty"))
    return Value(F.when(ok, c), ("record", [(n, L.STRING) for n in names]), err=~ok, message="grok: value does not match pattern")


@fn("parse_uri", at_least=1, at_most=1)
def _parse_uri(env, s):
    if not L.is_prim(s.type, "string", "null"):
        return bad(s, "parse_uri: string arg required")
    part = lambda p: F.regexp_extract(s.col, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:([^:@/?#]*)(?::([^@/?#]*))?@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", p)
    some = lambda c: F.when(c != "", c)
    decoded = lambda c: F.try_url_decode(c)
    pairs = F.filter(F.transform(F.split(part(7), "[&]"), lambda x: F.struct(decoded(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.coalesce(decoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)), F.lit("")).alias("v"))), lambda x: x["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    query = F.when(part(7) != "", F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda x: x["k"] == k), lambda x: x["v"]))))
    fields = {
        "scheme": Value(some(F.lower(part(1))), L.STRING), "opaque": Value(F.when((part(1) != "") & ~s.col.rlike("^[^:]*:/"), some(part(6))), L.STRING), "user": Value(some(part(2)), L.STRING), "password": Value(some(part(3)), L.STRING),
        "host": Value(some(F.regexp_replace(part(4), r"^\[|\]$", "")), L.STRING), "port": Value(some(part(5)).try_cast("int"), L.prim("uint16")), "path": Value(some(decoded(F.replace(part(6), F.lit("+"), F.lit("%2B")))), L.STRING), "query": Value(query, ("map", L.STRING, ("array", L.STRING))), "fragment": Value(some(part(8)), L.STRING),
    }
    r = record(fields)
    return Value(F.when(s.col.isNotNull(), r.col), r.type, err=s.err)


@fn("parse_zson", at_least=1, at_most=1)
def _parse_zson(env, s):
    """Text to values of one type. A constant is read when planning; of a column, the type is first aggregated
    over all rows (one pass that gives one value), and texts beyond JSON are then null."""
    if s.known and isinstance(s.const, str):
        from weir.sources.zson import parse_value

        return parse_value(s.const)
    if env.df is None or not L.is_prim(s.type, "string"):
        return bad(s, "parse_zson: string arg required")
    told = env.df.select(F.schema_of_variant_agg(F.try_parse_json(s.col))).first()[0]
    ddl = re.sub(r"DECIMAL\(\d+, ?\d+\)", "DOUBLE", told.replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace("VOID", "STRING"))
    c = F.from_json(s.col, ddl) if ddl.startswith(("STRUCT", "ARRAY")) else s.col.try_cast(ddl)
    from pyspark.sql.types import StructType

    t = L.logical(StructType.fromDDL(f"x {ddl}")["x"].dataType)
    err = F.try_parse_json(s.col).isNull() & s.col.isNotNull()
    return Value(F.when(~err, c), t, err=err, message="parse_zson: syntax error")


@fn("ksuid", at_least=0, at_most=1)
def _ksuid(env, v=None):
    from weir.functions.udfs import ksuid_bytes, ksuid_text, new_ksuid

    if v is None:
        return Value(new_ksuid(F.rand()), L.BYTES)
    if L.is_prim(v.type, "bytes"):
        return Value(ksuid_text(v.col), L.STRING, err=v.err)
    c = ksuid_bytes(v.col)
    return Value(c, L.BYTES, err=c.isNull() & v.col.isNotNull(), message="ksuid: invalid ksuid value")


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "h": "MMM", "a": "E", "A": "EEEE", "p": "a", "I": "hh", "j": "DDD", "e": "ppd", "k": "ppH", "l": "pph", "f": "SSSSSS", "L": "SSS", "z": "xx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "X": "HH:mm:ss", "x": "MM/dd/yy", "v": "ppd-MMM-yyyy", "r": "hh:mm:ss a", "c": "E MMM ppd HH:mm:ss yyyy"}


@fn("strftime", at_least=2, at_most=2)
def _strftime(env, f, t):
    out, literal_ = [], ""
    text = str(const_of(f, "a time format"))
    parts: list = []
    i = 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            c = text[i + 1]
            i += 2
            if c in "%nt":
                literal_ += {"%": "%", "n": "\n", "t": "\t"}[c]
                continue
            special = {"s": F.unix_seconds(t.col.cast("timestamp")).cast("string"), "C": F.substring(F.date_format(t.col, "yyyy"), 1, 2), "u": (F.weekday(t.col) + 1).cast("string"), "w": ((F.weekday(t.col) + 1) % 7).cast("string"), "V": F.lpad(F.weekofyear(t.col).cast("string"), 2, "0"), "U": F.lpad(F.floor((F.dayofyear(t.col) + 6 - (F.weekday(t.col) + 1) % 7) / 7).cast("string"), 2, "0")}
            if c in special:
                parts += [F.lit(literal_), special[c]]
                literal_ = ""
                continue
            if c not in _STRFTIME:
                raise QueryError(f"strftime: unknown specification %{c}")
            parts += [F.lit(literal_), F.date_format(t.col, _STRFTIME[c])]
            literal_ = ""
        else:
            literal_ += text[i]
            i += 1
    out = parts + [F.lit(literal_)]
    if not L.is_prim(t.type, "time", "null"):
        return bad(t, "strftime: time arg required")
    return Value(F.concat(*out), L.STRING, err=t.err)


# numbers


def number_fn(name: str, f: Callable[[Value], Value]):
    def g(env, v):
        if v.missing:
            return v
        if not (L.is_number(v.type) or L.is_prim(v.type, "null", "duration")):
            return bad(v, f"{name}: not a number", L.FLOAT64)
        return f(v)

    FUNCTIONS[name] = (g, 1, 1)


def _same_type(f):
    return lambda v: v if L.is_int(v.type) or L.is_prim(v.type, "null") else Value(f(v.col).cast(L.spark_type(v.type)), v.type, err=v.err)


number_fn("abs", lambda v: Value(F.abs(v.col), v.type, err=v.err))
number_fn("ceil", _same_type(F.ceil))
number_fn("floor", _same_type(F.floor))
number_fn("round", _same_type(lambda c: F.signum(c) * F.floor(F.abs(c) + 0.5)))
number_fn("sqrt", lambda v: Value(F.sqrt(v.col.cast("double")), L.FLOAT64, err=v.err))


def _log(v):
    x = v.col.cast("double")
    return Value(F.when(x > 0, F.ln(x)), L.FLOAT64, err=F.coalesce(x <= 0, F.lit(False)), message="log: illegal argument")


number_fn("log", _log)


@fn("pow", at_least=2, at_most=2)
def _pow(env, x, y):
    return Value(F.pow(x.col.cast("double"), y.col.cast("double")), L.FLOAT64, err=failed(x, y))


def _extreme(least: bool):
    def f(env, *vs):
        for v in vs:
            if v.missing:
                return v
            if not (L.is_number(v.type) or L.is_prim(v.type, "null")):
                return bad(v, f"{'min' if least else 'max'}: not a number", L.FLOAT64)
        # the reference narrows to the first argument's type and so cuts fractions; here numbers are promoted
        t = vs[0].type
        for v in vs[1:]:
            t = L.promote(t, v.type)
        cols = [v.col.cast(L.spark_type(t)) for v in vs]
        null = None
        for c in cols:
            null = c.isNull() if null is None else null | c.isNull()
        return Value(F.when(~null, (F.least if least else F.greatest)(*cols)) if len(cols) > 1 else cols[0], t, err=failed(*vs))

    return f


FUNCTIONS["min"] = (_extreme(True), 1, None)
FUNCTIONS["max"] = (_extreme(False), 1, None)


# time


@fn("now", at_least=0, at_most=0)
def _now(env):
    return Value(F.current_timestamp(), L.TIME)


@fn("bucket", at_least=2, at_most=2)
def bucket(env, t, span):
    if t.missing:
        return t
    n = span.const if span.known and L.is_prim(span.type, "duration", "int64") else None
    ns = F.lit(n).cast("bigint") if n is not None else span.col.cast("bigint")
    if L.is_prim(t.type, "time"):
        us = F.unix_micros(t.col.cast("timestamp"))
        if n is not None and n % 1000 == 0:
            c = us - F.pmod(us, F.lit(n // 1000))
        else:
            c = F.call_function("div", us * 1000 - F.pmod(us * 1000, ns), F.lit(1000))
        c = F.timestamp_micros(c)
        return Value(c.cast("timestamp_ntz") if t.ntz else c, L.TIME, err=t.err, ntz=t.ntz)
    if L.is_prim(t.type, "duration") or L.is_int(t.type):
        return Value((t.col.cast("bigint") - t.col.cast("bigint") % ns), L.DURATION if L.is_prim(t.type, "duration") else t.type, err=failed(t, span))
    if L.is_float(t.type) and L.is_number(span.type):
        return Value(F.floor(t.col / span.col) * span.col, t.type, err=failed(t, span))
    return bad(t, "bucket: first argument is not a time", L.TIME)


@syntax("every")
def _every(args, env):
    return bucket(env, lower(("field", "ts"), env), lower(args[0], env))


# types, errors, structure


def _type_value(t) -> Value:
    return Value(F.lit(L.text(t)), L.TYPE, const=t)


@fn("typeof", at_least=1, at_most=1)
def _typeof(env, v):
    return _type_value(("error", L.STRING) if v.missing else v.type)


@fn("typeunder", at_least=1, at_most=1)
def _typeunder(env, v):
    return _type_value(("error", L.STRING) if v.missing else L.under(v.type))


@fn("kind", at_least=1, at_most=1)
def _kind(env, v):
    t = v.const if L.is_prim(v.type, "type") and isinstance(v.const, tuple) else v.type
    return string("error" if v.missing else L.kind(t))


@fn("nameof", at_least=1, at_most=1)
def _nameof(env, v):
    t = v.const if L.is_prim(v.type, "type") and isinstance(v.const, tuple) else v.type
    return string(t[1]) if t[0] == "named" else missing()


@fn("typename", at_least=1, at_most=1)
def _typename(env, v):
    n = str(const_of(v, "a type name"))
    return _type_value(("named", n, env.types[n])) if n in env.types else missing()


@fn("is", at_least=1, at_most=2)
def _is(env, a, b=None):
    v, t = (env.this(), a) if b is None else (a, b)
    want = t.const if isinstance(t.const, tuple) else None
    if want is None and t.known:
        n = str(t.const)
        return boolean(F.lit(v.type[0] == "named" and v.type[1] == n or L.text(v.type) == n))
    return boolean(F.lit(not v.missing and (v.type == want or L.text(v.type) == L.text(want))))


@fn("under", at_least=1, at_most=1)
def _under(env, v):
    t = L.under(v.type)
    if t[0] == "error":
        return Value(v.col.getField("message"), L.STRING)
    return Value(v.col, t, missing=v.missing, err=v.err, ntz=v.ntz, const=v.const)


@fn("error", at_least=1, at_most=1)
def _error(env, v):
    return Value(F.struct(to_text(v).alias("message"), F.lit(None).cast("string").alias("on")), ("error", v.type), err=F.lit(True), message=str(v.const) if v.known else "error")


@fn("is_error", at_least=1, at_most=1)
def _is_error(env, v):
    return boolean(F.lit(True) if v.missing else F.coalesce(v.err, F.lit(False)) if v.err is not None else F.lit(L.under(v.type)[0] == "error"))


@fn("has_error", at_least=1, at_most=1)
def _has_error(env, v):
    def any_error(x: Value) -> Column:
        t = L.under(x.type)
        out = F.coalesce(x.err, F.lit(False)) if x.err is not None else F.lit(x.missing)
        if t[0] == "error":
            return F.coalesce(x.col.isNotNull(), F.lit(False))
        for m in members(x).values():
            out = out | any_error(m)
        return out

    return boolean(any_error(v))


@fn("quiet", at_least=1, at_most=1)
def _quiet(env, v):
    return Value(v.col, v.type, missing=v.missing, quiet=v.missing, err=v.err, ntz=v.ntz)


@fn("has", at_least=1)
def _has(env, *vs):
    out = F.lit(True)
    for v in vs:
        if v.missing:
            return boolean(F.lit(False))
        if v.err is not None and v.message == "missing":
            out = out & ~F.coalesce(v.err, F.lit(False))
    return boolean(out)


@fn("missing", at_least=1)
def _missing(env, *vs):
    return boolean(~_has(env, *vs).col)


@fn("coalesce", at_least=1)
def _coalesce(env, *vs):
    real = [v for v in vs if not v.missing and not L.is_prim(v.type, "null")]
    if not real:
        return Value(F.lit(None).cast("string"), L.NULL)
    if len(real) == 1:
        return Value(real[0].col, real[0].type, ntz=real[0].ntz, const=real[0].const)
    t, cols = unify(real)
    return Value(F.coalesce(*cols), t, ntz=all(v.ntz for v in real))


@fn("compare", at_least=2, at_most=3)
def _compare(env, a, b, nulls_max=None):
    top = F.lit(True) if nulls_max is None else nulls_max.col
    if not (L.is_prim(a.type, "null") or L.is_prim(b.type, "null") or (L.is_number(a.type) and L.is_number(b.type)) or a.type == b.type):
        ra, rb = type_rank(a.type), type_rank(b.type)
        c = F.lit(-1 if ra < rb else 1)
    else:
        c = F.when(less(a, b, "<"), -1).when(equals(a, b), 0).otherwise(1)
    null = F.when(a.col.isNull() & b.col.isNull(), 0).when(a.col.isNull(), F.when(top, 1).otherwise(-1)).when(b.col.isNull(), F.when(top, -1).otherwise(1))
    return Value(F.coalesce(null, c).cast("bigint"), L.INT64, err=failed(a, b))


_ORDER = "uint8 uint16 uint32 uint64 int8 int16 int32 int64 duration time float16 float32 float64 bool bytes string ip net type null".split()
_KINDS = ["record", "array", "set", "map", "union", "enum", "error"]


def type_rank(t) -> tuple:
    t = L.under(t)
    return (0, _ORDER.index(t[1])) if t[0] == "prim" and t[1] in _ORDER else (1, _KINDS.index(t[0]) if t[0] in _KINDS else 9, L.text(t))


def paths(t, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], tuple]]:
    """Leaves of a record type, with their types."""
    t = L.under(t)
    if t[0] != "record":
        return [(at, t)]
    return [p for n, x in t[1] for p in paths(x, (*at, n))]


@fn("fields", at_least=1, at_most=1)
def _fields(env, v):
    t = v.const if L.is_prim(v.type, "type") and isinstance(v.const, tuple) else v.type
    if L.under(t)[0] != "record":
        return missing()
    out = [F.array(*map(F.lit, p)) for p, _ in paths(t)]
    return Value(F.array(*out) if out else F.array().cast("array<array<string>>"), ("array", ("array", L.STRING)))


@fn("flatten", at_least=1, at_most=1)
def _flatten(env, v):
    if L.under(v.type)[0] != "record":
        return v
    leaves = []
    for p, t in paths(v.type):
        c = v.col
        for n in p:
            c = c.getField(n)
        leaves.append((p, Value(c, t)))
    t, cols = unify([x for _, x in leaves])
    c = F.array(*[F.struct(F.array(*map(F.lit, p)).alias("key"), x.alias("value")) for (p, _), x in zip(leaves, cols)])
    return Value(c, ("array", ("record", [("key", ("array", L.STRING)), ("value", t)])), err=v.err)


@fn("unflatten", at_least=1, at_most=1)
def _unflatten(env, v):
    """Names come from data, so the result is a map from dotted paths; constant keys would need no data."""
    t = L.under(v.type)
    e = L.under(t[1]) if t[0] == "array" else ("prim", "null")
    if e[0] != "record" or [n for n, _ in e[1]] != ["key", "value"]:
        return v
    kt = L.under(e[1][0][1])
    key = (lambda x: F.array_join(x["key"], ".")) if kt[0] == "array" else (lambda x: x["key"])
    keys = F.transform(v.col, key)
    last = F.filter(v.col, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), key(x)))
    return Value(F.map_from_entries(F.transform(last, lambda x: F.struct(key(x).alias("key"), x["value"].alias("value")))), ("map", L.STRING, e[1][1][1]), err=v.err)


@fn("nest_dotted", at_least=0, at_most=1)
def _nest_dotted(env, v=None):
    v = env.this() if v is None else v
    tree: dict = {}
    for n, x in (env.fields if v is None else members(v)).items():
        node = tree
        *front, last = n.split(".")
        for k in front:
            node = node.setdefault(k, {})
            if not isinstance(node, dict):
                return bad(v, "nest_dotted: fields conflict")
        node[last] = x

    def build(node) -> Value:
        return node if isinstance(node, Value) else record({k: build(x) for k, x in node.items()})

    return build(tree)


@syntax("map")
def _map(args, env):
    v = lower(args[0], env)
    t = L.under(v.type)
    if t[0] not in ("array", "set"):
        return bad(v, "map: array or set required")
    name = args[1][1] if args[1][0] == "field" else None
    if name is None:
        raise QueryError("map: the second argument must be the name of a function")
    apply = lambda x: call(name, [("field", "$item")], env.child({"$item": Value(x, t[1])}))
    got = apply(F.lit(None).cast(L.spark_type(t[1])))
    c = F.transform(v.col, lambda x: apply(x).col)
    return Value(F.array_sort(F.array_distinct(c)) if t[0] == "set" else c, (t[0], got.type), err=v.err)


def _shaper(*steps: str):
    def f(args, env):
        from weir.functions.shapers import shaped

        v = lower(args[0], env) if len(args) > 1 else env.this()
        t = lower(args[-1], env)
        want = const_of(t, "a type")
        if not isinstance(want, tuple):
            want = ("named", want, env.types[want]) if want in env.types else env.resolve(("prim", want))
        return cast(v, want) if steps == ("cast",) and L.under(want)[0] != "record" else shaped(v, want, steps)

    return f


for _name, _steps in {"cast": ("cast",), "crop": ("crop",), "fill": ("fill",), "fit": ("crop", "fill"), "order": ("order",), "shape": ("cast", "fill", "order")}.items():
    SYNTAX[_name] = _shaper(*_steps)


# networks


def v4_number(c: Column) -> Column:
    o = F.split(c, r"\.")
    return sum((F.get(o, F.lit(i)).cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))


def v4_text(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, 24 - 8 * i).bitwiseAND(F.lit(255).cast("bigint"))).cast("string") for i in range(4)])


def net_contains(net: Value, ip: Value) -> Column:
    """Whether an address lies in a network, by numbers for v4 and by leading bits for v6."""
    base, bits = F.split_part(net.col, F.lit("/"), F.lit(1)), F.split_part(net.col, F.lit("/"), F.lit(2)).cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    v4 = F.when(ip.col.contains("."), F.call_function("div", v4_number(ip.col), size) == F.call_function("div", v4_number(base), size)).otherwise(False)
    binary = lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.lpad(F.conv(F.substring(v6_hex(c), i, F.lit(1)), 16, 2), 4, "0")), "")
    v6 = F.when(ip.col.contains(":"), F.substring(binary(ip.col), F.lit(1), bits) == F.substring(binary(base), F.lit(1), bits)).otherwise(False)
    if net.known:
        return F.coalesce(v4 if ":" not in str(net.const) else v6, F.lit(False))
    return F.coalesce(F.when(base.contains("."), v4).otherwise(v6), F.lit(False))


@fn("cidr_match", at_least=2, at_most=2)
def _cidr_match(env, net, v):
    if v.missing:
        return v
    if not L.is_prim(net.type, "net"):
        return bad(net, "cidr_match: not a net", L.BOOL)

    def walk(x: Value) -> Column:
        t = L.under(x.type)
        if L.is_prim(t, "ip"):
            return net_contains(net, x)
        out = F.lit(False)
        for m in members(x).values():
            out = out | walk(m)
        if t[0] in ("array", "set"):
            out = F.coalesce(F.exists(x.col, lambda y: walk(Value(y, t[1]))), F.lit(False))
        return out

    return boolean(walk(v))


@fn("network_of", at_least=1, at_most=2)
def _network_of(env, ip, mask=None):
    if not L.is_prim(ip.type, "ip"):
        return bad(ip, "network_of: not an IP", L.NET)
    err = ip.err
    if mask is None:
        first = F.split_part(ip.col, F.lit("."), F.lit(1)).cast("int")
        bits = F.when(first < 128, 8).when(first < 192, 16).otherwise(24)
    elif L.is_prim(mask.type, "ip"):
        m = v4_number(mask.col)
        bits = F.bit_count(m).cast("int")
        ok = m == F.lit(1 << 32) - F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
        err, bits = ~ok, F.when(ok, bits)
    else:
        bits = mask.col.cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    n = v4_number(ip.col)
    v4 = F.concat(v4_text(n - F.pmod(n, size)), F.lit("/"), bits.cast("string"))
    from weir.functions.udfs import v6_network

    is_v4 = ip.col.contains(".")
    if ip.known:
        return Value(v4 if "." in str(ip.const) else v6_network(ip.col, bits), L.NET, err=err, message="network_of: mask is non-contiguous")
    return Value(F.when(is_v4, v4).otherwise(v6_network(F.when(~is_v4, ip.col), bits)) if mask is not None and not L.is_prim(mask.type, "ip") and getattr(env, "v6", False) else F.when(is_v4, v4), L.NET, err=err, message="network_of: mask is non-contiguous")


__all__ = ["FUNCTIONS", "SYNTAX", "call", "contains", "ipaddress", "java_regex", "literal", "match"]
