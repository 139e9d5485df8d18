"""Logical types: the forms that the parser reads, and their Spark types.

A type is a tuple: ("prim", name), ("record", [(name, type)]), ("array", t),
("set", t), ("map", k, v), ("union", [t]), ("enum", [name]), ("error", t),
("named", name, t). What Spark has no type for is kept in a column's metadata.
"""

from __future__ import annotations

from pyspark.sql import types as T

Type = tuple


def prim(name: str) -> Type:
    return ("prim", name)


NULL, BOOL, STRING, BYTES, TIME, DURATION, IP, NET, TYPE = (prim(x) for x in ("null", "bool", "string", "bytes", "time", "duration", "ip", "net", "type"))
INT64, UINT64, FLOAT64 = prim("int64"), prim("uint64"), prim("float64")

_SPARK = {
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.LongType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "duration": T.LongType(), "time": T.TimestampType(), "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(),
    "string": T.StringType(), "ip": T.StringType(), "net": T.StringType(), "type": T.StringType(), "null": T.StringType(), "date": T.DateType(),
}
_LOGICAL = {
    T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool", T.StringType: "string",
    T.BinaryType: "bytes", T.TimestampType: "time", T.TimestampNTZType: "time", T.NullType: "null", T.DateType: "date", T.DecimalType: "float64", T.VarcharType: "string", T.CharType: "string",
}
ERROR_SPARK = T.StructType([T.StructField("message", T.StringType()), T.StructField("on", T.StringType())])
_BITS = {"8": 8, "16": 16, "32": 32, "64": 64}


def under(t: Type) -> Type:
    while t[0] == "named":
        t = t[2]
    return t


def spark_type(t: Type) -> T.DataType:
    t = under(t)
    if t[0] == "prim":
        return _SPARK[t[1]]
    if t[0] == "record":
        return T.StructType([T.StructField(n, spark_type(x), True, _metadata(x)) for n, x in t[1]])
    if t[0] in ("array", "set"):
        return T.ArrayType(spark_type(t[1]))
    if t[0] == "map":
        return T.MapType(spark_type(t[1]), spark_type(t[2]))
    if t[0] == "error":
        return ERROR_SPARK
    return T.StringType()


def plain(t: Type) -> bool:
    """Whether the Spark type alone tells the logical one."""
    t2 = t
    if t2[0] == "prim":
        return _LOGICAL.get(type(_SPARK[t2[1]])) == t2[1]
    if t2[0] == "array":
        return plain(t2[1])
    if t2[0] == "map":
        return plain(t2[1]) and plain(t2[2])
    return t2[0] == "record"


def _metadata(t: Type) -> dict:
    return {} if plain(t) else {"ltype": text(t)}


metadata = _metadata


def logical(d: T.DataType, meta: dict | None = None) -> Type:
    if meta and "ltype" in meta:
        from weir.lang.parser import Parser

        return Parser(meta["ltype"]).type()
    if isinstance(d, T.StructType):
        return ("record", [(f.name, logical(f.dataType, f.metadata)) for f in d.fields])
    if isinstance(d, T.ArrayType):
        return ("array", logical(d.elementType))
    if isinstance(d, T.MapType):
        return ("map", logical(d.keyType), logical(d.valueType))
    return prim(_LOGICAL.get(type(d), "string"))


def _quoted(n: str) -> str:
    import re

    return n if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", n) else '"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"'


def text(t: Type) -> str:
    """The canonical text of a type."""
    k = t[0]
    if k in ("prim", "ref"):
        return t[1]
    if k == "record":
        return "{" + ",".join(f"{_quoted(n)}:{text(x)}" for n, x in t[1]) + "}"
    if k == "array":
        return f"[{text(t[1])}]"
    if k == "set":
        return f"|[{text(t[1])}]|"
    if k == "map":
        return "|{" + f"{text(t[1])}:{text(t[2])}" + "}|"
    if k == "union":
        return "(" + ",".join(map(text, t[1])) + ")"
    if k == "enum":
        return "enum(" + ",".join(map(_quoted, t[1])) + ")"
    if k == "error":
        return f"error({text(t[1])})"
    return f"{t[1]}={text(t[2])}"


def kind(t: Type) -> str:
    t = under(t)
    return "primitive" if t[0] == "prim" else t[0]


def is_number(t: Type) -> bool:
    t = under(t)
    return t[0] == "prim" and (t[1].startswith(("int", "uint", "float")))


def is_int(t: Type) -> bool:
    t = under(t)
    return t[0] == "prim" and t[1].startswith(("int", "uint"))


def is_float(t: Type) -> bool:
    t = under(t)
    return t[0] == "prim" and t[1].startswith("float")


def is_prim(t: Type, *names: str) -> bool:
    t = under(t)
    return t[0] == "prim" and t[1] in names


def promote(a: Type, b: Type) -> Type:
    """The type of arithmetic on two numbers: floats win, then width, then the sign."""
    a, b = under(a), under(b)
    if a == b:
        return a
    if is_prim(a, "null"):
        return b
    if is_prim(b, "null"):
        return a
    if is_float(a) or is_float(b):
        return a if is_float(a) and not is_float(b) else b if is_float(b) and not is_float(a) else FLOAT64
    bits = lambda t: int(t[1].lstrip("uint"))
    n = max(bits(a), bits(b))
    unsigned = a[1][0] == "u" and b[1][0] == "u"
    if not unsigned and a[1][0] != b[1][0]:
        n = min(64, max(n, 2 * bits(a if a[1][0] == "u" else b)))
    return prim(f"{'u' if unsigned else ''}int{n}")


def merge(a: Type, b: Type) -> Type:
    """The fused type: records by field, arrays and sets to arrays, else a union (numbers to their promotion)."""
    if a == b or is_prim(b, "null"):
        return a
    if is_prim(a, "null"):
        return b
    ua, ub = under(a), under(b)
    if ua[0] == ub[0] == "record":
        out = dict(ua[1])
        for n, t in ub[1]:
            out[n] = merge(out[n], t) if n in out else t
        return ("record", list(out.items()))
    if ua[0] in ("array", "set") and ub[0] in ("array", "set"):
        return (ua[0] if ua[0] == ub[0] else "array", merge(ua[1], ub[1]))
    if ua[0] == ub[0] == "map":
        return ("map", merge(ua[1], ub[1]), merge(ua[2], ub[2]))
    members = []
    for t in (a, b):
        for x in t[1] if t[0] == "union" else [t]:
            if x not in members:
                members.append(x)
    return ("union", sorted(members, key=text))
