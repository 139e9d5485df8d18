"""Formats to DataFrames. Where values of a file differ in type, rows get their fused type."""

from __future__ import annotations

import json as _json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.plans import types as L


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def _separated(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Every cell is a number, a bool, empty or text; a column gets the one type that all its cells have."""
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=False, inferSchema=False)
    if not raw.columns:
        return raw
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    tests = [F.struct(F.bool_and(q(c).try_cast("double").isNotNull()).alias("n"), F.bool_and(q(c).isin("true", "false")).alias("b")).alias(f"c{i}") for i, c in enumerate(raw.columns)]
    told = raw.agg(*tests).first()
    cols = []
    for i, c in enumerate(raw.columns):
        t = told[i]
        cols.append((q(c).cast("double") if t["n"] else q(c).cast("boolean") if t["b"] else q(c)).alias(c))
    return raw.select(*cols)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, ",")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return _separated(spark, path, "\t")


def json(spark: SparkSession, path: str) -> DataFrame:
    """Lines, an array, or values that span lines."""
    rows = spark.read.text(path).limit(1).collect()
    first = rows[0][0].strip() if rows else ""
    lines = first.startswith("{")
    if lines:
        try:
            _json.loads(first)
        except ValueError:
            lines = False
    return spark.read.json(path, multiLine=not lines)


def line(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "this")


def arrows(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC streams; each file is decoded where it is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")


    def schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array([pa.ipc.open_stream(content.as_buffer()).schema.serialize().to_pybytes()], pa.binary())], names=["s"])

    # a schema of one file is read where the file is; only the schema comes here
    head = files.limit(1).mapInArrow(schemas, "s binary").collect()
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = pa.ipc.read_schema(pa.py_buffer(bytes(head[0]["s"])))
    spark_schema = from_arrow_schema(schema, prefer_timestamp_ntz=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                yield from pa.ipc.open_stream(content.as_buffer())

    return files.mapInArrow(run, spark_schema)


def sequence(spark: SparkSession, path: str, format: str = "zson") -> DataFrame:
    """Values of any type as a sequence (v, k) for ``weir.dynamic``: one value a line where lines are whole values, else file by file."""
    from weir.dynamic.run import of_lines
    from weir.dynamic.values import parse

    first = next((r[0] for r in spark.read.text(path).limit(20).collect() if r[0].strip()), "")
    try:
        parse(first)
        return of_lines(spark.read.text(path).where(F.trim("value") != ""))
    except ValueError:
        pass
    files = spark.read.text(path, wholetext=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weir.dynamic.values import parse_all, text

        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([text(v) for v in parse_all(t)], pa.string())], names=["value"])

    return of_lines(files.mapInArrow(run, "value string"))


def typed(seq: DataFrame) -> DataFrame:
    """A sequence of values as columns of their fused type; the types are found in one aggregate of the distinct ones."""
    from weir.dynamic.values import fuse_types, parse

    def types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            seen |= {L.text(parse(t).type) for t in b.column(0).to_pylist()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["t"])

    from weir.lang.parser import Parser

    texts = sorted(r["t"] for r in seq.select("v").mapInArrow(types, "t string").distinct().collect())
    fused = fuse_types([Parser(t).type() for t in texts]) if texts else ("record", [])
    is_record = L.under(fused)[0] == "record"
    fields = L.under(fused)[1] if is_record else [("this", fused)]
    schema = T.StructType([T.StructField(n, L.spark_type(t), True, L.metadata(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            vs = [parse(t) for t in b.column(0).to_pylist()]
            cols = []
            for (n, t), f in zip(fields, arrow):
                own = [v.data.get(n) if is_record and isinstance(v.data, dict) else None if is_record else v for v in vs]
                cols.append(pa.array([None if v is None else plain(v, t) for v in own], f.type))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return seq.select("v").mapInArrow(run, schema)


def plain(v, t: tuple) -> object:
    """A value as Python data for the Spark column of type t."""
    from weir.dynamic import values as V

    u = L.under(t)
    if v.data is None:
        return None
    if u[0] == "prim":
        if u[1] == "time":
            return v.data // 1000
        if u[1] in ("ip", "net"):
            return str(v.data)
        if u[1] == "type":
            return L.text(v.data)
        if L.is_float(u):
            return float(v.data)
        return v.data
    if u[0] == "record":
        return {n: plain(v.data[n], x) if n in v.data else None for n, x in u[1]}
    if u[0] in ("array", "set"):
        return [plain(x, u[1]) for x in v.data]
    if u[0] == "map":
        return [(plain(a, u[1]), plain(b, u[2])) for a, b in v.data]
    if u[0] == "error":
        inner = v.data
        message = inner.data.get("message") if isinstance(inner.data, dict) else inner
        on = inner.data.get("on") if isinstance(inner.data, dict) else None
        return {"message": str(message.data if message is not None else V.text(inner)), "on": None if on is None else V.text(on)}
    if u[0] == "enum":
        return str(v.data)
    return V.text(v)


def zson(spark: SparkSession, path: str) -> DataFrame:
    return typed(sequence(spark, path))


def _pinned(df: DataFrame) -> DataFrame:
    """df with the partitions that it has now, so that two passes see the same rows in each."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def zjson(spark: SparkSession, path: str) -> DataFrame:
    """Type ids count from where a file defines them on, so a first pass finds what each block of a file defines.

    The driver gets the distinct definitions, and a number for each block that has any; lines are read in all tasks.
    """
    from weir.sources.zjson import REFERENCE, Definitions, known_at, to_text

    text = spark.read.option("lineSep", "\n").text(path)
    lines = _pinned(text.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b")))

    def define(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], Definitions] = {}
        for b in batches:
            for t, *at in zip(*[c.to_pylist() for c in b.columns]):
                found.setdefault(tuple(at), Definitions()).add(_json.loads(t)["type"])
        rows = [(f, b, x.text()) for (f, b), x in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["f", "b", "d"])

    ids: dict[str, int] = {}
    blocks: dict[str, list[tuple[int, int]]] = {}
    for r in lines.where(F.regexp_replace("value", REFERENCE, " ").contains('"id"')).mapInArrow(define, "f string, b long, d string").toLocalIterator():
        blocks.setdefault(r["f"], []).append((r["b"], ids.setdefault(r["d"], len(ids))))
    texts = list(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for b in batches:
            out = []
            for t, *here in zip(*[c.to_pylist() for c in b.columns]):
                if here != at:
                    at, known = here, known_at(here[1], blocks.get(here[0], []), texts)
                if t.strip():
                    out.append(to_text(t, known))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["v"])

    return typed(lines.mapInArrow(run, "v string"))


_ZEEK = {"bool": "bool", "count": "uint64", "int": "int64", "double": "float64", "time": "time", "interval": "duration", "string": "string", "pattern": "string", "addr": "ip", "subnet": "net", "port": "uint16", "enum": "string"}


def zeek(spark: SparkSession, path: str) -> DataFrame:
    """Logs with #fields and #types, the same in all files; dotted names become records. Data lines are split and cast as columns.

    A header that differs from the first one fails the query, as its lines would come under wrong names.
    """
    lines = spark.read.text(path)
    head = [r[0] for r in lines.where(F.col("value").startswith("#")).limit(64).collect()]
    info = {}
    sep = "\t"
    for h in head:
        if h.startswith("#separator"):
            sep = h.split(" ", 1)[1].encode().decode("unicode_escape")
            continue
        k, *rest = h[1:].split(sep)
        info.setdefault(k, rest)
    unset, empty, inner = (info.get(k, [d])[0] for k, d in (("unset_field", "-"), ("empty_field", "(empty)"), ("set_separator", ",")))
    parts = F.split("value", sep.replace("|", r"\|"), -1)
    tree: dict = {}
    for i, (name, kind) in enumerate(zip(info.get("fields", []), info.get("types", []))):
        raw = F.get(parts, F.lit(i))
        c, t = _zeek_value(F.when(raw != unset, raw), kind, empty, inner)
        node = tree
        *front, last = name.split(".")
        for n in front:
            node = node.setdefault(n, {})
        node[last] = (c, t)

    def build(node: dict) -> list[tuple[str, Column, tuple]]:
        out = []
        for n, x in node.items():
            if isinstance(x, dict):
                got = build(x)
                out.append((n, F.struct(*[c.alias(m, metadata=L.metadata(t)) if L.metadata(t) else c.alias(m) for m, c, t in got]), ("record", [(m, t) for m, _, t in got])))
            else:
                out.append((n, *x))
        return out

    line = F.col("value")
    other = F.lit(False)
    for k in ("fields", "types"):
        if k in info:
            other = other | (line.startswith(f"#{k}{sep}") & (line != F.lit(sep.join([f"#{k}", *info[k]]))))
    data = lines.where(F.when(other, F.raise_error(F.concat(F.lit("zeek: headers differ: "), line)).cast("boolean")).otherwise(~line.startswith("#")))
    return data.select(*[c.alias(n, metadata=L.metadata(t)) if L.metadata(t) else c.alias(n) for n, c, t in build(tree)])


def _zeek_value(c: Column, kind: str, empty: str, inner: str) -> tuple[Column, tuple]:
    if kind.startswith(("set[", "vector[")):
        e = kind[kind.index("[") + 1 : -1]
        items = F.when(c == empty, F.array().cast("array<string>")).otherwise(F.split(c, inner))
        et = L.prim(_ZEEK.get(e, "string"))
        got = F.transform(items, lambda x: _zeek_value(x, e, empty, inner)[0])
        return (F.array_sort(F.array_distinct(got)), ("set", et)) if kind[0] == "s" else (got, ("array", et))
    t = L.prim(_ZEEK.get(kind, "string"))
    if kind == "bool":
        return F.when(c == "T", True).when(c == "F", False), t
    if kind == "time":
        return F.timestamp_micros(F.round(c.cast("decimal(20,6)") * 1000000).cast("bigint")), t
    if kind == "interval":
        return F.round(c.cast("decimal(20,9)") * 1000000000).cast("bigint"), t
    if kind == "string":
        return F.when(c == empty, "").otherwise(c), t
    return c.cast(L.spark_type(t)), t
