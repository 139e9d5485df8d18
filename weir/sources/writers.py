"""DataFrames to formats. Each task writes its own part of a result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.exprs import Value, to_text
from weir.plans import types as L


def _out(df: DataFrame, mode: str, split: str | None, max_records: int | None):
    w = df.write.mode(mode)
    if max_records:
        w = w.option("maxRecordsPerFile", max_records)
    return w.partitionBy(split) if split else w


def parquet(df: DataFrame, path: str, mode: str = "error", split: str | None = None, max_records: int | None = None) -> None:
    _out(df, mode, split, max_records).parquet(path)


def json(df: DataFrame, path: str, mode: str = "error", split: str | None = None, max_records: int | None = None) -> None:
    _out(df, mode, split, max_records).option("ignoreNullFields", "false").json(path)


def _flat(df: DataFrame) -> list[tuple[str, Column, tuple]]:
    """Leaves of records by dotted names."""
    out = []

    def walk(name: str, c: Column, t: tuple) -> None:
        u = L.under(t)
        if u[0] == "record":
            for n, x in u[1]:
                walk(f"{name}.{n}", c.getField(n), x)
        else:
            out.append((name, c, t))

    for f in df.schema.fields:
        walk(f.name, F.col("`" + f.name.replace("`", "``") + "`"), L.logical(f.dataType, f.metadata))
    return out


def _text(c: Column, t: tuple) -> Column:
    return to_text(Value(c, t)) if not L.is_prim(t, "string") else c


def _separated(df: DataFrame, path: str, sep: str, mode: str, split: str | None, max_records: int | None) -> None:
    flat = df.select(*[_text(c, t).alias(n) for n, c, t in _flat(df)])
    _out(flat, mode, split, max_records).csv(path, header=True, sep=sep, quote='"', escape='"')


def csv(df: DataFrame, path: str, mode: str = "error", split: str | None = None, max_records: int | None = None) -> None:
    _separated(df, path, ",", mode, split, max_records)


def tsv(df: DataFrame, path: str, mode: str = "error", split: str | None = None, max_records: int | None = None) -> None:
    _separated(df, path, "\t", mode, split, max_records)


def text(df: DataFrame, path: str, mode: str = "error", **_) -> None:
    """Values without names, by tabs."""
    df.select(F.concat_ws("\t", *[F.coalesce(_text(c, t), F.lit("-")) for _, c, t in _flat(df)]).alias("value")).write.mode(mode).text(path)


def values(df: DataFrame):
    """A function from an Arrow batch of df to values."""
    types = [(f.name, L.logical(f.dataType, f.metadata)) for f in df.schema.fields]
    single = [n for n, _ in types] == ["this"]

    def of(batch: pa.RecordBatch) -> list:
        from weir.dynamic.values import Val

        cols = [batch.column(i).to_pylist() for i in range(len(types))]
        if single:
            return [val(x, types[0][1]) for x in cols[0]]
        t = ("record", types)
        return [Val(t, {n: val(x, ty) for (n, ty), x in zip(types, row)}) for row in zip(*cols)]

    return of


def val(x: object, t: tuple):
    """Python data of a Spark column as a value."""
    import datetime as dt
    import ipaddress

    from weir.dynamic import values as V
    from weir.dynamic.values import Val

    u = L.under(t)
    if x is None:
        return Val(t, None)
    if u[0] == "record":
        return Val(t, {n: val(x[n], y) for n, y in u[1]})
    if u[0] in ("array", "set"):
        return Val(t, [val(y, u[1]) for y in x])
    if u[0] == "map":
        return Val(t, sorted(((val(a, u[1]), val(b, u[2])) for a, b in (x.items() if isinstance(x, dict) else x)), key=lambda p: V.key(p[0])))
    if u[0] == "error":
        return V.failure(x["message"]) if x["on"] is None else V.failure(x["message"], V.string(x["on"]))
    if u[0] == "union":
        return V.parse(x)
    if u[0] == "enum":
        return Val(t, x)
    if u[1] == "time" and isinstance(x, dt.datetime):
        x = x if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)
        return Val(t, round((x - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds() * 1e6) * 1000)
    if u[1] == "ip":
        return Val(t, ipaddress.ip_address(x))
    if u[1] == "net":
        return Val(t, ipaddress.ip_network(x, strict=False))
    if u[1] == "type":
        return V.parse(f"<{x}>")
    if u[1] == "date":
        return V.string(x.isoformat())
    return Val(t, x)


def _lines(df: DataFrame, make) -> DataFrame:
    """One text a row; make gives a fresh function from values to texts for each task."""
    of = values(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([one(v) for v in of(b)], pa.string())], names=["value"])

    return df.mapInArrow(run, "value string")


def zson_lines(df: DataFrame) -> DataFrame:
    from weir.dynamic.values import text as written

    return _lines(df, lambda: written)


def zson(df: DataFrame, path: str, mode: str = "error", **_) -> None:
    zson_lines(df).write.mode(mode).text(path)


def zjson(df: DataFrame, path: str, mode: str = "error", **_) -> None:
    from weir.sources.zjson import Writer

    _lines(df, lambda: Writer().line).write.mode(mode).text(path)


_ZEEK = {"bool": "bool", "time": "time", "duration": "interval", "ip": "addr", "net": "subnet", "string": "string", "float64": "double", "float32": "double"}


def _zeek_type(t: tuple) -> str:
    u = L.under(t)
    if u[0] in ("array", "set"):
        return f"{'vector' if u[0] == 'array' else 'set'}[{_zeek_type(u[1])}]"
    if u[0] != "prim":
        return "string"
    return _ZEEK.get(u[1]) or ("count" if u[1][0] == "u" else "int" if u[1].startswith("int") else "string")


def _zeek_text(c: Column, t: tuple) -> Column:
    u = L.under(t)
    if u[0] in ("array", "set"):
        return F.when(F.size(c) == 0, "(empty)").otherwise(F.array_join(F.transform(c, lambda x: _zeek_text(x, u[1])), ","))
    if L.is_prim(u, "bool"):
        return F.when(c, "T").otherwise("F")
    if L.is_prim(u, "time"):
        return (F.unix_micros(c.cast("timestamp")) / F.lit(1000000).cast("decimal(20,0)")).cast("decimal(20,6)").cast("string")
    if L.is_prim(u, "duration"):
        return (c.cast("decimal(20,0)") / F.lit(1000000000).cast("decimal(20,0)")).cast("decimal(20,6)").cast("string")
    if L.is_prim(u, "string"):
        return F.when(c == "", "(empty)").otherwise(c)
    return to_text(Value(c, t)) if u[0] == "prim" and not L.is_float(u) else c.cast("string")


def zeek(df: DataFrame, path: str, mode: str = "error", **_) -> None:
    """Each part file has the header, so each is a whole log."""
    flat = _flat(df)
    head = ["#separator \\x09", "#set_separator\t,", "#empty_field\t(empty)", "#unset_field\t-", "#fields\t" + "\t".join(n for n, _, _ in flat), "#types\t" + "\t".join(_zeek_type(t) for _, _, t in flat)]
    lines = df.select(F.concat_ws("\t", *[F.when(c.isNull(), "-").otherwise(_zeek_text(c, t)) for _, c, t in flat]).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(head)], names=["value"])
                first = False
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["value"])

    lines.mapInArrow(run, "value string").write.mode(mode).text(path)


def arrows(df: DataFrame, path: str, mode: str = "error", **_) -> int:
    """One Arrow IPC stream a task, written by the task into a folder that all share; gives the rows written."""
    import os

    os.makedirs(path, exist_ok=mode != "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, name = 0, None, f"{path}/part-{uuid.uuid4().hex}.arrows"
        for b in batches:
            if w is None:
                w = pa.ipc.new_stream(f"{name}.tmp", b.schema)
            w.write_batch(b)
            n += b.num_rows
        if w is not None:
            w.close()
            os.rename(f"{name}.tmp", name)  # a lost task leaves no part
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def table(df: DataFrame, path: str | None = None, n: int = 20, **_) -> None:
    df.show(n, truncate=False)


def null(df: DataFrame, path: str | None = None, **_) -> None:
    df.write.format("noop").mode("overwrite").save()
