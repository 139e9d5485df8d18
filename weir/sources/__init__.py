"""Reading and writing of files by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weir.lang.lexer import QueryError
from weir.sources import readers, writers

READERS = {
    "parquet": readers.parquet, "csv": readers.csv, "tsv": readers.tsv, "json": readers.json, "line": readers.line, "zson": readers.zson, "zjson": readers.zjson, "zeek": readers.zeek, "arrows": readers.arrows, "orc": readers.orc,
    "zng": readers.arrows, "vng": readers.parquet,
}
WRITERS = {
    "parquet": writers.parquet, "csv": writers.csv, "tsv": writers.tsv, "json": writers.json, "zson": writers.zson, "zjson": writers.zjson, "zeek": writers.zeek, "arrows": writers.arrows, "text": writers.text, "table": writers.table, "null": writers.null,
    "zng": writers.arrows, "vng": writers.parquet, "lake": writers.table,
}
_BY_NAME = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".ndjson": "json", ".jsonl": "json", ".zson": "zson", ".zjson": "zjson", ".log": "zeek", ".txt": "line", ".arrows": "arrows", ".arrow": "arrows", ".orc": "orc"}


def guess(spark: SparkSession, path: str) -> str:
    """The format of a file, by its name, else by its first line."""
    for end, f in _BY_NAME.items():
        if path.removesuffix(".gz").endswith(end):
            if f != "zeek":
                return f
            break
    rows = spark.read.text(path).limit(1).collect()
    first = rows[0][0] if rows else ""
    if first.startswith("#separator") or first.startswith("#fields"):
        return "zeek"
    if first.startswith('{"type":{"kind"'):
        return "zjson"
    if first[:1] in "[{":
        import json

        try:
            json.loads(first)
            return "json"
        except ValueError:
            return "zson" if first.rstrip().endswith("}") or first.rstrip() not in "[{" else "json"
    if "\t" in first:
        return "tsv"
    return "csv" if "," in first else "line"


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    f = format or guess(spark, path)
    if f not in READERS:
        raise QueryError(f"no such format: {f}")
    return READERS[f](spark, path)


def write(df: DataFrame, path: str | None, format: str, **options) -> object:
    """Writes a result; options: mode, split (a file for each value of a column), max_records (of a file)."""
    if format not in WRITERS:
        raise QueryError(f"no such format: {format}")
    return WRITERS[format](df, path, **options)
