"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at once; bounds a worker's memory, not the work.
SLICE_ROWS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all of Spark runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset, and executors can't share a folder of one machine")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="weir-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fixed test fold: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def per_document(
    df: DataFrame, fn: Callable[[list], list[dict]], columns: list[str], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """Maps rows with fn over Arrow batches, SLICE_ROWS rows at a time.

    fn gets one list of column tuples (texts as bytes) and returns one tuple per row.
    """
    binary = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    fields = [x.split(" ") for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names, types = [x[0] for x in fields], [kinds[x[1]] for x in fields]
    out = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                cols = [part.column(c).cast(pa.binary()).to_pylist() if columns[c] in binary else part.column(c).to_pylist() for c in range(len(columns))]
                rows = fn(list(zip(*cols)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


#: Bits of an id filter: so many for each id, and never more than these; a full filter only lets more rows through.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def _inside(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """A bit filter of the ids, of bounded size and broadcast (MOST_BITS / 64 rows at most), and whether a row of df is inside of it."""
    size = LEAST_BITS
    many = ids.count() * BITS_EACH
    while size < min(many, MOST_BITS):
        size *= 2
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    words = ids.select(bit(column).alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits"))
    words = F.broadcast(cut(words))
    return words, (F.floor(bit(df[column]) / 64) == words["w"]) & (F.getbit(words["bits"], (bit(df[column]) % 64).cast("int")) == 1)


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of df whose column isn't in ids (rows without one stay), moving few of the others.

    A bit filter of the ids, of bounded size, is broadcast. Rows outside of it stay where they are;
    only rows inside (those in ids, and more the fuller the filter is) are joined with the ids.
    """
    words, inside = _inside(df, ids, column)
    sure = df.join(words, inside, "left_anti")
    return sure.union(df.join(words, inside, "left_semi").join(ids, column, "left_anti").select(*df.columns))


def with_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of df whose column is in ids, and a few others: those outside of a bit filter are left out, and none is moved."""
    return df.join(*_inside(df, ids, column), "left_semi")


def with_values(df: DataFrame, values: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with the other columns of values, which has each id once; null where it has none. As in without_ids, few rows are moved."""
    words, inside = _inside(df, values, column)
    sure = df.join(words, inside, "left_anti").select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema.fields if f.name != column])
    return sure.union(df.join(words, inside, "left_semi").join(values, column, "left").select(*sure.columns))


def spread_join(df: DataFrame, table: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """df (of so many rows, at least) joined with table, which has each key once and the number n of df's rows with it.

    Keys with over 1/1000 of df's rows (so at most 1000 of them) are joined by broadcast, wherever their rows are.
    """
    least = max((df.count() if rows is None else rows) / 1000, 1)
    columns = [*df.columns, *[c for c in table.columns if c not in (key, "n")]]
    hot = table.where(F.col("n") > least).drop("n")
    keys = F.broadcast(hot.select(key))
    often = df.join(F.broadcast(hot), key).select(*columns)
    rest = df.join(keys, key, "left_anti").join(table.where(F.col("n") <= least).drop("n"), key)
    return often.union(rest.select(*columns))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v); root is the component's smallest node.

    Alternating large-star and small-star rounds; each round is cut to the
    shared folder, so lineage stays short and a lost executor costs one round.
    The edges of a hub stay where they are (``spread_join``). Only two scalars a
    round reach the driver. Null ends and loops are left out.
    """
    e = cut(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was, rows = None, e.count()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, "u", 2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, least, "u", rows)
        e = cut(small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        rows, mix = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (rows, mix) == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = (rows, mix)
