"""Queries that pass a table through a format, a pool or a stream, and the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir import streaming
from weir.engine import Engine
from weir.lake.store import Lake
from weir.sources import read, write
from weir.sources.shared import folder

Query = Callable[[SparkSession, str], DataFrame]
_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _format(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = os.path.join(folder(spark, "format"), f"customer.{name}")
        write(spark.read.parquet(f"{sf_dir}/customer.parquet"), path, name)
        back = read(spark, path, name)
        kinds = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}
        return back.select(*[F.col(c.strip()).cast(kinds.get(c.strip(), "string")).alias(c.strip()) for c in _COLUMNS.split(",")])

    return run


def _pool(then: Callable[[Lake, Engine, list[str]], DataFrame]) -> Query:
    """A pool of all orders, loaded in three commits by status, each a share of the whole table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = Lake(spark, folder(spark, "lake"))
        lake.create("orders", "o_orderkey", "asc")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        parts = [orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus NOT IN ('F', 'O')")]
        return then(lake, Engine(spark, lake=lake), [lake.load("orders", p) for p in parts]).select("o_orderkey", "o_orderstatus", "o_totalprice")

    return run


def _deleted(lake: Lake, e: Engine, commits: list[str]) -> DataFrame:
    lake.delete_where("orders", "o_totalprice > 200000")
    return e.query("from orders")


def _merged(lake: Lake, e: Engine, commits: list[str]) -> DataFrame:
    lake.branch("orders", "dev", commits[0])
    lake.load("orders", lake.read("orders").where("o_orderstatus = 'O' AND o_totalprice < 100000"), "dev")
    lake.delete_where("orders", "o_orderstatus = 'F' AND o_totalprice < 100000", "dev")
    lake.merge("orders", "dev")
    return e.query("from orders")


def _reverted(lake: Lake, e: Engine, commits: list[str]) -> DataFrame:
    lake.revert("orders", commits[1])
    return e.query("from orders")


def _compacted(lake: Lake, e: Engine, commits: list[str]) -> DataFrame:
    lake.compact("orders")
    lake.vacuum("orders")
    return e.query("from orders")


def _stream(build: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{sf_dir}/events.parquet"
        reader = spark.readStream.schema(spark.read.parquet(path).schema)
        # a stream's source is a folder, also where the table is one file in it
        source = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        at = folder(spark, "stream")

        def out(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        q = build(source).writeStream.outputMode("complete").foreachBatch(out).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        back = spark.read.parquet(f"{at}/out")
        return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    return run


_ALL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def _windowed(s: DataFrame, size: str, **options) -> DataFrame:
    return streaming.windowed(s, "ts", size, {"n": F.count(F.lit(1)), "users": F.sum("user_id")}, **options)


def _sessions(s: DataFrame) -> DataFrame:
    return streaming.sessions(s, "ts", "30 minutes", {"n": F.count(F.lit(1)), "users": F.sum("user_id")}, ["user_id"]).drop("end")


def trips() -> dict[str, tuple[Query, str]]:
    """name: (query, SQL)."""
    return {
        **{f"format_{f}": (_format(f), f"SELECT {_COLUMNS} FROM customer") for f in ("parquet", "csv", "tsv", "json", "zson", "zjson", "zeek", "arrows")},
        "lake_load_read": (_pool(lambda lake, e, c: e.query("from orders")), _ALL),
        "lake_where_key": (_pool(lambda lake, e, c: e.query('from orders | where o_orderkey>=100 and o_orderstatus!="F"')), f"{_ALL} WHERE o_orderkey >= 100 AND o_orderstatus <> 'F'"),
        "lake_delete_where": (_pool(_deleted), f"{_ALL} WHERE NOT o_totalprice > 200000"),
        "lake_merge": (_pool(_merged), f"{_ALL} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000) UNION ALL {_ALL} WHERE o_orderstatus = 'O' AND o_totalprice < 100000"),
        "lake_revert": (_pool(_reverted), f"{_ALL} WHERE o_orderstatus <> 'O'"),
        "lake_time_travel": (_pool(lambda lake, e, c: e.query(f"from orders@{c[1]}")), f"{_ALL} WHERE o_orderstatus IN ('F', 'O')"),
        "lake_compact": (_pool(_compacted), _ALL),
        "stream_tumbling": (
            _stream(lambda s: _windowed(s, "1 hour", by=["event_type"])),
            "SELECT date_trunc('hour', ts) AS ts, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1, 2",
        ),
        "stream_sliding": (
            _stream(lambda s: _windowed(s, "2 hours", slide="1 hour")),
            "SELECT h - to_hours(k) AS ts, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM (SELECT date_trunc('hour', ts) AS h, unnest([0, 1]) AS k, user_id FROM events) GROUP BY 1",
        ),
        "stream_sessions": (
            _stream(_sessions),
            "SELECT min(ts) AS ts, user_id, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM (SELECT *, count(*) FILTER (WHERE first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM "
            "(SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS first FROM events)) GROUP BY user_id, s",
        ),
    }
