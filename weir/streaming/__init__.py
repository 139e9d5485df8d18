"""Pipelines on unbounded input.

Stateless operators run on a streaming DataFrame as they are. Grouping by
``every`` or ``bucket`` of the event time gets a watermark and windows, so that
groups are emitted once and their state ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.engine import Engine


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """df with a watermark; a time without zone is taken to be in the session's."""
    kind = dict(df.dtypes)[ts]
    return (df.withColumn(ts, F.col(ts).cast("timestamp")) if kind == "timestamp_ntz" else df).withWatermark(ts, late)


def windowed(df: DataFrame, ts: str, size: str, aggs: dict[str, Column], by: list[str] = (), late: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Aggregates in tumbling (or sliding) windows of event time; ts is a window's start."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = timed(df, ts, late).groupBy(w, *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(F.col("window.start").alias("ts"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, aggs: dict[str, Column], by: list[str] = (), late: str = "1 minute") -> DataFrame:
    """Aggregates of sessions that end after a gap without rows."""
    g = timed(df, ts, late).groupBy(F.session_window(ts, gap), *by).agg(*[c.alias(n) for n, c in aggs.items()])
    return g.select(F.col("session_window.start").alias("ts"), F.col("session_window.end").alias("end"), *by, *aggs)


def query(engine: Engine, text: str, stream: DataFrame, ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """A pipeline over a streaming DataFrame, its event time watermarked."""
    return engine.query(text, timed(stream, ts, late) if ts in stream.columns else stream)


def top_of_each_batch(stream: DataFrame, engine: Engine, text: str, sink, checkpoint: str):
    """Runs a pipeline that needs bounded input (sort, top, joins of both sides) on every micro-batch and hands its result to sink(df, n)."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(engine.query(text, batch), n)).option("checkpointLocation", checkpoint)
