"""A folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from weir.lang.lexer import QueryError


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on this machine if all of Spark runs on it."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise QueryError("spark.checkpoint.dir is unset, and executors can't share a folder of one machine")
        base = tempfile.mkdtemp(prefix="weir-")
    path = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path
