"""HTTP(S) sources: fetched to the folder that executors share, then read as files."""

from __future__ import annotations

import os
import urllib.request

from pyspark.sql import SparkSession

from weir.sources.shared import folder


def fetch(spark: SparkSession, url: str, method: str = "GET", headers=None, body: str | None = None) -> str:
    if not url.startswith(("http://", "https://")):
        return url  # Spark reads other schemes itself
    h = {}
    if headers is not None and headers[0] == "record":
        for _, n, e in headers[1]:
            h[n] = str(e[1][0][2] if e[0] == "array" else e[2])
    name = os.path.basename(url.split("?")[0]) or "download"
    path = os.path.join(folder(spark, "get"), name)
    with urllib.request.urlopen(urllib.request.Request(url, method=method, headers=h, data=body.encode() if body else None)) as r, open(path, "wb") as f:
        while chunk := r.read(1 << 20):
            f.write(chunk)
    return path
