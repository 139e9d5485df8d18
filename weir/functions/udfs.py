"""The few functions that columns can't express, as Arrow-batched functions."""

from __future__ import annotations

import ipaddress
import secrets
import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = 1_400_000_000
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _text(b: bytes) -> str:
    n, out = int.from_bytes(b, "big"), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(27, "0")


def _bytes(s: str) -> bytes | None:
    n = 0
    for c in s:
        k = _B62.find(c)
        if k < 0:
            return None
        n = n * 62 + k
    return n.to_bytes(20, "big") if len(s) == 27 and n < 1 << 160 else None


@F.pandas_udf(T.BinaryType())
def new_ksuid(x: pd.Series) -> pd.Series:
    now = int(time.time()) - _EPOCH
    return pd.Series([now.to_bytes(4, "big") + secrets.token_bytes(16) for _ in x])


@F.pandas_udf(T.StringType())
def ksuid_text(x: pd.Series) -> pd.Series:
    return x.map(lambda b: None if b is None else _text(bytes(b)))


@F.pandas_udf(T.BinaryType())
def ksuid_bytes(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else _bytes(s))


@F.pandas_udf(T.StringType())
def v6_network(ip: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or pd.isna(b) else str(ipaddress.ip_network(f"{a}/{int(b)}", strict=False)) for a, b in zip(ip, bits)])
