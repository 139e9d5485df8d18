"""Queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.llm import chat, decontam, langid, mpegts, pieces, pii, pipeline, quality, secrets, simhash, suffix

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": lambda s, d: simhash.op1_simhash(table(s, d, "documents")),
        "op2_langid": lambda s, d: langid.op2_langid(table(s, d, "documents")),
        "op3_pii": lambda s, d: pii.op3_pii(table(s, d, "documents")),
        "op4_mpegts": lambda s, d: mpegts.op4_mpegts(table(s, d, "documents")),
        "op5_secrets": lambda s, d: secrets.op5_secrets(table(s, d, "documents")),
        "op6_quality": lambda s, d: quality.op6_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op7_pieces": lambda s, d: pieces.op7_pieces(table(s, d, "documents")),
        "op8_chat": lambda s, d: chat.op8_chat(table(s, d, "conversations")),
        "op9_decontam": lambda s, d: decontam.op9_decontam(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_suffix": lambda s, d: suffix.op10_suffix(table(s, d, "documents")),
        "pipeline": pipeline.run,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP9_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_OP9_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 11))) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.i, dw.n, item_id FROM dw JOIN win ON win.n = dw.n AND array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ') = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_chat": chat.OP8_SQL, "op9_decontam": OP9_SQL}
