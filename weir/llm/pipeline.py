"""Documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Nulls, empty texts, repeated rows and empty tables are
handled as the operators say. What goes: texts whose language isn't told (some
0.8 % of the test documents, nearly all of a few words), later near copies, and
documents with 5 % or more of benchmark words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontam, langid, neardup, pieces, secrets
from weir.llm.common import written


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell apart; rejected ones go."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near copies."""
    return neardup.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; fewer hits are cut out of the text."""
    return _counted(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return _counted(secrets.mask(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the ids of its best segmentation (pieces) and of as many best ones as op7 finds (nbest), best first."""
    return pieces.with_pieces(docs, n=pieces.NBEST)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secret_scan", secret_scan), ("encode", encode)]

#: Compression, fingerprints, forests and lattices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
