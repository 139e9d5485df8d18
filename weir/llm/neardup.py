"""Near-duplicate removal: one document of each group of near copies stays.

Near copies are texts whose sets of 5-word shingles have a Jaccard similarity
of 0.8 or more. An edit of that size moves a SimHash by some ten of its 64
bits, and no pigeonhole is selective at ten, so fingerprints alone can't find
them all. They do what they are good at, and the rest is exact:

1. Texts of one set are grouped by a digest of the set.
2. Fingerprints of the sets (operator 1 with five words) are linked within its
   two bits by generalised pigeonhole; then, for ROUNDS least hashes, documents
   with one least hash are linked with the one of them whose MINIMA least
   hashes are the most common: of many edits of one text, that is the text.
   These are stars, not pairs: at most a link for each document and round, only
   of documents that have none yet, all verified on whole sets.
   Links whose least hashes say that they would fail aren't tried.
3. ``jaccard`` finds all links that are left between different components.

A link is only made between verified near copies, and step 3 misses none between
components, so the groups are those of all links, whatever steps 1 and 2 found.

Nulls and texts without words are copies of each other. Rows that repeat a
doc_id stay or go together; rows without a doc_id stay. An empty table gives an
empty result; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import jaccard, simhash
from weir.llm.common import connected_components, cut, per_document, spread_join, with_values, without_ids

#: Least hashes of a set, the rounds of stars, and how many of them two documents of a star must share.
MINIMA, ROUNDS, SHARED = 8, 2, 5
_RNG = np.random.default_rng(5)
_ODD = np.concatenate([[1], _RNG.integers(1, 1 << 62, 31) * 2 + 1]).astype(np.uint64)


def _keys(rows: list) -> list[tuple]:
    out = []
    for (i, _), s in zip(rows, jaccard.shingles_of([text for _, text in rows])):
        d = xxhash.xxh3_128_digest(s.tobytes(), 42)
        # the hashes are even already, and odd multiples order them anew
        least = [int((s * m).min().view(np.int64)) for m in _ODD[:MINIMA]] if len(s) else None
        out.append((i, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), simhash.majority(s), least))
    return out


def _known(keys: DataFrame) -> DataFrame:
    """keys with how common a document's least hashes are, all together."""
    each = keys.select("doc_id", F.explode("m").alias("h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("many", F.col("n"))
    score = spread_join(each, counts, "h").groupBy("doc_id").agg(F.sum("many").alias("score"))
    return keys.join(score, "doc_id", "left")


def _stars(keys: DataFrame, k: int) -> DataFrame:
    """(u, v): each document with the one that stands for its k-th least hash, where they are likely near copies."""
    own = keys.where("score IS NOT NULL").select("doc_id", "m", F.get("m", F.lit(k)).alias("h"), "score")
    center = F.max_by(F.struct(F.col("doc_id").alias("v"), F.col("m").alias("v_m")), F.struct("score", -F.col("doc_id")))
    centers = own.groupBy("h").agg(center.alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "n", "c.*")
    shared = F.aggregate(F.zip_with("m", "v_m", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    return spread_join(own, centers, "h").where((F.col("doc_id") != F.col("v")) & (shared >= SHARED)).select(F.col("doc_id").alias("u"), "v")


def _fingerprint_links(keys: DataFrame) -> DataFrame:
    """(u, v): documents with one fingerprint or linked ones; a fingerprint's smallest document stands for it."""
    fps = cut(keys.groupBy("fp").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")))
    same = spread_join(keys.select("doc_id", "fp"), fps.where("n > 1"), "fp").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")
    near = simhash.links(fps.select("fp"))
    first = fps.select("fp", F.col("v").alias("doc_id"))
    ends = near.join(first.select(F.col("fp").alias("u"), F.col("doc_id").alias("du")), "u").join(first.select(F.col("fp").alias("v"), F.col("doc_id").alias("dv")), "v")
    return same.union(ends.select(F.col("du").alias("u"), F.col("dv").alias("v")))


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document that is linked, through near copies, to one of smaller doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    keyed = cut(per_document(docs, _keys, ["doc_id", "text"], "doc_id long, a long, b long, fp long, m array<long>"))
    firsts = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"))
    copies = cut(keyed.join(firsts, ["a", "b", "doc_id"], "left_anti").select("doc_id").distinct())
    # a row without words has no least hash, and no copy is left of it
    keys = cut(_known(keyed.drop("a", "b").where("m IS NOT NULL").join(copies, "doc_id", "left_anti")))
    links = cut(jaccard.verified(docs, cut(_fingerprint_links(keys).distinct())))
    for k in range(ROUNDS):
        new = _stars(keys, k).join(links.select("u").distinct(), "u", "left_anti")
        links = links.union(cut(jaccard.verified(docs, cut(new))))
    links = connected_components(links).select(F.col("node").alias("u"), F.col("root").alias("v"))
    roots = links.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
    pairs = cut(jaccard.candidates(with_values(without_ids(docs, copies), roots), docs, keyed.count()))
    linked = connected_components(links.union(jaccard.verified(docs, pairs)))
    return copies.union(linked.where("node <> root").select(F.col("node").alias("doc_id")))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group, the document with the smallest doc_id stays, all its columns with it."""
    return without_ids(docs, cut(later_copies(docs.select("doc_id", "text")).distinct()))
