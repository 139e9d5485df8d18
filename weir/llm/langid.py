"""Language identification by compression with raw-content dictionaries.

Each language has a Zstandard raw-content dictionary made of labelled texts. A
text is encoded with each dictionary, block by block, and the language with the
fewest bytes wins. Where the runner-up is about as short, the text is rejected.

Nulls and texts without a letter give ``und`` with score 0, and are rejected.
An empty table gives an empty result. Without any label all texts are ``und``.
Repeated rows are predicted alike; the prediction sees nothing but the text.
"""

from __future__ import annotations

import math
import re

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weir.llm.common import held_out, per_document

#: Bounds of the sample on which dictionaries are built: passages a language, characters a passage.
SAMPLE_PASSAGES = 240
PASSAGE_CHARS = 600
#: Bytes of one dictionary; room for the whole sample, unless its letters take many bytes.
DICT_BYTES = 160 << 10
#: Bytes encoded at once: small, so that the dictionary counts and not the text's own past.
BLOCK_BYTES = 4096
#: A text below SHORT_BYTES is few bytes in all, so it is encoded in so many orders of its words, whose bytes are added up.
ORDERS = 8
#: Compression levels: of most texts (lower ones find too few short matches to tell languages apart), and of texts
#: below SHORT_BYTES, which are few bytes in all.
LEVEL, SHORT_LEVEL, SHORT_BYTES = 6, 19, 256
#: Rejected where the runner-up needs less than this share of bytes more.
MARGIN = 0.004
UND = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower case, with anything but letters as one blank."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Labelled passages by language: at most SAMPLE_PASSAGES of each, those of least hash over all labelled documents, repeated rows once."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    # a share of all 64-bit hashes that gives each language half as many again as are kept
    upto = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, 1.5 * SAMPLE_PASSAGES / n)))))])
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(1))).cast("int") + 1
    passages = known.withColumn("h", F.xxhash64("doc_id", "text")).where(F.col("h") <= upto[F.col("lang")]).select("lang", "h", F.substring("text", at, F.lit(PASSAGE_CHARS)).alias("p"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "p"))
    out: dict[str, list[str]] = {k: [] for k in sorted(sizes, key=lambda k: (-sizes[k], k))}
    for r in passages.groupBy("lang", "h").agg(F.min("p").alias("p")).withColumn("i", first).where(F.col("i") <= SAMPLE_PASSAGES).orderBy("i", "lang").collect():
        out[r["lang"]].append(r["p"])
    return out


def dictionaries(passages: dict[str, list[str]]) -> list[tuple[str, bytes]]:
    """(language, dictionary), the language with most labels first; ties go to the first."""
    return [(k, "".join(normalise(p) for p in ps).encode()[:DICT_BYTES]) for k, ps in passages.items() if ps]


class Classifier:
    """Encodes with each dictionary; picklable, compressors are made where it runs."""

    def __init__(self, dicts: list[tuple[str, bytes]]):
        self.dicts = dicts
        self._made: dict[int, list[zstandard.ZstdCompressor]] = {}

    def __getstate__(self):
        return {"dicts": self.dicts, "_made": {}}

    def _compressors(self, level: int) -> list[zstandard.ZstdCompressor]:
        if level not in self._made:
            made = []
            for _, d in self.dicts:
                x = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                x.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(dict_data=x, write_checksum=False, write_content_size=False, write_dict_id=False, level=level))
            self._made[level] = made
        return self._made[level]

    @staticmethod
    def _blocks(data: bytes) -> tuple[list[bytes], int]:
        """What is encoded, and how often the text is in it."""
        if len(data) >= SHORT_BYTES:
            return [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)], 1
        words = data.split()
        turns = sorted({k * len(words) // ORDERS for k in range(ORDERS)})
        return [b" " + b" ".join(words[k:] + words[:k]) + b" " for k in turns], len(turns)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not self.dicts or text is None or not any(map(str.isalpha, text)):
            return UND, 0.0, True
        data = normalise(text).encode()
        coders = self._compressors(SHORT_LEVEL if len(data) < SHORT_BYTES else LEVEL)
        blocks, each = self._blocks(data)
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        total = sum(math.exp(-min(60.0, (s - sizes[best]) / each * 0.5)) for s in sizes)
        rivals = [s for i, s in enumerate(sizes) if i != best]
        narrow = bool(rivals) and min(rivals) - sizes[best] < MARGIN * sizes[best]
        return self.dicts[best][0], 1.0 / total, narrow


def identify(docs: DataFrame, trained_on: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each row of docs, learnt from trained_on (docs itself by default)."""
    model = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries(sample(trained_on if trained_on is not None else docs))))

    def run(rows: list) -> list[tuple]:
        m = model.value
        return [(i, *m.predict(t.decode("utf-8", "replace") if t is not None else None)) for i, t in rows]

    return per_document(docs, run, ["doc_id", "text"], "doc_id long, lang_pred string, score double, rejected boolean")


def op2_langid(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is rejected; other columns are untouched and no row moves.

    The decision is made where the row is, so nothing is joined back.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(Classifier(dictionaries(sample(docs))))

    def run(batches):
        m = model.value
        for b in batches:
            yield b.filter(pa.array([not m.predict(t.as_py())[2] for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
