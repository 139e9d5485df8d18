import hashlib
import struct

import corpus_pipeline
from weir.llm import decontam, langid, pieces, secrets, simhash


def make(spark, tmp_path):
    words = {"en": "the of and thing after rendered onto shore hand", "fr": "eau que les aux dans entre oiseau lettre"}
    rows = []
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        w = words[lang].split()
        rows.append((i, " ".join(w[(i * k + k * k) % len(w)] + w[(k + i) % len(w)][:3] for k in range(1, 40)), lang, f"src{i % 3}"))
    item = " ".join(f"bench{k}" for k in range(20))
    rows += [(60, rows[1][1], "en", "s"), (61, rows[2][1], "en", "s"), (62, f"{rows[4][1]} {item}", "en", "s"), (63, "12345 !!", "en", "s"), (64, None, None, None), (65, f'{" ".join(reversed(rows[7][1].split()))} extra token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "en", "s")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), df


def test_stages_and_run(spark, tmp_path):
    d, docs = make(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "secret_scan", "encode"]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    # what the stages say one by one is what the pipeline does
    known = {r.doc_id for r in langid.op2_langid(docs).collect() if not r.rejected}
    first = {r.doc_id for r in simhash.op1_simhash(docs.where(docs.doc_id.isin(*known))).collect() if r.doc_id == r.component_id}
    clean = {r.doc_id for r in decontam.op9_decontam(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect() if not r.contaminated}
    assert set(out) == first & clean and {60, 61, 62, 63, 64} & set(out) == set()
    assert secrets.MASK in out[65].text and "24be" not in out[65].text and out[65].n_chars == len(out[65].text)
    v = pieces.Vocabulary.load()
    assert all(v.decode(r.pieces).decode() == r.text for r in out.values())


def test_stage_columns(spark, tmp_path):
    d, docs = make(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_last_stage_gives_the_segmentations_of_op7(spark, tmp_path):
    d, docs = make(spark, tmp_path)
    some = docs.where("doc_id IN (0, 1, 63, 64)")
    want = {r.doc_id: r for r in pieces.op7_pieces(some).collect()}
    out = corpus_pipeline.STAGES[-1][1](spark, some, d).collect()
    assert len(out) == 4
    for r in out:
        assert [hashlib.sha256(struct.pack(f"<{len(x)}i", *x)).hexdigest() for x in r.nbest] == want[r.doc_id].nbest_sha256
        assert r.pieces == r.nbest[0] and len(r.nbest) == (pieces.NBEST if r.text else 1)
