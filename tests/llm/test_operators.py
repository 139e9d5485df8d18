"""Each operator on a small table of awkward rows, and against brute force or known answers."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from tests.llm.held import pii_cases
from weir.llm import chat, decontam, langid, mpegts, pieces, pii, quality, secrets, suffix, trees

LONG = "lorem ipsum dolor sit amet " * 4000
AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (4, "é"), (5, LONG), (6, "same text here"), (6, "same text here"), (None, "no id"), (8, "9" * 300), (9, "\U0001f600 ok"), (10, "a@b.c " * 50)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _c string, _hits string, pieces string, _d string, _n string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "src0", None if t is None else len(t), "c", "h", "p", "d", "n") for k, (i, t) in enumerate(AWKWARD)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, ""), (1, "alpha beta gamma delta")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


OPS = {
    "op2": lambda s, d: langid.op2_langid(d), "op3": lambda s, d: pii.op3_pii(d), "op4": lambda s, d: mpegts.op4_mpegts(d), "op5": lambda s, d: secrets.op5_secrets(d), "op6": lambda s, d: quality.op6_quality(d, labels(s)),
    "op7": lambda s, d: pieces.op7_pieces(d), "op9": lambda s, d: decontam.op9_decontam(d, bench(s)), "op10": lambda s, d: suffix.op10_suffix(d),
}
STAGES = {
    "identified": lambda s, d: langid.keep_identified(d), "decontaminate": lambda s, d: decontam.decontaminate(d, bench(s)), "mask": lambda s, d: secrets.mask(d), "pieces": lambda s, d: pieces.with_pieces(d), "redact": lambda s, d: pii.redact(d),
}


@pytest.mark.parametrize("name", OPS)
def test_awkward_rows(spark, awkward, nothing, name):
    got = OPS[name](spark, awkward).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in AWKWARD)
    same = [r for r in got if r.doc_id == 6]
    assert same[0] == same[1]
    assert OPS[name](spark, nothing).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, awkward, nothing, name):
    out = STAGES[name](spark, awkward)
    assert set(out.columns) == set(awkward.columns)
    for r in out.collect():
        assert r._c == "c" and r._hits == "h" and r._d == "d" and r._n == "n"
    assert STAGES[name](spark, nothing).count() == 0


# language


def test_language_accuracy(spark):
    r = random.Random(0)
    syl = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "oix", "tre"]}
    rows = []
    for i in range(600):
        lang = r.choice(list(syl))
        rows.append((i, " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 4))) for _ in range(30)), lang if i % 5 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.op2_langid(df).collect()}
    truth = {i: next(k for k in syl if any(s in t for s in syl[k])) for i, t, _ in rows}
    assert sum(got[i].lang_pred == truth[i] for i in truth) > 0.99 * len(truth)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in truth)


def test_language_query_against_plain_compression(spark):
    """Every size again with a compressor made for each block, from a dictionary file's bytes."""
    import zstandard

    r = random.Random(4)
    syl = {"aa": ["ka", "lo", "mi", "é"], "bb": ["sch", "ung", "ver"], "cc": ["eau", "oix", "tre"]}
    say = lambda lang, n: " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, say(lang, r.choice([1, 2, 5, 20, 60, 900])) + r.choice(["", ". ", "9!"]), lang if i % 4 else None) for i, lang in enumerate(r.choice(list(syl)) for _ in range(150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    dicts = langid.dictionaries(langid.sample(df))
    assert {k for k, _ in dicts} == set(syl)
    for x in langid.op2_langid(df).collect():
        data = re.sub(r"[\W\d_]+", " ", rows[x.doc_id][1].lower()).strip()
        if len(f" {data} ".encode()) < 256:
            w = data.split()
            level, blocks = 19, [" " + " ".join(w[k:] + w[:k]) + " " for k in sorted({k * len(w) // 8 for k in range(8)})]
            blocks, times = [b.encode() for b in blocks], len(blocks)
        else:
            raw = f" {data} ".encode()
            level, blocks, times = 6, [raw[k : k + 4096] for k in range(0, len(raw), 4096)], 1

        def size(d, b):
            z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=level, write_checksum=False, write_content_size=False, write_dict_id=False)
            return len(z.compress(b))

        sizes = [sum(size(d, b) for b in blocks) for _, d in dicts]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        assert x.lang_pred == dicts[order[0]][0] and x.rejected == (sizes[order[1]] - sizes[order[0]] < langid.MARGIN * sizes[order[0]])
        assert abs(x.score - 1 / sum(np.exp(-(s - min(sizes)) / times / 2) for s in sizes)) < 1e-9


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PASSAGES", 20)
    rows = [(i, f"text number {i}", "aa" if i % 10 else "bb") for i in range(2000)] + [(5, "copy", "aa")] * 3000
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: len(v) for k, v in got.items()} == {"aa": 20, "bb": 20} and got["aa"].count("copy") <= 1


def test_no_letters_are_und(spark):
    df = spark.createDataFrame([(0, "abc def ghi", "xx"), (1, "123 !!", None), (2, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.op2_langid(df).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].rejected


# personal data


def luhn(d):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(t):
    out = []
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, p in rules.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (k == "card" and not (16 <= len(d) <= 19 and luhn(d))) or (k == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_personal_data_against_patterns(spark):
    r = random.Random(4)
    bits = ["a@b.c", "@", ".", "-", "x", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "é", " ", "\n", "0", "%", "999.1.2.3.4.5", "😀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.op3_pii(df).collect():
        want = base_spans(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[x.doc_id]
        assert set(want) <= set(x.spans.split(",") if x.spans else [])


def test_personal_data_beyond_patterns(spark):
    texts = ["write to jo.doe [at] host [dot] com now", "tel (555) 123-4567 ok", "order 555-123-4567", "then 9870157079875996 no", "two 4465758382889437 4465758382889437 cards"]
    got = [r.spans for r in pii.op3_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == "email:9:35" and got[1] == "phone:4:18" and got[2] == "" and got[3] == "" and got[4] == "card:4:20,card:21:37"


def test_personal_data_in_formats_not_trained_on(spark):
    rows = pii_cases()
    whole = alarms = 0
    missed = []
    for x in pii.op3_pii(spark.createDataFrame([(i, c[1]) for i, c in enumerate(rows)], "doc_id long, text string")).collect():
        name, text, kind, value = rows[x.doc_id]
        spans = [s.split(":") for s in x.spans.split(",") if s]
        at = text.find(value)
        ok = kind is not None and any(k == kind and int(a) <= at and at + len(value) <= int(b) for k, a, b in spans)
        whole += ok
        alarms += kind is None and bool(spans)
        missed += [name] * (kind is not None and not ok or kind is None and bool(spans))
    n = sum(k is not None for _, _, k, _ in rows)
    assert whole / n >= 0.9 and whole / (whole + alarms) >= 0.9, (whole / n, alarms, missed)


def test_long_runs_are_taken_whole(spark):
    texts = [f"write to {'a' * 3000} [at] {'b' * 200}.{'c.' * 20}org now", "9" * 100_000, "1." * 50_000, "a@" * 50_000, "(555) " * 20_000, f"call (555) 123-4567{' ' * 3000}end", ":" * 50_000 + "1.2.3.4"]
    got = {r.doc_id: r.spans for r in pii.op3_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts) and got[0] == f"email:9:{len(texts[0]) - 4}" and got[5] == "phone:5:19"


def test_boosting_and_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    bias, grown = trees.boost(x, y)
    assert (((bias + sum(trees.predict(t, x) for t in grown)) > 0) == y).mean() > 0.98
    assert (((sum(trees.predict(t, x) for t in trees.forest(x, y)) / 16) > 0.5) == y).mean() > 0.95


# media


@pytest.mark.parametrize("n", [0, 1, 183, 184, 191, 192, 193, 11520, 11521, 100_000])
def test_transport_stream_round_trip(n):
    payload = mpegts.pad(random.Random(n).randbytes(n))
    d = mpegts.demux(mpegts.mux(payload))
    assert d.payload == payload and d.continuity_errors == d.table_errors == d.damaged_units == 0
    assert [u[0] for u in d.units] == [k * mpegts.ACCESS_TICKS for k in range(len(d.units))]
    assert [u[1] for u in d.units] == [k % mpegts.RAP_EVERY == 0 for k in range(len(d.units))]


def test_transport_stream_damage():
    s = mpegts.mux(mpegts.pad(b"x" * 40_000))
    assert len(s) % 188 == 0 and s[::188] == b"G" * (len(s) // 188)
    lost = s[: 188 * 20] + s[188 * 21 :]
    d = mpegts.demux(lost)
    assert d.continuity_errors == 1 and d.damaged_units == 1
    bad = bytearray(s)
    bad[10] ^= 1
    assert mpegts.demux(bytes(bad)).table_errors >= 1
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7


def packet(pid, body, counter=0, starts=True):
    return struct.pack(">BHB", 0x47, (0x4000 if starts else 0) | pid, 0x10 | counter) + body.ljust(184, b"\xff")


def section(kind, data):
    s = struct.pack(">BH", kind, 0xB000 | (len(data) + 4)) + data
    return s + struct.pack(">I", mpegts.crc32_mpeg(s))


def test_section_over_packets_and_other_streams():
    """A map table of 60 streams goes over two packets; the stream is video with decoding stamps."""
    pat = packet(0, b"\0" + section(0, struct.pack(">HBBBHH", 1, 0xC1, 0, 0, 1, 0xE000 | 0x100)))
    streams = b"".join(struct.pack(">BHH", 0x1B, 0xE000 | (0x200 + k), 0xF000) for k in range(60))
    pmt = b"\0" + section(2, struct.pack(">HBBBHH", 1, 0xC1, 0, 0, 0xE200, 0xF000) + streams)
    stamps = b"\x31" + mpegts._pts(9000)[1:] + b"\x11" + mpegts._pts(6000)[1:]
    pes = b"\0\0\1\xe0" + struct.pack(">H", 3 + 10 + 5) + b"\x80\xc0\x0a" + stamps + b"video"
    fill = 184 - len(pes) - 2
    es = struct.pack(">BHBB", 0x47, 0x4000 | 0x200, 0x30, fill + 1) + b"\0" + b"\xff" * fill + pes
    d = mpegts.demux(pat + packet(0x100, pmt[:184], 0) + packet(0x100, pmt[184:], 1, False) + es)
    assert len(d.streams) == 60 and d.streams[0x23B] == 0x1B and d.table_errors == 0
    assert d.payload == b"video" and d.units == [(9000, False, 5, 6000)] and d.damaged_units == 0


def test_odd_table_is_no_crash():
    d = mpegts.demux(packet(0, b"\0" + section(0, struct.pack(">HBBBHH", 1, 0xC1, 0, 0, 1, 0xE100) + b"xx")))
    assert d.programs == {1: 0x100} and d.table_errors == 1
    d = mpegts.demux(packet(0, b"\0" + section(0, b"")))
    assert d.table_errors == 1 and not d.programs


def test_no_bytes_crash_the_reader():
    r = random.Random(12)
    good = mpegts.mux(mpegts.pad(b"y" * 30_000))
    for k in range(300):
        b = bytearray(good)
        for _ in range(r.randint(1, 60)):
            b[r.randrange(len(b))] = r.randrange(256)
        if k % 3 == 0:
            del b[r.randrange(len(b)) :]
        if k % 5 == 0:  # a table with a right checksum and any content
            b[188:188] = packet(r.choice([0, 0x1000]), b"\0" + section(r.choice([0, 2]), r.randbytes(r.randint(0, 150))))
        mpegts.demux(bytes(b))
        mpegts.demux(r.randbytes(r.randint(0, 2000)))
    assert mpegts.demux(b"").payload == b""


def test_media_query_against_plain_digests(spark):
    r = random.Random(13)
    texts = [None, "", " ", "é" * 96, "a" * 191, "a" * 192, "a" * 193, "z" * 50_000] + ["".join(r.choice("ab é\n😀") for _ in range(r.randint(0, 900))) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[7]])], "doc_id long, text string, media string")
    stored = {x.doc_id: bytes(x.media) for x in mpegts.store(docs).collect()}
    got = {x.doc_id: x for x in mpegts.op4_mpegts(docs).collect()}
    for i, t in enumerate([*texts, texts[7]]):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        x, media = got[i], stored[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"mean={sum(padded) * 1000 // len(padded)};peak={max(padded)}" in x.feature and "errors=0;" in x.feature
    assert {**got[7].asDict(), "doc_id": 0} == {**got[len(texts)].asDict(), "doc_id": 0}


def test_timeline(spark):
    df = spark.createDataFrame([(1, "a" * 30_000)], "doc_id long, text string")
    got = mpegts.timeline(mpegts.store(df)).orderBy("pts").collect()
    assert [r.is_rap for r in got] == [True, False, False] and sum(r.n_bytes for r in got) == 30_144


# secrets


def test_secret_findings(spark):
    ex = secrets._examples()
    df = spark.createDataFrame([(i, t, p, y) for i, (t, p, y) in enumerate(ex)], "doc_id long, text string, source string, y int")
    got = secrets.findings(df).selectExpr("y", "size(_s) > 0 AS hit").collect()
    assert np.mean([bool(r.y) == r.hit for r in got]) > 0.97
    masked = secrets.mask(spark.createDataFrame([(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "s")], "doc_id long, text string, source string")).first().text
    assert masked == 'x token = "[SECRET]" y'


# quality


def test_quality_learns(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200))
    rows = [(i, good() if i % 2 else good().upper() + "!!", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = quality.op6_quality(docs, lab).collect()
    held = [x for x in got if x.held_out]
    assert held and np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.97


def slow_score(m, text):
    """A text's score by the formulas, passage by passage."""
    b, size = (text or "").encode(), quality.PASSAGE_BYTES
    n = max(1, (len(b) + size // 2 - 1) // size)
    cuts = [k * size for k in range(n)] + [len(b)]
    hs, es = [], []
    for k in range(n):
        x = np.zeros(quality.DIM)
        for at in range(cuts[k], cuts[k + 1]):
            x[b[at]] += 1
            if at:
                x[256 + (b[at - 1] * 31 + b[at] * 17) % quality.BIGRAMS] += 1
        h = np.tanh(np.sqrt(x / max(1, cuts[k + 1] - cuts[k])) @ m.p["W"] + m.p["b"])
        hs.append(h)
        es.append(float((np.tanh(h @ m.p["V"]) / (1 + np.exp(-(h @ m.p["U"])))) @ m.p["w"]))
    a = np.exp(np.array(es) - max(es))
    z = sum(w * h for w, h in zip(a / a.sum(), hs))
    return 1 / (1 + np.exp(-(z @ m.p["c"] + m.p["d"][0])))


def test_quality_query_against_formulas(spark):
    r = random.Random(3)
    texts = [None, "", "é" * 700, "a" * 255, "a" * 256, "a" * 768] + ["".join(r.choice("abc é\n") for _ in range(r.randint(0, 3000))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    m = quality.train(docs, lab)
    for x in quality.op6_quality(docs, lab).collect():
        assert abs(x.score - slow_score(m, texts[x.doc_id])) < 1e-4 and x.predicted == int(x.score >= 0.7)


def test_quality_learns_from_bounded_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a" * 2000)] * 50 + [(4, "b" * 900), (5, "c" * 900)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2, 0) for i in (1, 4, 5)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.update(n=len(bags), passages=sum(map(len, bags))) or 0.5)
    quality.train(docs, lab)
    whole = dict(seen)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    quality.train(docs, lab)
    held = sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 4, 5))
    assert whole["n"] == 3 - held and seen["n"] < whole["n"]


def test_quality_gradients():
    rng = np.random.default_rng(0)
    m = quality.Model(rng, 0.1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, starts, y = rng.random((7, quality.DIM)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        h, _, _, s = m.attend(x)
        out = 0.0
        for a, b, t in zip(starts, [3, 4, 7], y):
            e = np.exp(s[a:b] - s[a:b].max())
            p = 1 / (1 + np.exp(-((e / e.sum()) @ h[a:b] @ m.p["c"] + m.p["d"][0])))
            out -= (t * np.log(p) + (1 - t) * np.log(1 - p)) / len(y)
        return out

    g = m.gradients(x, starts, y)
    for k, i in (("W", (3, 5)), ("V", (2, 1)), ("U", (4, 3)), ("w", (2,)), ("c", (1,)), ("d", (0,)), ("b", (7,))):
        m.p[k][i] += 1e-5
        up = loss()
        m.p[k][i] -= 2e-5
        down = loss()
        m.p[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-5, k


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def all_paths(v, text):
    """(score, ids) of every way to cut a whole text into pieces, by trying each piece at each place."""
    s, longest = " " + text, max(map(len, v.pieces))
    out = []

    def ahead(at, score, ids):
        if at == len(s):
            out.append((score, ids))
        for end in range(at + 1, min(len(s), at + longest) + 1):
            x = v.pieces.get(s[at:end])
            if x is not None:
                ahead(end, score + x[1], [*ids, x[0]])
            elif end == at + 1:
                ahead(end, score + v.worst, [*ids, *(v.byte_ids[b] for b in s[at].encode())])

    if text:
        ahead(0, 0.0, [])
    else:
        out.append((0.0, []))
    return sorted(out, key=lambda x: -x[0])


TEXTS = ["the cat", "ab\nc d", "é x", "hello  wo", "a", "  ", "", "aaaaaaaaaa", "a▁b", "\x00 日本", "   \n\n  ab"]


@pytest.mark.parametrize("text", TEXTS)
def test_nbest_against_all_paths(vocabulary, text):
    want = all_paths(vocabulary, text)
    got = vocabulary.nbest(text, 6)
    assert [s for s, _ in got] == [s for s, _ in want[:6]]
    assert len({tuple(i) for _, i in got}) == len(got)
    assert all([s, i] in [list(w) for w in want] and vocabulary.decode(i) == text.encode() for s, i in got)
    # the arrays of a forward pass say what the search says
    for p in vocabulary.parts(text):
        (score, gap, ids, _), found = next(vocabulary._together([p])), vocabulary.search(p, 2)
        assert (score, np.frombuffer(ids, "<i4").tolist()) == (found[0][0], list(found[0][1]))
        assert gap == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))


def test_parts_in_one_array_and_alone(vocabulary):
    r = random.Random(9)
    parts = ["".join(r.choice("abenthe日é\U0001f600") for _ in range(r.randint(1, 64))) for _ in range(300)]
    for p, x in zip(parts, vocabulary._together(parts)):
        best = vocabulary.search(p, 1)[0]
        assert (x[0], np.frombuffer(x[2], "<i4").tolist()) == (best[0], list(best[1]))


def test_arrays_of_parts_are_bounded_by_their_cells(monkeypatch, vocabulary):
    v, r, cells = pieces.Vocabulary.load(), random.Random(6), []
    together = pieces.Vocabulary._together

    def seen(self, parts):
        w = max(map(len, parts))
        cells.append((len(parts), len(parts) * w * min(w, self.longest)))
        return together(self, parts)

    monkeypatch.setattr(pieces.Vocabulary, "_together", seen)
    parts = {"".join(r.choice("abenthe日é") for _ in range(r.randint(1, 64))) for _ in range(6000)}
    assert set(v.learn(parts)) == parts and sum(n for n, _ in cells) == len(parts)
    assert max(c for _, c in cells) <= 1 << 18


def test_pieces_query_against_all_paths(spark, vocabulary):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    for x in pieces.op7_pieces(docs).collect():
        text = ([*TEXTS, ""])[x.doc_id]
        want = all_paths(vocabulary, text)
        digests = [hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for _, i in want]
        assert x.nbest_scores == [s for s, _ in want[: pieces.NBEST]] and x.best_score == want[0][0] and x.second_score == (want[1][0] if len(want) > 1 else None)
        assert x.ids_sha256 == x.nbest_sha256[0] and len(set(x.nbest_sha256)) == len(x.nbest_scores) and set(x.nbest_sha256) <= set(digests)
        assert x.round_trip and x.n_chars == len(text) and x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_nbest_column(spark, vocabulary):
    rows = pieces.with_pieces(spark.createDataFrame([(1, "the cat sat"), (2, None)], "doc_id long, text string"), n=3).orderBy("doc_id").collect()
    assert rows[0].pieces == rows[0].nbest[0] and rows[0].nbest == [i for _, i in vocabulary.nbest("the cat sat", 3)]
    assert rows[1].pieces == [] and rows[1].nbest == [[]]


@pytest.mark.parametrize("text", ["▁", "a▁b  c\n\n d€￼ 𐍈", "\x00\x07", "\n", "x" * 5000, "日本 🙂", "ab" * 30_000])
def test_decoding_gives_the_text(vocabulary, text):
    got = vocabulary.nbest(text, 3)
    assert all(vocabulary.decode(i) == text.encode() for _, i in got) and got[0][0] >= got[-1][0]


def test_remembered_bytes_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 20_000)
    v = pieces.Vocabulary.load()
    r = random.Random(2)
    for _ in range(40):
        t = " ".join("".join(r.choice("abcdef") for _ in range(9)) for _ in range(50))
        assert vars(v)["_size"] <= 10_000 and v.decode(v.nbest(t, 1)[0][1]) == t.encode()


# chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be [kind] </s>"), (1, 1, "user", "a \\ <|turn|> b"), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 4, "assistant", "é<|end|>\\l\\\\b"), (2, 0, "assistant", "solo"), (2, 0, "assistant", "solo"), (None, 0, "user", "n"), (3, None, "user", "first"), (3, -3000, "user", "early"), (3, 0, "assistant", "w " * 5000)]
    r = random.Random(5)
    rows += [(5, None if k % 2 else 7, "assistant", "same" if k % 3 else f"t{k}") for k in range(200)]
    rows += [(4, k, r.choice(["user", "assistant"]), "".join(r.choice("ab\\<[|>l\n") for _ in range(r.randint(0, 400)))) for k in range(40)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, k int")
    got = {x.conv_id: x for x in chat.op8_chat(df).collect()}
    convs = {}
    for c, t, role, text in rows + [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        convs.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, ts in convs.items():
        ts.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        told = "".join(f"{a}\n{b}\n" for _, a, b in ts)
        loss = "".join(b for _, a, b in ts if a == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, w string, k string")
    assert chat.windows(none).count() == 0 and [x.conv_id for x in chat.op8_chat(none).collect()] == [-1]


def slow_windows(rows):
    """{(conv, window): (text, n_repeated, loss)} of rows in order, turn by turn."""
    out, n = {}, lambda t: -(-len(t.encode()) // 4) + 4
    esc = lambda t: t.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")
    for c in {x[0] for x in rows}:
        ts = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2], hashlib.md5(x[3].encode()).digest()))
        at, spans = 0, {}
        for k, (_, _, role, text) in enumerate(ts):
            spans.setdefault(at // chat.STRIDE, []).append((k, at, role, text))
            at += n(text)
        for w, own in spans.items():
            head = [x for x in spans.get(w - 1, []) if x[1] >= own[0][1] - chat.HISTORY and not (x[0] == 0 and x[2] == "system")]
            if ts[0][2] == "system" and own[0][0] > 0:
                head.insert(0, (0, 0, "system", ts[0][3]))
            text, loss = "", []
            for k, _, role, t in head + own:
                lead = f"{chat.START}{esc(role)}{chat.MIDDLE}"
                if role == "assistant" and k >= own[0][0]:
                    loss.append((len(text) + len(lead), len(text) + len(lead) + len(esc(t))))
                text += lead + esc(t) + chat.END
            out[c, w] = (text, len(head), loss)
    return out


def test_chat_windows_against_plain_loop(spark):
    r = random.Random(15)
    rows = []
    for c in range(6):
        if c % 2:
            rows.append((c, -5, "system", "be kind <s>" * r.randint(0, 20)))
        rows += [(c, r.choice([None, k, k // 3]), r.choice(["user", "assistant"]), "".join(r.choice("ab [<\\é") for _ in range(r.choice([0, 5, 300, 3000])))) for k in range(r.randint(0, 90))]
    rows += rows[-3:] * 5
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert {(x.conv_id, x.window): (x.text, x.n_repeated, [(s.start, s.end) for s in x.loss]) for x in got} == slow_windows(rows)


def test_chat_windows_hold_budget(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, k, "user" if k % 2 else "assistant", "t" * 200) for k in range(1, 60)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert len(out) > 3
    for w in out[1:]:
        assert w.text.startswith("<|turn|>system<|text|>") and w.n_repeated >= 2
        assert len(w.text) / 4 < chat.STRIDE + 2 * chat.HISTORY + 100
    for w in out:
        assert all("<|" not in w.text[s.start : s.end] for s in w.loss)


# decontamination


def slow_scan(text, items):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, names = set(), set()
    for name, t in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = min(13, len(iw))
        for i in range(len(iw) - n + 1 if iw else 0):
            for k in range(len(ws) - n + 1):
                if ws[k : k + n] == iw[i : i + n]:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("block", [10**6, 20])
def test_decontamination_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    r = random.Random(6)
    word = lambda: r.choice(["aa", "Bb", "cc", "é", "x1", "dd"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 13, 14, 30])))) for i in range(12)] + [(12, None), (13, "--")]
    texts = []
    for _ in range(60):
        w = [word() for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            own = (r.choice(items[:12])[1]).split()
            k = r.randint(0, len(w))
            w[k:k] = own[: r.randint(1, len(own))]
        texts.append(r.choice([" ", ", "]).join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for x in decontam.op9_decontam(docs, b).collect():
        n, h, names = slow_scan(texts[x.doc_id], items)
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == (n, h, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), h > 0 and 20 * h >= n)


def test_spans_are_cut(spark):
    item = " ".join(f"w{k}" for k in range(15))
    long = "x y " * 400
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, f"{long}{item.upper()}, {long}"), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {2: f"{long}, {long}", 3: "clean"}


# repeats


@pytest.mark.parametrize("held, bucket", [(10**6, 32 << 20), (200, 3000)])
def test_repeats_against_brute_force(spark, monkeypatch, held, bucket):
    monkeypatch.setattr(suffix, "HELD", held)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    r = random.Random(7)
    blob = lambda n: "".join(r.choice("abcde é") for _ in range(n))
    shared = [blob(n) for n in (60, 99, 100, 101, 150, 400)]
    texts = []
    for i in range(80):
        parts = [blob(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), blob(r.randint(0, 120))]
        texts.append("".join(parts))
    texts += [texts[0], texts[3], "z" * 350, "z" * 99, "ab" * 300, None, "", texts[1][:130]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = suffix.brute_force([(i, (t or "").encode()) for i, t in enumerate(texts)])
    assert {x[0]: tuple(x)[1:] for x in suffix.op10_suffix(df).collect()} == want


def test_long_documents_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 256)
    monkeypatch.setattr(suffix, "CHUNK_BITS", 8)
    r = random.Random(8)
    a = "".join(r.choice("abcd") for _ in range(1500))
    data = [np.frombuffer(x.encode(), np.uint8) for x in (a, a[700:] + a)]
    # windows are owned once and anchors agree between chunks
    for d in data:
        spans = [(lo, n) for _, _, los, ns in suffix.anchors(d) for lo, n in zip(los, ns)]
        assert sum(n for _, n in spans) == len(d) - suffix.LENGTH + 1
        assert all(s[0] + s[1] == t[0] for s, t in zip(spans, spans[1:]))


def test_kept_text(spark):
    t = "0123456789" * 30
    got = suffix.remove_repeats(spark.createDataFrame([(1, "a" + t), (2, t + "b")], "doc_id long, text string"), keep_text=True).orderBy("doc_id").collect()
    assert bytes(got[1].kept) == b"b"
    assert got[0].n_removed > 0  # the digits repeat within the first document
