import json

import pytest

from weir import sources
from weir.engine import Engine


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(1, "a", 1.5, None, [1, 2]), (2, "", 2.0, True, [])], "i long, s string, d double, b boolean, xs array<long>")
    e = Engine(spark, {"t": df})
    return e.query('from t | put ip:=<ip>("10.0.0.1"), r:={u:i}, t:=2020-01-02T03:04:05.25Z, du:=90s')


@pytest.mark.parametrize("format", ["parquet", "zson", "zjson", "zeek", "arrows"])
def test_round_trip(spark, table, tmp_path, format):
    path = str(tmp_path / "out")
    sources.write(table, path, format)
    back = sources.read(spark, path + ("/*.arrows" if format == "arrows" else ""), format)
    key = lambda df: sorted(map(str, df.select("i", "s", "d", "b", "xs", "ip", "r", "t", "du").collect()))
    assert key(back) == key(table)


@pytest.mark.parametrize("format", ["csv", "tsv", "json", "text", "null"])
def test_other_writers(spark, table, tmp_path, format):
    path = str(tmp_path / "out")
    sources.write(table, path, format)
    if format in ("csv", "tsv"):
        back = sources.read(spark, path, format)
        assert dict(back.dtypes)["d"] == "double" and dict(back.dtypes)["b"] == "boolean" and back.count() == 2
    if format == "json":
        assert sources.read(spark, path, format).count() == 2


def test_guess_and_mixed_types(spark, tmp_path):
    f = tmp_path / "a.zson"
    f.write_text('{a:1,b:"x"}\n{a:"s",c:80(port=uint16)}\n{d:|[1,2]|}\n')
    df = sources.read(spark, str(f))
    assert df.columns == ["a", "b", "c", "d"] and df.count() == 3
    e = Engine(spark)
    assert [r.v for r in e.values("count() by typeof(a) | sort typeof", str(f)).collect()] == ["{typeof:<error(string)>,count:1(uint64)}", "{typeof:<int64>,count:1(uint64)}", "{typeof:<string>,count:1(uint64)}"]
    for name, content, want in [("x", '{"a":1}\n{"a":2}\n', "json"), ("y", "a,b\n1,2\n", "csv"), ("z", "#separator \\x09\n", "zeek"), ("w", "plain words\n", "line")]:
        p = tmp_path / name
        p.write_text(content)
        assert sources.guess(spark, str(p)) == want


def test_pretty_values(spark, tmp_path):
    f = tmp_path / "p.zson"
    f.write_text("{\n  a: 1,\n  b: [2]\n}\n{a:3}\n")
    assert [r.v for r in Engine(spark).values("yield a", str(f)).collect()] == ["1", "3"]


def test_zeek_headers_that_differ_fail(spark, tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    head = "#separator \\x09\n#fields\ta\tb\n#types\tstring\tcount\n"
    (d / "1.log").write_text(head + "x\t1\n" + head + "y\t2\n")
    assert sorted(tuple(r) for r in sources.read(spark, str(d), "zeek").collect()) == [("x", 1), ("y", 2)]
    (d / "2.log").write_text(head.replace("a\tb", "b\ta") + "3\tz\n")
    with pytest.raises(Exception, match="headers differ"):
        sources.read(spark, str(d), "zeek").collect()


def _ids_in_blocks(spark, path, rows, block):
    """Reads a file in blocks of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        back = sources.read(spark, path, "zjson")
        assert back.count() == rows
        return back.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_zjson_types_are_known_beyond_a_batch_and_a_block(spark, tmp_path):
    path = str(tmp_path / "z.zjson")
    sources.write(spark.range(25000).selectExpr("id", "array(id) AS xs", "'\"id\"' AS s").coalesce(1), path, "zjson")
    for block in (10**9, 100_000):
        got = _ids_in_blocks(spark, path, 25000, block)
        assert sorted(r.id for r in got) == list(range(25000)) and all(r.xs == [r.id] for r in got)


def test_zjson_ids_can_be_defined_anew(spark, tmp_path):
    """Files that were put together: an id means what was defined last, also in another block."""
    record = lambda f, name, i, t: {"kind": "record", "id": i, "fields": [{"name": name, "type": t}]} | f
    num, ref = {"kind": "primitive", "name": "int64"}, lambda i: {"kind": "ref", "id": i}
    lines = []
    for k, name in enumerate("abab"):
        lines.append({"type": record({}, "r", 31, record({}, name, 30, num)), "value": [[str(k)]]})
        lines += [{"type": ref(30), "value": [str(j)]} for j in range(50)] + [{"type": ref(31), "value": [[str(j)]]} for j in range(50)]
    lines.append({"type": {"kind": "array", "id": 32, "type": ref(31)}, "value": []})
    lines.append({"type": record({}, "xs", 33, ref(32)), "value": [[[["7"]]]]})
    f = tmp_path / "z.zjson"
    f.write_text("".join(json.dumps(x) + "\n" for x in lines[:-2] + lines[-1:]).replace(json.dumps(ref(32)), json.dumps(lines[-2]["type"])))
    for block in (10**9, 1000):
        got = _ids_in_blocks(spark, str(f), 405, block)
        assert sum(r.a is not None for r in got) == sum(r.b is not None for r in got) == 100
        assert sum(r.r is not None and r.r.a is not None for r in got) == sum(r.r is not None and r.r.b is not None for r in got) == 102
        assert [r.xs[0].r.b for r in got if r.xs] == [7]
