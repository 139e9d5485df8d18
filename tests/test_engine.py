import datetime as dt

import pytest

from weir.engine import Engine
from weir.lang.lexer import QueryError


@pytest.fixture(scope="module")
def engine(spark):
    A = spark.createDataFrame([(10, "a"), (20, "b"), (None, "n"), (40, "d")], "a long, sa string")
    B = spark.createDataFrame([(20, "x"), (20, "y"), (None, "z"), (50, "w")], "b long, sb string")
    N = spark.createDataFrame([(1, 4.0, None), (2, 0.0, True), (None, None, False), (4, -2.5, True)], "i int, d double, f boolean")
    S = spark.createDataFrame([("  tab\t ",), ("é",), ("",), (None,)], "s string")
    R = spark.createDataFrame([(1, [3, 1, 2], {"k": 1}, (5, "q")), (2, [], {}, (6, "r"))], "id long, xs array<long>, m map<string,long>, r struct<u:long,v:string>")
    X = spark.createDataFrame([], "a long, s string")
    return Engine(spark, {"A": A, "B": B, "N": N, "S": S, "R": R, "X": X})


def rows(engine, text):
    return [tuple(r) for r in engine.query(text).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("from A | inner join (from B) on a=b sb | sort a, sb", [(20, "b", "x"), (20, "b", "y"), (None, "n", "z")]),
        ("from A | left join (from B) on a=b sb | sort sa, sb", [(10, "a", None), (20, "b", "x"), (20, "b", "y"), (40, "d", None), (None, "n", "z")]),
        ("from A | right join (from B) on a=b sa | sort sb", [(50, "w", None), (20, "x", "b"), (20, "y", "b"), (None, "z", "n")]),
        ("from A | anti join (from B) on a=b | sort a", [(10, "a"), (40, "d")]),
        ("from A | join (from B) on a=b sa:=sb | sort sa_2", [(20, "b", "x"), (20, "b", "y"), (None, "n", "z")]),
        ("from N | n:=count(), c:=count(i), s:=sum(i), m:=max(d), x:=min(f)", [(4, 4, 7, 4.0, None)]),
        ("from N | sum(i) where d>0, k:=count() where i==null", [(1, 1)]),
        ("from N | and(f), or(f)", [(False, True)]),
        ("from N | sort i | collect(i)", [([1, 2, 4],)]),
        ("from N | where d>100 | collect(i)", [(None,)]),
        ("from N | sort -r i | cut i", [(4,), (2,), (1,), (None,)]),
        ("from N | sort -nulls first i | cut i", [(None,), (1,), (2,), (4,)]),
        ("from N | top 2 d | cut d", [(4.0,), (0.0,)]),
        ("from N | sort i | tail 2 | cut i", [(4,), (None,)]),
        ("from N | yield 10/i | sort this", [(2,), (5,), (10,), (None,)]),
        ("from N | where is_error(1/d) | cut i", [(2,)]),
        ("from N | i==null | cut f", [(False,)]),
        ("from N | i!=1 | sort i | cut i", [(2,), (4,), (None,)]),
        ("from S | yield trim(s) | sort this", [("",), ("tab",), ("é",), (None,)]),
        ("from S | yield {l:len(s),r:rune_len(s)} | sort l, r", [(0, 0), (0, 0), (2, 1), (7, 7)]),
        ("from R | over xs | sort this", [(1,), (2,), (3,)]),
        ("from R | over xs with id => (sort this | head 1 | yield {id,x:this})", [(1, 1)]),
        ("from R | over xs with id => (count() | yield {id,n:this})", [(1, 3)]),
        ("from R | sort id | yield (over xs | sum(this))", [(6,), (None,)]),
        ("from R | sort id | yield xs[0:2]", [([3, 1],), ([],)]),
        ("from R | sort id | yield {a:xs[-1], b:m[\"k\"], c:r.u}", [(2, 1, 5), (None, None, 6)]),
        ("from R | explode this by string as v | sort v", [("k",), ("q",), ("r",)]),
        ("from R | cut r.v | sort r", [(("q",),), (("r",),)]),
        ("from R | drop r.u, xs, m | rename r.w:=r.v | yield r.w | sort this", [("q",), ("r",)]),
        ("from A | fork (=> where a==10 => where a==20 | put z:=1) | sort a", [(10, "a", None), (20, "b", 1)]),
        ("from A | switch (case a==10 => yield {k:1} default => yield {k:0} case a==20 => yield {k:2}) | sort k", [(0,), (0,), (1,), (2,)]),
        ("from A | uniq | count()", [(4,)]),
        ("from ( pool A => cut a pool B => cut a:=b ) | sort a | uniq -c | yield {a:value.a,n:count}", [(10, 1), (20, 3), (40, 1), (50, 1), (None, 2)]),
        ("from X | count()", [(0,)]),
        ("from X | s:=sum(a) by s", []),
        ("from X | sort a | head 2", []),
        ("from A | head 1 | yield has(a), has(nope), missing(nope), is_error(nope)", [(True,), (False,), (True,), (True,)]),
        ("from A | head 1 | cut q:=quiet(nope), a", [(10,)]),
        ("from A | head 1 | yield [1,2,...[3]], [4]", [([1, 2, 3],), ([4],)]),
        ("from A | head 1 | yield 9223372036854775807+1", [(None,)]),
        ("from A | head 1 | yield {b:bucket(2020-01-01T10:20:30Z,1h)}", [(dt.datetime(2020, 1, 1, 10),)]),
        ("from A | head 1 | yield -7/2, -7%3", [(-3,), (-1,)]),
        ("from A | sa > 'a' and sa < 'd' | cut sa", [("b",)]),
        ("from A | search 20 or d | sort a | cut a", [(20,), (40,)]),
        ("from A | sort a | yield {n:count(),s:sum(a)} | sort n", [(1, 10), (2, 30), (3, 70), (4, 70)]),
    ],
)
def test_queries(engine, text, want):
    assert rows(engine, text) == want


def test_plans_push_down(spark, engine, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t.parquet"))
    e = Engine.over(spark, str(tmp_path))
    plan = e.query("from t | where id>50 | cut k")._jdf.queryExecution().toString()
    assert "GreaterThan(id,50)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan
    # a sort that nothing reads isn't done
    assert "Sort" not in e.query("from t | sort id | count() by k")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in e.query("from t | top 3 id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", ["k", "-r k, id", "-nulls first k, id", "d, id", "t, id"])
def test_spread_running_aggregates(spark, monkeypatch, order):
    from weir.operators import running

    df = spark.range(500).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 37) % 101 END AS k", "(id * 7 % 13) / 3.0D AS d", "timestamp_seconds(id * 97 % 5000) AS t")
    e = Engine(spark, {"t": df})
    text = f"from t | sort {order}, id | yield {{id,n:count(),s:sum(k),lo:min(d),hi:max(k),a:and(k>0),w:count() where k>50}}"
    want = sorted(map(tuple, e.query(text).collect()))
    monkeypatch.setattr(running, "SMALL", 0)
    monkeypatch.setattr(running, "RANGES", 7)
    assert sorted(map(tuple, e.query(text).collect())) == want


def test_named_outputs_and_debug(engine):
    got = engine.outputs("from A | debug sa | where a>10 | output big | count()")
    assert got["big"].count() == 2 and got["debug"].count() == 4 and got["main"].first()[0] == 2


def test_fluent(engine):
    p = engine.pipe("A").where("a>=20").put("b:=a*2").sort("-r a").cut("b")
    assert [r[0] for r in p.df().collect()] == [80, 40]
    assert p.type == "{b:int64}"


def test_strict_assert(spark, engine):
    e = Engine(spark, engine.tables, strict=True)
    with pytest.raises(Exception, match="assertion failed"):
        e.query("from A | assert a<20").collect()


def test_python_function(engine):
    engine.function("plus_one", lambda s: s + 1, "long")
    assert rows(engine, "from A | where a==10 | yield plus_one(a)") == [(11,)]


@pytest.mark.parametrize("text", ["from nope", "from A | cut nofunc(a)", "from A | head x", "from A | rename z.a:=a", "func f(x): (f(x)) from A | yield f(a)"])
def test_query_errors(engine, text):
    with pytest.raises(QueryError):
        engine.query(text)


def test_sums_that_overflow_are_null(spark):
    big = spark.createDataFrame([(1, 2**62, [2**62, 2**62])] * 3 + [(2, 1, [1])], "k long, v long, a array<long>")
    e = Engine(spark, {"t": big})
    assert {r.k: r.s for r in e.query("from t | s:=sum(v) by k").collect()} == {1: None, 2: 1}
    assert {r.s for r in e.query("from t | yield {s:(over a | sum(this))}").collect()} == {None, 1}
    assert e.query("from t | sort k | put s:=sum(v) | tail 1 | cut s").first()[0] is None


def test_functions_belong_to_one_engine(spark):
    a, b = Engine(spark, {"t": spark.range(2)}), Engine(spark, {"t": spark.range(2)})
    a.function("lower", lambda s: s + 100, "long")
    assert sorted(r.x for r in a.query("from t | yield {x:lower(id)}").collect()) == [100, 101]
    assert b.query('from t | yield {x:lower("A")}').first().x == "a"


def test_joins_of_keys_that_are_never_equal(spark):
    e = Engine(spark, {"a": spark.range(2), "b": spark.createDataFrame([("0", 1)], "s string, v long")})
    assert [tuple(r) for r in e.query("from a | left join (from b) on id=s v | sort id").collect()] == [(0, None), (1, None)]
    assert e.query("from a | join (from b) on id=s v").count() == 0
    assert e.query("from a | anti join (from b) on id=s").count() == 2
    assert e.query("from a | left join (from b) on id=nothing v").columns == ["id", "v"]


def test_collect_in_order(spark):
    rows = [(1, None, "n"), (1, 2, "b"), (1, 1, "a"), (2, 5, "z"), (1, 3, "c")]
    e = Engine(spark, {"t": spark.createDataFrame(rows, "k long, o long, v string").repartition(3)})
    assert {r.k: r.c for r in e.query("from t | sort o | c:=collect(v) by k").collect()} == {1: ["a", "b", "c", "n"], 2: ["z"]}
    assert {r.k: r.c for r in e.query("from t | sort -r o | c:=collect(v) by k").collect()} == {1: ["c", "b", "a", "n"], 2: ["z"]}


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [") + plan.count("LogicalRDD [") + plan.count("Range (")


def test_legs_that_project_are_one_scan(spark):
    e = Engine(spark, {"t": spark.range(12).selectExpr("id", "id % 3 AS m", "CAST(id AS STRING) AS s")})
    q = e.query('from t | switch ( case m==0 => where id>3 | yield {k:"a",v:id} case m==1 => cut id,w:=id*2 default => put k:="c" )')
    assert scans(q) == 1
    got = sorted((r.asDict() for r in q.collect()), key=str)
    want = []
    for i in range(12):
        base = dict.fromkeys(("k", "v", "id", "w", "m", "s"))
        if i % 3 == 0 and i > 3:
            want.append(base | {"k": "a", "v": i})
        elif i % 3 == 1:
            want.append(base | {"id": i, "w": 2 * i})
        elif i % 3 == 2:
            want.append(base | {"id": i, "m": 2, "s": str(i), "k": "c"})
    assert got == sorted(({c: w[c] for c in q.columns} for w in want), key=str)
    f = e.query("from t | fork ( => where id<5 => where id>=10 | cut id,x:=m+1 => pass )")
    assert scans(f) == 1 and f.count() == 5 + 2 + 12 and f.where("x IS NOT NULL").count() == 2
    # legs that do more keep plans of their own, and joins take legs one by one
    assert e.query("from t | fork ( => count() => where id<5 | count() )").count() == 2
    assert e.query("from t | fork ( => cut id,m => cut id,s ) | join on id=id s").count() == 12
    assert e.query("from t | switch m ( case 0 => yield {v:1} case 1 => yield {v:2} )").count() == 8
    assert sorted(r.n for r in e.query("from t | sort id | switch ( case m==0 => yield {n:count()} default => yield {n:0} )").collect()) == [0] * 8 + [1, 2, 3, 4]


@pytest.mark.parametrize("small", [0, 1 << 40])
@pytest.mark.parametrize("order", ["o", "-r o", "-nulls first o"])
def test_uniq_by_ranges(spark, monkeypatch, tmp_path, small, order):
    """Neighbours are compared across ranges too, whatever the direction and where nulls are."""
    import random

    from weir.operators import running

    r = random.Random(3)
    rows = [(None if i % 41 == 0 else i, r.choice(["a", "a", "b", None]), r.choice([1, 1, None])) for i in range(700)]
    rows = [x for k, x in enumerate(rows) if x[0] is not None or k == 0]
    spark.createDataFrame(rows, "o long, s string, n long").repartition(5).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(running, "SMALL", small)
    monkeypatch.setattr(running, "RANGES", 16)
    e = Engine(spark, {"t": spark.read.parquet(str(tmp_path / "t"))})
    got = [(x.s, x.n) for x in e.query(f"from t | sort {order} | cut s,n | uniq").collect()]
    back = order == "-r o"
    key = (lambda x: (x[0] is None, -(x[0] or 0))) if back else (lambda x: (x[0] is not None, x[0] or 0)) if "first" in order else (lambda x: (x[0] is None, x[0] or 0))
    want = []
    for _, s, n in sorted(rows, key=key):
        if not want or want[-1] != (s, n):
            want.append((s, n))
    assert got == want


def test_running_avg_by_ranges(spark, monkeypatch, tmp_path):
    from weir.operators import running

    spark.range(500).selectExpr("id", "IF(id % 7 = 0, NULL, id * id % 101) AS v").repartition(4).write.parquet(str(tmp_path / "t"))
    e = Engine(spark, {"t": spark.read.parquet(str(tmp_path / "t"))})
    whole = [tuple(r) for r in e.query("from t | sort id | put a:=avg(v) | cut id,a").collect()]
    monkeypatch.setattr(running, "SMALL", 0)
    monkeypatch.setattr(running, "RANGES", 8)
    e = Engine(spark, {"t": spark.read.parquet(str(tmp_path / "t"))})
    got = [tuple(r) for r in e.query("from t | sort id | put a:=avg(v) | cut id,a").collect()]
    assert [i for i, _ in got] == [i for i, _ in whole] and all(a == b or abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, whole))


@pytest.mark.parametrize("order", ["s asc, d desc, id", "-r s, id", "-nulls first s, t, id", "ip, id", "b, t, id", "s"])
def test_ranges_of_the_whole_order(spark, monkeypatch, order):
    """A leading key of few values or of text is cut at the keys after it, and ties at a hash; no range has much more than its share."""
    from weir.operators import running

    df = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 0 THEN 'é' ELSE 'a' END AS s", "IF(id % 17 = 0, NULL, (id * 7 % 613) / 3.0D) AS d", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, id * 97 % 5000) AS t",
        "id % 2 = 0 AS b", "concat('10.', id % 3, '.', id % 200, '.', id * 7 % 250) AS a",
    )
    e = Engine(spark, {"t": df})
    text = f"from t | put ip:=<ip>(a) | sort {order} | yield {{id,n:count(),k:sum(id)}}"
    want = sorted(map(tuple, e.query(text).collect()))
    monkeypatch.setattr(running, "SMALL", 0)
    monkeypatch.setattr(running, "RANGES", 16)
    seen = []
    ranges = running.ranges
    monkeypatch.setattr(running, "ranges", lambda r, *tie: seen.append((r, ranges(r, *tie))) or seen[-1][1])
    got = sorted(map(tuple, e.query(text).collect()))
    if order == "s":  # any order of ties is right, and both aggregates have the same
        assert sorted(n for _, n, _ in got) == list(range(1, 3001))
        total = 0
        for i, _, k in sorted(got, key=lambda x: x[1]):
            total += i
            assert k == total
    else:
        assert got == want
    r, (at, _) = seen[0]
    sizes = [x["count"] for x in r.df.groupBy(at.alias("p")).count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 3000 / 16 * 3


def test_small_tables_are_told_by_what_is_read(spark, tmp_path, monkeypatch):
    """A table isn't small because few of its columns are read."""
    from weir.operators import rel as R
    from weir.operators import running

    spark.range(60_000).selectExpr("id", *[f"xxhash64(id, {k}) AS c{k}" for k in range(8)]).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(running, "SMALL", 2 << 20)
    r = R.of(spark.read.parquet(str(tmp_path / "t")).select("id"))
    r.order = [("id", False, False)]
    assert running.in_ranges(r)
    r.df = r.df.limit(10)
    assert not running.in_ranges(r)
