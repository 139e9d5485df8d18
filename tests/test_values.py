import pytest
from hypothesis import given
from hypothesis import strategies as st

from weir.dynamic import run, values as V
from weir.dynamic.evaluate import Scope
from weir.lang.parser import parse

CASES = [
    ("yield x+1", '{x:1}{x:"a"}{y:2}', '2 error("incompatible types") error("missing")'),
    ("where x>1", "{x:1}{x:2}{y:3} 5", "{x:2}"),
    ("count() by typeof(this) | sort count", '1 2 "a"', "{typeof:<string>,count:1(uint64)} {typeof:<int64>,count:2(uint64)}"),
    ("sort this", '3 "b" null 1 "a" {x:1}', '1 3 "a" "b" {x:1} null'),
    ("fuse", '{a:1}{b:"x"}', '{a:1,b:null(string)} {a:null(int64),b:"x"}'),
    ("uniq -c", "1 1 2 {x:1}", "{value:1,count:2(uint64)} {value:2,count:1(uint64)} {value:{x:1},count:1(uint64)}"),
    ("over a => (sum(this))", "{a:[1,2]}{a:[3]}", "3 3"),
    ("yield (over a | sum(this))", "{a:[1,2]}{a:[3,4]}", "3 7"),
    ("cut a,q:=quiet(b)", "{a:1,b:2}{a:3}", "{a:1,q:2} {a:3}"),
    ('switch (case x==1 => yield "one" default => yield "other")', "{x:1}{x:2}", '"one" "other"'),
    ("yield 1/0", "1", 'error("divide by zero")'),
    ("yield <uint8>(300)", "1", 'error({message:"cannot cast to uint8",on:300})'),
    ("b*", '"foo" {s:"bar"} {s:"baz"} {foo:1}', '{s:"bar"} {s:"baz"}'),
    ("yield grep(ba*, s)", '{s:"bar"} {s:"q"}', "true false"),
    ("yield network_of(this)", "10.1.2.129 1", '10.0.0.0/8 error({message:"network_of: not an IP",on:1})'),
    ("yield unflatten(flatten(this))", "{a:1,b:{c:2}}", "{a:1,b:{c:2}}"),
    ("func fib(n): (n<2 ? n : fib(n-1)+fib(n-2)) yield fib(this)", "10", "55"),
    ("explode this by int64", '{a:1,b:[2,3],c:"x"}', "{value:1} {value:2} {value:3}"),
    ("sample", "1 2 \"a\" {x:1} {x:2}", '1 "a" {x:1}'),
    ("union(this)", "2 1 2", "|[1,2]|"),
]


def on_list(text, inp):
    return [V.text(v) for v in run.run_values(parse(text), V.parse_all(inp), Scope())]


@pytest.mark.parametrize("text, inp, want", CASES)
def test_on_lists(text, inp, want):
    assert " ".join(on_list(text, inp)) == want


@pytest.mark.parametrize("text, inp, want", CASES)
def test_on_spark(spark, text, inp, want):
    df = spark.createDataFrame([(V.text(v),) for v in V.parse_all(inp)], "value string").coalesce(1)
    got = [r.v for r in run.query(text, df).collect()]
    want = on_list(text, inp)
    assert got == want or ("by" in text and sorted(got) == sorted(want))


prims = st.one_of(st.none(), st.booleans(), st.integers(-(1 << 62), 1 << 62), st.floats(allow_nan=False), st.text(max_size=6), st.binary(max_size=4))


def made(x):
    return V.Val(V.L.BYTES, x) if isinstance(x, bytes) else V.of_json(x)


trees = st.recursive(prims.map(made), lambda c: st.one_of(st.lists(c, max_size=3).map(V.array), st.dictionaries(st.text("abc é", min_size=1, max_size=3), c, max_size=3).map(V.record)), max_leaves=8)


@given(trees)
def test_text_round_trip(v):
    t = V.text(v)
    assert V.text(V.parse(t)) == t


@given(st.lists(trees, max_size=6))
def test_sort_bytes_agree_with_order(vs):
    assert [V.text(v) for v in sorted(vs, key=V.key)] == [V.text(v) for v in sorted(vs, key=V.sort_bytes)]
