import os

import pytest

import __spark_entry__ as entry
from weir.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["pricing_summary", "where_and_or_not", "search_logic", "join_null_key", "uniq_adjacent", "over_body", "shape_order_fill", "net_fns", "collect_agg", "switch_bool"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = c.execute(catalog.QUERIES[name][1])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(str([norm(r[cols.index(k)]) for k in sorted(cols)]) for r in cur.fetchall())
    assert sorted(str([norm(r[k]) for k in sorted(cols)]) for r in df.collect()) == want
