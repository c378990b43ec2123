"""Registered queries against their SQL, plans that push down, and the command line."""

import importlib
import sys

import duckdb
import pytest

from strataframe import catalog
from strataframe.__main__ import main
from strataframe.operators import resolve, stats
from strataframe.plans.layered import LayeredStore

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    cur = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda rs: sorted(repr([plain(r[c]) for c in sorted(cols)]) for r in rs)
    assert key(rows) == key([dict(zip(cols, r)) for r in cur.fetchall()])


def test_only_key_filters_reach_the_scan(spark, sf):
    ev = catalog.events(spark, sf)
    plan = resolve.latest(ev.where("user_id = 3"), "user_id", "event_id").where("value > 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan and "GreaterThan(value" not in plan


def test_percentiles_by_brute_force(spark):
    values = [float(x) for x in (5, 1, 1, 1, 9, 7, 7, 100)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = stats.percentiles(df, "v", (0.0, 0.5, 0.9, 1.0), buckets=4).first()
    want = [sorted(values)[int(p * 7)] for p in (0.0, 0.5, 0.9, 1.0)]
    assert list(got) == want
    assert stats.percentiles(df.where("v is null"), "v", (0.5,)).first()[0] is None


def test_entry_without_the_optional_folder(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    for name in [m for m in sys.modules if m.startswith("strataframe.llm") or m == "corpus_pipeline"]:
        del sys.modules[name]
    saved = importlib.util.find_spec
    try:
        importlib.util.find_spec = lambda n, *a: None if n.startswith("strataframe.llm") else saved(n, *a)
        importlib.reload(e)
        assert set(e.queries()) == set(catalog.queries())
    finally:
        importlib.util.find_spec = saved
        importlib.reload(e)


def test_command_line(spark, tmp_path, capsys):
    s = LayeredStore(spark, str(tmp_path))
    assert main(["put", "a", "1"], s) == 0 and main(["get", "a"], s) == 0
    assert capsys.readouterr().out == "1\n"
    assert main(["delete", "a"], s) == 0 and main(["get", "a"], s) == 1
    assert main(["put", "", "1"], s) == 2 and main(["nonsense"], s) == 2
    assert main(["put", "b", "2"], s) == 0 and main(["compact"], s) == 0 and main(["scan"], s) == 0
    assert "b\t2" in capsys.readouterr().out
    assert main(["stats"], s) == 0


@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_range_joins_beyond_the_broadcast_bound(spark, kind):
    import random

    from strataframe.operators import integrity

    rnd = random.Random(1)
    made = {"long": int, "string": lambda x: f"{x:06d}", "binary": lambda x: x.to_bytes(4, "big")}[kind]
    ranges = [(i, i % 3, a, a + rnd.choice([0, 3, 40, 5000])) for i in range(6000) for a in [rnd.randint(0, 99_999)]]
    ranges += [(6000, 1, 0, 99_999), (6001, 2, 7, 7), (6001, 2, 7, 7), (6002, 1, None, 5), (6003, 1, 5, None)]
    tables = spark.createDataFrame([(i, n, *(None if x is None else made(min(x, 999_999)) for x in r)) for i, n, *r in ranges], f"table_id long, level int, min_key {kind}, max_key {kind}")
    keys = spark.createDataFrame([(None,), *((made(rnd.randint(0, 199_999)),) for _ in range(300))], f"key {kind}")
    deeper = tables.where("table_id < 300 or table_id > 6000")
    plan = integrity.overlap_pairs(tables, most=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    for f in (lambda most: integrity.overlap_pairs(tables.where("table_id < 2000 or table_id > 5999"), most=most), lambda most: integrity.droppable(keys, deeper, most=most), lambda most: integrity.candidate_table(keys, deeper, most=most)):
        few, many = f(10**6), f(10)
        assert few.columns == many.columns and few.count() > 0
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
