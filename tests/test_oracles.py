"""Every registered query against its SQL on the smallest data, and the shape of the plans."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from linklens.checks import catalog, views

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in views.BASE_TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoopJoin|ArrowEvalPython|BatchEvalPython|PythonUDF", plan)
    if name in ORACLES:
        res = duck.execute(ORACLES[name])
        columns = [d[0] for d in res.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, res.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_reads_pages_once(spark):
    """Once for the checkpoint of the roll-up; what follows reads that."""
    from linklens.operators import risk

    plans = []
    keep = risk.checkpointed
    risk.checkpointed = lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1]
    try:
        df = QUERIES["flagship_risky_domains_of_pages"](spark, SF)
    finally:
        risk.checkpointed = keep
    plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert [len(re.findall(r"Relation \[page_id", p)) for p in plans] == [1, 0]


def test_evidence_cap_is_limited_below_the_exchange(spark):
    df = QUERIES["w1_evidence_cap"](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
