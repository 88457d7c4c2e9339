"""Queries that read views in several places put them together once, and leave no shuffle files of that."""

import os

import duckdb
import pytest

from linklens.checks import catalog, views
from linklens.checks.registry import Tables
from linklens.plans import retest
from linklens.session import CLEANUP, delete_stored, stored

SF = "/root/testdata/sf0.001"
NAMES = """m9_m12_rule_sync_new_tickets t8_retest_cycle_domains t8_q15_rollback_audit_tickets m14_a30_domains_closed m12_ticket_sync
m15_ticket_details m13_page_verdicts_applied""".split()
MADE = ["fx_external_domains", "fx_responses", "fx_tickets"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Tables with rows that come twice, and keys that are null."""
    folder = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    row = {"lineitem": "l_orderkey % 7 = 0", "orders": "o_orderkey % 5 = 0", "customer": "c_custkey % 3 = 0"}
    null = {"lineitem": ("l_suppkey", "l_orderkey % 11 = 0"), "orders": ("o_custkey", "o_orderkey % 13 = 0"), "customer": ("c_mktsegment", "c_custkey % 17 = 0")}
    for t in views.BASE_TABLES:
        source = f"'{SF}/{t}.parquet'"
        if t in row:
            column, where = null[t]
            source = f"(select * replace (case when {where} then null else {column} end as {column}) from (from {source} union all from {source} where {row[t]}))"
        c.execute(f"copy (select * from {source}) to '{folder}/{t}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_result_reads_no_base_of_evidence(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "l_discount" not in plan and "o_orderkey" not in plan
    c = duckdb.connect()
    for t in views.BASE_TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    res = c.execute(catalog.ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted((tuple(r) for r in out.select(*columns).collect()), key=repr) == sorted(res.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["fx_occurrences", *MADE])
def test_stored_views_have_the_rows_of_the_view(spark, odd, name):
    whole, once = views.view(spark, odd, name), getattr(Tables(spark, odd).once("fx_occurrences", *MADE), name)
    assert once.dtypes == whole.dtypes and whole.count() > 0
    assert once.exceptAll(whole).isEmpty() and whole.exceptAll(once).isEmpty()


def test_orders_meet_customers_before_lineitem(spark):
    lines = views.view(spark, SF, "fx_occurrences")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(lines) if "Join" in x and "c_custkey" in x)
    below = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    assert not any("l_orderkey" in x for x in lines[at:below])


def test_shuffle_files_go_with_the_write(spark):
    folders = [d.getAbsolutePath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, conf = files(), spark.conf.get(CLEANUP)
    rows = stored(spark.range(1000).repartition(4).selectExpr("id % 7 as k").groupBy("k").count(), "rows")
    assert files() <= before and spark.conf.get(CLEANUP) == conf
    assert rows.count() == 7
    left = {f.rsplit("/", 1)[0].removeprefix("file://") for f in rows.inputFiles()}
    delete_stored(rows)
    assert not any(os.path.exists(f) for f in left)


def test_page_results_are_stored_in_columns(spark, monkeypatch):
    names = []
    monkeypatch.setattr(retest, "stored", lambda df, name: (names.append(name), stored(df, name))[1])
    assert catalog.QUERIES["m15_ticket_details"](spark, SF).count() > 0
    assert catalog.QUERIES["t8_retest_cycle_domains"](spark, SF).count() > 0
    assert names == ["results", "verdicts"]
