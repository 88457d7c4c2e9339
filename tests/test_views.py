"""Adapter views on keys far larger than those of the smallest data."""

import duckdb
import pytest

from linklens.checks import catalog, views

SF = "/root/testdata/sf0.001"
FAR = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The tables with order keys so high that two of `seq` pass 64 bits when added."""
    folder = tmp_path_factory.mktemp("far")
    c = duckdb.connect()
    for t in views.BASE_TABLES:
        row = f"* replace ({FAR[t]} + 5000000000 as {FAR[t]})" if t in FAR else "*"
        c.execute(f"copy (select {row} from '{SF}/{t}.parquet') to '{folder}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", ["a17_ticket_metrics", "m17_reconcile_tickets", "f35_page_state", "m15_domain_verdict_on_domains"])
def test_sums_beyond_64_bits(spark, far, name):
    c, folder = far
    df = catalog.QUERIES[name](spark, folder)
    res = c.execute(catalog.ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(res.fetchall())
