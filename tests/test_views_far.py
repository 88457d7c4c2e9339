"""Every query over tickets and responses on order keys whose derived numbers pass 64 bits when added."""

import duckdb
import pytest

from linklens.checks import catalog, views

SF = "/root/testdata/sf0.001"
FAR = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
NAMES = """a17_ticket_metrics a18_pending_by_level a19_pending_by_task a24_cycle_stats a25_rollback_stats a30_unresolved_pages f24_labels
f35_page_state m12_bucketed_ticket_sync m12_ticket_sync m13_page_verdicts_applied m14_a30_domains_closed m15_domain_verdict_on_domains
m15_ticket_details m15_domain_verdict_on_tickets m16_rollback_domains m16_rollback_tickets m17_reconcile_counts m17_reconcile_tickets
q13_tickets m9_m12_rule_sync_new_tickets q14_retest_queue""".split()


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    c = duckdb.connect()
    for t in views.BASE_TABLES:
        row = f"* replace ({FAR[t]} + 5000000000 as {FAR[t]})" if t in FAR else "*"
        c.execute(f"copy (select {row} from '{SF}/{t}.parquet') to '{folder}/{t}.parquet'")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c, str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_the_sql(spark, far, name):
    c, folder = far
    df = catalog.QUERIES[name](spark, folder)
    res = c.execute(catalog.ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(res.fetchall(), key=repr)
