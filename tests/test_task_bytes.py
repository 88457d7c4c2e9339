"""Tasks stay small however much is shuffled."""

import pytest

from linklens.checks import catalog
from linklens.session import BOUNDS, TASK_BYTES, bound_tasks

FIRST = "spark.sql.adaptive.coalescePartitions.parallelismFirst"


@pytest.fixture
def setting(spark):
    before = {name: spark.conf.get(name) for name in BOUNDS}
    yield lambda value: [spark.conf.set(name, value) for name in BOUNDS]
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("given", ["64MB", "67108864b", "67108864", "1g"])
def test_larger_settings_are_lowered(spark, setting, given):
    setting(given)
    bound_tasks(spark)
    assert [int(spark.conf.get(name).rstrip("b")) for name in BOUNDS] == [TASK_BYTES] * 2


@pytest.mark.parametrize("given", ["8m", "16k", "5000"])
def test_smaller_settings_stay(spark, setting, given):
    setting(given)
    before = [spark.conf.get(name) for name in BOUNDS]
    bound_tasks(spark)
    assert [spark.conf.get(name) for name in BOUNDS] == before


@pytest.mark.parametrize("name", ["u3_distinct_test_urls", "w1_evidence_cap"])
def test_queries_do_not_put_all_together(spark, setting, name):
    """What these shuffle at sf0.1 is one task of up to 64 MB, and more of up to 8 MB."""
    setting("64MB")
    spark.conf.set(FIRST, "false")
    try:
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset(FIRST)
