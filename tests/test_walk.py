"""What a walk reads and shuffles."""

import time

import pytest
from pyspark.sql import functions as F

from linklens.operators import graph as G

EDGES = "task_id INT, src STRING, dst STRING"
SEEDS = "task_id INT, url STRING, depth INT"


def chain(spark, n, side=0):
    """u0 -> u1 -> ... and pages that nothing leads to."""
    rows = spark.range(n).select(F.lit(1).alias("task_id"), F.concat(F.lit("u"), "id").alias("src"), F.concat(F.lit("u"), F.col("id") + 1).alias("dst"))
    return rows.unionByName(spark.range(side).select(F.lit(2).alias("task_id"), F.concat(F.lit("s"), "id").alias("src"), F.lit("hub").alias("dst")))


def depths(df):
    return {(r.task_id, r.url): r.depth for r in df.collect()}


def test_a_chain_reads_only_the_buckets_on_its_way(spark, monkeypatch):
    read = []
    some = G.Bucketed.some

    def watched(self, buckets):
        out = some(self, buckets)
        read.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(G.Bucketed, "some", watched)
    n = 25
    got = depths(G.walk(spark.createDataFrame([(1, "u0", 0)], SEEDS), chain(spark, n, 500)))
    assert got == {(1, f"u{i}"): i for i in range(n + 1)}
    assert len(read) >= 2 * n
    links, reached = read[::2], read[1::2]
    assert max(links) <= 1 and max(reached) <= n  # one bucket, which each level may have added a file to


@pytest.mark.parametrize("small", [0, 5, 10_000])
def test_either_way_of_reading_gives_the_same(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL", small)
    edges = spark.createDataFrame([(t, f"a{i}", f"a{j}") for t in (1, 2) for i in range(40) for j in (i // 2, i * 2 + t, (i * 7) % 40)], EDGES)
    seeds = [(1, "a1", 0), (1, "a39", 3), (2, "a2", 1), (2, "x", 5), (2, "a2", 2)]
    want = {}
    links = {}
    for r in edges.collect():
        links.setdefault((r.task_id, r.src), set()).add((r.task_id, r.dst))
    front, depth, waiting = set(), 0, {d for _, _, d in seeds}
    while front or any(d >= depth for d in waiting):
        level = {x for u in front for x in links.get(u, ())} | {(t, u) for t, u, d in seeds if d == depth}
        front = {x for x in level if x not in want}
        want.update(dict.fromkeys(front, depth))
        depth += 1
    assert depths(G.walk(spark.createDataFrame(seeds, SEEDS), edges)) == want


def test_neither_links_nor_reached_urls_are_shuffled(spark, monkeypatch):
    """Exchanges stand only above what a level finds."""
    plans = []
    monkeypatch.setattr(G, "SMALL", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    not_reached = G.not_reached
    monkeypatch.setattr(G, "not_reached", lambda *a: (plans.append(not_reached(*a)._jdf.queryExecution().executedPlan().toString()), not_reached(*a))[1])
    try:
        G.walk(spark.createDataFrame([(1, "u0", 0)], SEEDS), chain(spark, 3, 50)).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans[1:]:
        assert plan.count("Exchange") == 1, plan
        assert plan.count("Bucketed: true") == 3, plan


def test_tables_of_a_walk_leave_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    G.walk(spark.createDataFrame([], SEEDS), chain(spark, 3)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_assets_take_the_smallest_depth_through_many_imports(spark):
    pages = spark.createDataFrame([(1, "p", 9), (1, "q", 2)], SEEDS)
    uses = spark.createDataFrame([(1, "p", "c0"), (1, "q", "c3")], EDGES)
    imports = spark.createDataFrame([(1, f"c{i}", f"c{i + 1}") for i in range(6)] + [(1, "c6", "c0")], EDGES)
    assert depths(G.reach_assets(pages, uses, imports)) == {(1, f"c{i}"): 2 for i in range(7)}


def test_time_grows_with_the_chain(spark):
    """Twice the levels, about twice the time: nothing grows with the levels before."""
    def seconds(n):
        start = time.perf_counter()
        assert G.walk(spark.createDataFrame([(1, "u0", 0)], SEEDS), chain(spark, n)).count() == n + 1
        return time.perf_counter() - start
    seconds(3)
    assert seconds(24) < 4 * seconds(12)
