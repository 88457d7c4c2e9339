"""Stored ids, bitmaps, sketches, identities and ranged copies."""

import pytest
from pyspark.sql import functions as F

from linklens.operators import distinct as X
from linklens.operators import rollup as R
from linklens.sources import copying
from linklens.sources.copying import RangedCopy


def days(spark, n=3):
    rows = spark.range(9000).select((F.col("id") % n).cast("int").alias("day"), F.concat(F.lit("d"), F.col("id") % 700).alias("domain"), F.concat(F.lit("r"), F.col("id") % 7).alias("root"))
    return [rows.where(F.col("day") == d) for d in range(n)]


def test_ids_are_dense_and_stay(spark, tmp_path):
    ids = X.ValueIds(spark, str(tmp_path))
    ids.extend(F.col("v"), spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v STRING"))
    first = {r.value: r.id for r in ids.table().collect()}
    ids.extend(F.col("v"), spark.createDataFrame([("0",), ("a",), ("c",)], "v STRING"))
    ids.extend(F.col("v"), spark.createDataFrame([("c",)], "v STRING"))
    then = {r.value: r.id for r in ids.table().collect()}
    assert sorted(first.values()) == [1, 2] and sorted(then.values()) == [1, 2, 3, 4] and first.items() <= then.items()


def test_bitmaps_of_days_merge_exactly_without_expand(spark, tmp_path):
    ids = X.ValueIds(spark, str(tmp_path))
    parts = []
    for rows in days(spark):
        ids.extend(F.col("domain"), rows)
        parts.append(X.bitmaps(ids.of(rows, "domain", "d"), {"domain": "d"}, "root"))
    merged = X.merged_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]), "root")
    assert {r.root: r.n for r in merged.collect()} == {f"r{i}": 100 for i in range(7)}
    assert "Expand" not in merged._jdf.queryExecution().executedPlan().toString()


def test_ids_beyond_one_bitmap(spark):
    rows = spark.range(1, 100_001).select("id").unionByName(spark.range(50_000, 150_001).select("id"))
    counts = X.by_kind(X.merged_counts(X.bitmaps(rows, {"x": "id"})), {"x": "n", "y": "none"})
    assert tuple(counts.first()) == (150_000, 0)
    assert tuple(X.by_kind(X.merged_counts(X.bitmaps(rows.limit(0), {"x": "id"})), {"x": "n"}).first()) == (0,)


def test_sketches_of_days_merge(spark):
    parts = [X.sketches(rows, "domain", "root") for rows in days(spark)]
    found = X.estimates(parts[0].unionByName(parts[1]).unionByName(parts[2]), "n", "root").collect()
    assert len(found) == 7 and all(abs(r.n - 100) <= 5 for r in found)


def test_identities_tell_apart_what_separators_hide(spark):
    rows = [("a", "b c"), ("a b", "c"), ("a", None), ("a", ""), (None, "a"), ("", "a"), ("a\",\"k1\":\"b", ""), ("a|b", "c"), ("a", "b|c")]
    df = spark.createDataFrame(rows, "x STRING, y STRING").withColumn("id", X.identity("x", "y"))
    assert df.select("id").distinct().count() == len(rows)
    assert tuple(X.identity_report(df, ["x", "y"], "id").first()) == (len(rows), len(rows), 0)
    clash = df.withColumn("id", F.when(F.col("y") == "", "same").otherwise(F.col("id")))
    assert tuple(X.identity_report(clash, ["x", "y"], "id").first()) == (len(rows), len(rows) - 1, 2)


def test_top_roots_without_expand(spark, tmp_path):
    ids = X.ValueIds(spark, str(tmp_path))
    rows = spark.createDataFrame([(t, f"d{i % 5}.{r}", r, 1 + i) for r in ("x.io", "y.io", "z.io") for t in range(3) for i in range(len(r) + t)], "task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT")
    ids.extend(F.col("domain"), rows)
    top = X.top_roots(rows, ids, 2)
    assert "Expand" not in top._jdf.queryExecution().executedPlan().toString()
    assert {r.root_domain: (r.domain_count, r.task_coverage) for r in top.collect()} == {"x.io": (5, 3), "y.io": (5, 3)}


@pytest.fixture
def source(spark):
    return spark.range(5, 1005).where("id % 10 <> 3").select("id", F.concat(F.lit("u\x00"), "id").alias("url"))


def test_an_interrupted_copy_resumes_only_unfinished_ranges(spark, source, tmp_path):
    copy = RangedCopy(source, str(tmp_path))
    assert copy.ranges(4) == {0: (5, 255), 1: (255, 505), 2: (505, 755), 3: (755, 1005)}
    copy.run(100, steps=1)
    copy.run(100, only=[1])
    assert copy.unfinished() == {0: (105, 255), 2: (605, 755), 3: (855, 1005)}
    # a step that broke off before its marks, and another session
    source.where("id < 300").withColumn("range_no", F.lit(0)).write.partitionBy("range_no").parquet(str(tmp_path / "data" / "broken"))
    seen = []
    later = RangedCopy(source, str(tmp_path))
    step = RangedCopy.step
    RangedCopy.step = lambda self, *a: (seen.append(self.unfinished()), step(self, *a))[1]
    try:
        later.run(100)
    finally:
        RangedCopy.step = step
    assert all(1 not in s for s in seen) and seen[0] == {0: (105, 255), 2: (605, 755), 3: (855, 1005)} and seen[-1] == {}
    got = sorted((r.id, r.url) for r in later.copied().collect())
    assert got == [(i, f"u{i}") for i in range(5, 1005) if i % 10 != 3]
    report = later.report().collect()
    assert sum(r.row_count for r in report) == 900 and all(r.finished and r.rows_per_second > 0 for r in report)


def test_copy_of_nothing(spark, source, tmp_path):
    copy = RangedCopy(source.limit(0), str(tmp_path))
    copy.run(10)
    assert copy.copied().count() == 0 and copy.report().count() == 0


def test_copy_pushes_the_ranges_to_the_scan(spark, source, tmp_path, monkeypatch):
    source.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plans = []
    clean = copying.without_nul
    monkeypatch.setattr(copying, "without_nul", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), clean(df))[1])
    copy = RangedCopy(stored, str(tmp_path / "c"))
    copy.ranges(2)
    copy.run(100, steps=1)
    assert copy.copied().count() == 180
    assert len(plans) == 1 and "LessThan(id,105)" in plans[0] and "GreaterThanOrEqual(id,505)" in plans[0]


def test_page_counts_lie_within_five_percent(spark):
    """Two of six thousand domains whose pages a sketch of 1.6 percent standard error misjudges by 6.6 and 5.1 percent."""
    rows = spark.range(634 * 20000, 804 * 20000).where("id div 20000 in (634, 803)").select(
        F.expr("id div 20000").alias("domain"), F.lit("r").alias("root_domain"), F.concat(F.lit("https://p.test/q"), "id").alias("page_url"))
    found = R.domain_page_counts(rows).collect()
    assert len(found) == 2 and all(abs(r.page_count - 20000) <= 1000 for r in found)
