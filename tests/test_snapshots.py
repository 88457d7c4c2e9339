"""Bucketed table versions: what a batch rewrites, reads and leaves alone."""

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from linklens.operators import merge as M
from linklens.sources.snapshots import BucketedTable, VersionConflict

DOMAINS = "task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT, has_link BOOLEAN, has_text BOOLEAN, sample_page_url STRING, risk_level STRING"


def domain_rows(spark, tasks, names, n=1):
    return spark.createDataFrame([(t, d, d, n, True, False, f"p{t}", "safe") for t in tasks for d in names], DOMAINS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(table, buckets=None):
    """Place and time of change of every data file."""
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in pathlib.Path(table.folder, "data").rglob("*.parquet")
            if buckets is None or int(p.parent.name.split("=")[1]) in buckets}


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable.create(domain_rows(spark, range(40), [f"d{i}.com" for i in range(20)]), str(tmp_path / "t"), ["task_id", "domain"], groups=16, spread=2)


def test_equal_to_a_merge_of_the_whole_table(spark, table):
    whole = table.read()
    for i, batch in enumerate([domain_rows(spark, [3], ["d1.com", "new.com"], 5), domain_rows(spark, [3, 99], ["d1.com"], 7), domain_rows(spark, range(40), ["d2.com"])]):
        whole = M.merge_domains(whole, batch)
        table.upsert(batch, M.merge_domains)
        assert rows(table.read()) == rows(whole) and table.version() == i + 1


def test_other_buckets_are_neither_changed_nor_read(spark, table):
    before = files(table)
    batch = domain_rows(spark, [3], ["d1.com", "new.com"], 5)
    touched = sorted({r[0] for r in batch.select(table.bucket()).collect()})
    others = [p for p in before if int(pathlib.Path(p).parent.name.split("=")[1]) not in touched]
    held = {p: pathlib.Path(p).read_bytes() for p in others}
    assert 1 <= len(touched) <= 2 and len(others) > 10
    for p in others:  # a read of any of them would fail
        pathlib.Path(p).write_bytes(b"no parquet")
    spoiled = files(table)
    assert table.upsert(batch, M.merge_domains) == touched
    assert {p: x for p, x in files(table).items() if p in spoiled} == spoiled
    new = [p for p in files(table) if p not in spoiled]
    assert new and {int(pathlib.Path(p).parent.name.split("=")[1]) for p in new} == set(touched)
    for p, data in held.items():
        pathlib.Path(p).write_bytes(data)
        os.utime(p)
        pathlib.Path(p).with_name(f".{pathlib.Path(p).name}.crc").unlink(missing_ok=True)
    assert table.read().count() == 801 and table.read().where("occurrence_count = 6").count() == 1
    assert {pathlib.Path(p.removeprefix("file:")).parent.name for p in table.read(buckets=touched).inputFiles()} <= {f"bucket={b}" for b in touched}


def test_a_scan_is_read_from_its_buckets(spark, table):
    mine = table.of_groups(spark.createDataFrame([(7,), (7,)], "task_id BIGINT"))
    assert mine.count() == 20 and len({p.rsplit("/", 2)[1] for p in mine.inputFiles()}) <= 2


def test_versions_and_conflicts(spark, table):
    first = rows(table.read())
    table.upsert(domain_rows(spark, [1], ["a.com"]), M.merge_domains)
    stale = BucketedTable.open(spark, table.folder)
    assert rows(stale.read(0)) == first and rows(stale.read()) != first
    attempt, written = stale._write(domain_rows(spark, [2], ["b.com"]), [])
    with pytest.raises(VersionConflict):
        stale._commit(1, "late", attempt, written, stale.places(0))
    assert rows(table.read()) == rows(stale.read(1))


def test_a_replayed_batch_counts_once(spark, table):
    for _ in range(2):
        table.upsert(domain_rows(spark, [1], ["d1.com"], 10), M.merge_domains, name="batch 4")
    assert table.read().where("occurrence_count = 11").count() == 1 and table.version() == 1


def test_a_bucket_may_become_empty(spark, tmp_path):
    table = BucketedTable.create(domain_rows(spark, [1, 2, 3], ["a.com"]), str(tmp_path / "t"), ["task_id", "domain"], groups=8, spread=1)
    table.upsert(domain_rows(spark, [2], ["a.com"]), lambda old, gone: old.join(gone.select("task_id", "domain"), ["task_id", "domain"], "left_anti"))
    assert sorted(r.task_id for r in table.read().collect()) == [1, 3]
    empty = BucketedTable.create(table.read().limit(0), str(tmp_path / "e"), ["task_id", "domain"])
    assert empty.read().count() == 0
    empty.upsert(domain_rows(spark, [5], ["a.com"]), M.merge_domains)
    assert BucketedTable.open(spark, empty.folder).read().count() == 1
    empty.upsert(empty.read().limit(0), M.merge_domains)
    assert empty.read().count() == 1 and empty.version() == 2


def test_vacuum_keeps_what_is_named(spark, table):
    for i in range(3):
        table.upsert(domain_rows(spark, [4], ["d4.com"], i), M.merge_domains)
    whole, before = rows(table.read()), rows(table.read(2))
    assert len(table.vacuum(keep=2)) == 2
    assert rows(table.read()) == whole and rows(table.read(2)) == before
    assert len(table.vacuum()) == 1 and rows(table.read()) == whole


def test_a_large_scan_is_spread(spark, tmp_path):
    df = spark.range(3000).select(F.lit(1).alias("task_id"), F.concat(F.lit("d"), "id").alias("domain"))
    table = BucketedTable.create(df, str(tmp_path / "t"), ["task_id", "domain"], groups=8, spread=8)
    sizes = [r["count"] for r in table.read().groupBy(table.bucket()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
