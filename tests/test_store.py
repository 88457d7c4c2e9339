"""The log-structured store: what is visible, compaction beside writers, vacuum."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from linklens.streaming import store as S

SCHEMA = "k STRING, n BIGINT, batch_id BIGINT"


def fold(df):
    return df.groupBy("k").agg(F.sum("n").alias("n"), F.min("batch_id").alias("batch_id")).select("k", "n", "batch_id")


TABLES = {"a": (SCHEMA, fold), "b": (SCHEMA, fold)}


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


def put(spark, store, batch, rows, commit=True):
    for table in TABLES:
        S.write_delta(spark.createDataFrame(rows, "k STRING, n BIGINT"), store, table, batch)
    if commit:
        S.commit(spark, store, list(TABLES), batch)


def seen(spark, store, table="a"):
    return {r["k"]: (r["n"], r["batch_id"]) for r in fold(S.current(spark, store, table, SCHEMA)).collect()}


def test_only_committed_batches_are_seen(spark, store):
    assert seen(spark, store) == {}
    put(spark, store, 0, [("x", 1)])
    put(spark, store, 1, [("x", 10)], commit=False)
    assert seen(spark, store) == {"x": (1, 0)}
    put(spark, store, 1, [("x", 20)])
    assert seen(spark, store) == seen(spark, store, "b") == {"x": (21, 0)}


def test_writers_go_on_beside_a_compaction(spark, store):
    put(spark, store, 0, [("x", 1), ("y", 1)])
    put(spark, store, 1, [("x", 2)])
    late = []

    def slow(df):
        if not late:  # a batch comes in while the compaction runs
            late.append(1)
            put(spark, store, 2, [("x", 4), ("z", 4)])
        return fold(df)
    assert S.compact(spark, store, {"a": (SCHEMA, slow), "b": (SCHEMA, fold)}) == 0
    assert seen(spark, store) == seen(spark, store, "b") == {"x": (7, 0), "y": (1, 0), "z": (4, 2)}
    put(spark, store, 3, [("y", 8)])
    assert S.compact(spark, store, TABLES) == 1 and S.compact(spark, store, TABLES) is None
    assert seen(spark, store) == {"x": (7, 0), "y": (9, 0), "z": (4, 2)}
    assert S.live_batches(spark, store, "a", S.newest(spark, store)[1]["a"][1]) == []


def test_a_batch_replayed_after_its_compaction_counts_once(spark, store):
    put(spark, store, 0, [("x", 1)])
    put(spark, store, 1, [("x", 2)])
    S.compact(spark, store, TABLES)
    put(spark, store, 1, [("x", 2)])
    put(spark, store, 2, [("x", 4)])
    assert seen(spark, store) == {"x": (7, 0)}


def test_the_second_of_two_compactions_fails(spark, store):
    put(spark, store, 0, [("x", 1)])

    def meanwhile(df):
        if S.newest(spark, store)[0] < 0:
            S.compact(spark, store, TABLES)
        return fold(df)
    with pytest.raises(AnalysisException):
        S.compact(spark, store, {"a": (SCHEMA, meanwhile), "b": (SCHEMA, fold)})
    assert seen(spark, store) == {"x": (1, 0)}


def test_readers_of_the_old_generation_until_vacuum(spark, store):
    put(spark, store, 0, [("x", 1)])
    S.compact(spark, store, TABLES)
    put(spark, store, 1, [("x", 2)])
    old = S.current(spark, store, "a", SCHEMA)
    S.compact(spark, store, TABLES)
    assert old.count() == 2
    assert len(S.vacuum(spark, store)) == 6  # two bases, two batches of two tables
    assert seen(spark, store) == {"x": (3, 0)} and S.vacuum(spark, store) == []
