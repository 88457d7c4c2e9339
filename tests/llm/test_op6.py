"""Exact groups against SQL and a plain grouping."""

import random
import re

import duckdb
import pytest

from linklens.llm import op6_exact_dedup as E

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(E.SQL)
    columns = [d[0] for d in want.description]
    got = E.op6_exact_dedup(spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_on_executors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = E.recipes(docs).select("row").limit(10)
    for df in (E.exact_groups(docs), E.recipes(docs), E.chunk_contents(docs, rows)):
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan(df))


def test_chunks_are_made_once_and_texts_stay_where_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = E.recipes(docs).select("row").limit(10)
    optimized = E.chunk_contents(docs, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all") == 1
    below = plan(E.chunk_contents(docs, rows)).split("Generate")[1]  # from the scan to the chunks
    assert "SortMergeJoin" not in below and "ShuffledHashJoin" not in below and "BroadcastHashJoin" in below


def test_chunks_of_one_id_must_be_equal(spark, monkeypatch):
    rows = [(i, "a" * 300 + str(i // 2)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.group_size for r in E.exact_groups(docs).collect()) == [2] * 8
    contents = E.chunk_contents
    monkeypatch.setattr(E, "chunk_contents", lambda *a, **k: contents(*a, **k).withColumn("contents", E.F.lit(2)))
    with pytest.raises(RuntimeError):
        E.exact_groups(docs)


def test_made_up_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdeé 中\n") for _ in range(60000))
    docs = [(1, None), (2, ""), (3, " \t\x0b\f\r\n"), (4, "a b"), (5, "ab"), (6, "a  b"), (6, "a  b"), (None, "ab"), (7, long), (8, long.replace("\n", "  \n")),
            (9, long[:-1] + "x"), (10, " ab"), (None, None)]
    stored = spark.createDataFrame([(i, t, "k", True) for i, t in docs], "doc_id long, text string, keep_id string, kept boolean")
    got = E.exact_groups(stored).collect()
    assert len(got) == len(docs)
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted((repr(i), repr(min(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")])[3]), len(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")])) for i, t in docs)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = E.drop_copies(stored)
    assert kept.columns == stored.columns and kept.count() == len(groups)
    assert E.exact_groups(stored.limit(0)).count() == 0
