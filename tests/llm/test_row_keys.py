"""Keys of rows stay the same when the files of a table are split in another way between two executions."""

import random

import pytest

import corpus_pipeline as P
from linklens.llm import common as C
from linklens.llm import op5_hamming_join as N
from linklens.llm import op6_exact_dedup as E

SPLIT = "spark.sql.files.minPartitionNum"


@pytest.fixture
def table(spark, tmp_path):
    def words(k):
        rng = random.Random(k)
        return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(60))

    docs = [(i, words(i % 25) + (" x" if i >= 25 else "")) for i in range(40)] + [(i, words(i % 7)) for i in range(40, 48)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(8, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


@pytest.fixture
def moving(spark, monkeypatch):
    """Each stored table is read and each next one written with other splits."""
    sizes, store = [1, 64], C.stored

    def stored(df, name):
        out = store(df, name)
        sizes.reverse()
        spark.conf.set(SPLIT, sizes[0])
        return out

    yield lambda: (spark.conf.set(SPLIT, sizes[0]), monkeypatch.setattr(C, "stored", stored))
    spark.conf.unset(SPLIT)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_keys(spark, table):
    found = []
    for n in (1, 64):
        spark.conf.set(SPLIT, n)
        found.append({r.row: r.doc_id for r in C.placed(table, "doc_id").collect()})
    spark.conf.unset(SPLIT)
    assert found[0] == found[1] and len(found[0]) == table.count()
    assert len({r.row for r in C.placed(table.limit(30), "doc_id").collect()}) == 30


def test_decisions(spark, table, moving, tmp_path):
    spark.createDataFrame([(1, table.where("doc_id = 3").first().text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    right = [ids(E.drop_copies(table)), ids(N.drop_near_copies(table)), ids(P.drop_contaminated(spark, table, str(tmp_path)))]
    groups = sorted(map(tuple, N.near_groups(table).select("doc_id", "component_id", "stays").collect()))
    assert len(right[0]) == 40 and len(right[1]) == 25 and len(right[2]) < 48
    moving()
    exact, near, clean = E.drop_copies(table), N.drop_near_copies(table), P.drop_contaminated(spark, table, str(tmp_path))
    for n in (1, 64):
        spark.conf.set(SPLIT, n)
        assert [ids(exact), ids(near), ids(clean)] == right
    assert sorted(map(tuple, N.near_groups(table).select("doc_id", "component_id", "stays").collect())) == groups
