"""Assets with imports: every import is stored once, whatever the number of pages that repeat it."""

import pytest

from linklens.operators import graph as G

EDGE = "task_id int, src string, dst string"


@pytest.fixture
def stored(monkeypatch):
    """Rows that were appended to bucketed tables, by the first word of the table's name."""
    rows, append = {}, G.Bucketed.append

    def counted(self, df, *parts):
        append(self, df, *parts)
        rows[self.name.split("_")[0]] = self.whole().count()

    monkeypatch.setattr(G.Bucketed, "append", counted)
    return rows


def test_repeated_imports(spark, stored):
    pages = spark.createDataFrame([(1, "p", 3), (1, "q", 1), (2, "p", 0)], "task_id int, url string, depth int")
    used = spark.createDataFrame([(1, "p", "a"), (1, "q", "b"), (2, "p", "a")] * 20, EDGE)
    # c is found by way of a (3) and by way of b and d (1), a again by way of c
    imports = spark.createDataFrame([(1, "a", "c"), (1, "b", "d"), (1, "d", "c"), (1, "c", "a"), (2, "x", "y")] * 50, EDGE)
    found = {tuple(r) for r in G.reach_assets(pages, used, imports).collect()}
    assert found == {(1, "a", 1), (1, "b", 1), (1, "c", 1), (1, "d", 1), (2, "a", 0)}
    assert stored["imports"] == 5


def test_no_assets(spark):
    pages = spark.createDataFrame([], "task_id int, url string, depth int")
    assert G.reach_assets(pages, spark.createDataFrame([], EDGE), spark.createDataFrame([], EDGE)).collect() == []
