"""The chain against sums over all paths, held-out accuracy, odd rows."""

import itertools

import numpy as np
import pytest

from linklens.llm import op3_toxic_spans as T


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    model = T.Model(np.zeros(1), 0.0, np.array([0.0, 0.3]), rng.normal(size=(2, 2)))
    lengths = [0, 1, 2, 7, 0, 9]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emission = rng.normal(size=first[-1])
    got, odds, counts = T.chain(first, emission, model, pairs=True)
    all_counts = np.zeros((2, 2))
    for d, n in enumerate(lengths):
        e = emission[first[d]:first[d + 1]]
        total, toxic, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            if n:
                score = model.start[path[0]] + sum(model.moves[a, b] for a, b in zip(path, path[1:])) + e @ np.array(path)
                w = np.exp(score)
                total += w
                toxic += w * np.array(path)
                for a, b in zip(path, path[1:]):
                    moves[a, b] += w
        if n:
            assert np.allclose(got[first[d]:first[d + 1]], toxic / total)
            top = (toxic / total).max()
            assert np.isclose(odds[d], np.log(top / (1 - top)))
            all_counts += moves / total
    assert np.allclose(counts, all_counts)


def test_long_chain_equals_single_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    model = T.Model(np.zeros(1), 0.0, np.array([0.0, -1.0]), rng.normal(size=(2, 2)))
    first, emission = np.array([0, 400, 410]), rng.normal(size=410)
    a = T.chain(first, emission, model)
    monkeypatch.setattr(T, "BLOCK", 7)
    b = T.chain(first, emission, model)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = T.op3_toxic_spans(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("toxic", [[], [(1, 0)], [(1, 1), (2, 1)], [(1, 0), (2, 1), (2, None), (None, 1)]])
def test_odd_rows(spark, toxic):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (2, "", "z"), (None, "word " * 30000, "w")], "doc_id long, text string, score string")
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    model = T.fit_on(docs, labels, mod=1000)
    got = T.toxicity(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert T.toxicity(docs.limit(0), model).count() == 0
