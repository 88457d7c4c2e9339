"""The random field in documents without a base span."""

import os

import numpy as np

from linklens.llm import op8_pii_skip_chain as P


def test_every_unobserved_node_is_scored(spark):
    """Weights that name a label for every node give each one a span, with or without a base span elsewhere."""
    weights = np.zeros((P.FEATURES, len(P.KINDS) + 1))
    weights[0, 4] = 50
    flat = np.zeros((len(P.KINDS) + 1,) * 2)
    stored = spark.createDataFrame([(1, "lot 123456 here"), (2, "lot 123456 here x@y.org"), (3, "lot 123 here"), (4, "é a@b")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in P.personal_data(stored, P.Field(weights, flat, flat)).collect()}
    assert spans == {1: "phone:4:10", 2: "email:16:23,phone:4:10", 3: "", 4: "phone:2:5"}


def test_fitted_in_a_task(spark, monkeypatch):
    """The driver fits nothing and gets no text, and the weights are those of the texts."""
    texts = [f"write to user{i}@host.org or call +1 (200) 555-{1000 + i}, lot {i}12345" for i in range(50)]
    stored = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    right = P.fit(texts)
    here = os.getpid()
    fit = P.fit
    monkeypatch.setattr(P, "fit", lambda texts: fit(texts) if os.getpid() != here else 1 / 0)
    got = P.fit_on(stored)
    assert all(np.allclose(a, b) for a, b in ((got.weights, right.weights), (got.chain, right.chain), (got.skip, right.skip)))
