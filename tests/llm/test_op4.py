"""Recurring windows against a brute-force count of word tuples."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from linklens.llm import op4_phrase_automata as P

SF = "/root/testdata/sf0.01"


def brute(docs, n=P.WINDOW):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i:i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows(P.op4_phrase_automata(spark, SF)) == brute(docs)


@pytest.mark.parametrize(("bits", "exceptions"), [(27, 1 << 20), (12, 1 << 20), (12, -1), (27, -1)])
def test_made_up_rows(spark, monkeypatch, bits, exceptions):
    """With a filter that lets many windows pass that stand once, and with an exact join instead of their list."""
    monkeypatch.setattr(P, "WINDOW_BITS", bits)
    monkeypatch.setattr(P, "EXCEPTIONS", exceptions)
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}é" for _ in range(300)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 200), (5, "a " * 34), (None, " ".join(base[:80])), (7, "x y " + "\n".join(base[20:120]) + " tail"),
            (8, " ".join(base[150:190])), (9, " ".join(["lead"] + base[150:184] + ["end"])), (10, " ".join(base[200:235])), (11, "z " + " ".join(base[200:235])),
            (12, "b c " * 60), (13, "b c " * 19 + "q"), (8, " ".join(base[150:190])), (14, "ab" * 4000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept_sha256 string, row int").repartition(3)
    stored = spark.createDataFrame(df.collect(), df.schema)
    assert rows(P.without_recurring(stored)) == brute(docs)
    assert P.without_recurring(stored.limit(0)).count() == 0


def test_exceptions_are_known_by_both_hashes():
    exceptions = np.array([(1, 5), (1, 9), (7, 2)], dtype=np.uint64)
    h1, h2 = np.array([1, 1, 1, 7, 7, 3, 0, 9], dtype=np.uint64), np.array([5, 6, 9, 2, 3, 5, 1, 1], dtype=np.uint64)
    assert P.without(h1, h2, exceptions).tolist() == [False, True, False, False, True, True, True, True]
    assert P.without(h1, h2, exceptions[:0]).all()


def test_a_passage_is_found_inside_other_passages(spark):
    """Passages that overlap, lie in each other, begin or end a document, or follow each other directly."""
    rng = random.Random(8)
    w = [f"p{i}" for i in range(300)]
    pieces = [w[0:60], w[20:90], w[30:65], w[60:120], w[0:120], w[200:235], w[201:236], w[200:236]]
    docs = [(i, " ".join([f"u{i}"] * (i % 3) + rng.choice(pieces) + ([f"v{i}"] if i % 2 else []) + rng.choice(pieces))) for i in range(60)]
    assert rows(P.without_recurring(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
