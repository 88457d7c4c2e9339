"""Collocations against a plain count, and the tries against dictionaries."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from linklens.llm import op13_phrase_tries as P

SF = "/root/testdata/sf0.01"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER))]


def model(rows, least=P.LEAST, top=P.TOP):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for lang in total:
        scored = []
        for (own, w), a in found.items():
            if own != lang or any(100 * b >= 50 * a for (other, v), b in found.items() if other == lang and len(v) > len(w) and w in (v[:2], v[1:])):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            scored.append((-s, -a, " ".join(w).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def results(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def random_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "B", "b", "of", "The", "é", "É", "x\x00", "日本", "of's", "-", "z" * 300, "naïve"]
    gaps = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", " ; ", "\x0b", " ", "!?"]
    rows = [(rng.choice(["en", "de", None, "und", "", "x y"]), "".join(rng.choice(words[:rng.choice([3, 6, 13])]) + rng.choice(gaps) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), (None, None), ("zz", ".,; \n")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = random_rows(1)
    return rows, spark.createDataFrame([(t, x, 1, "r", "b") for x, t in rows], "text string, lang string, n int, phrase string, bucket string")


def test_random_rows(odd):
    rows, df = odd
    assert results(P.collocations(df)) == model(rows)


def test_bounds_change_nothing(odd, monkeypatch):
    """Small slices, tries of a few phrases in several scans, and sums by a shuffle beyond the last of them."""
    rows, df = odd
    monkeypatch.setattr(P, "HELD", 100)
    monkeypatch.setattr(P, "HELD_PHRASES", 20)
    monkeypatch.setattr(P, "TRIE", 400)
    monkeypatch.setattr(P, "GROUP", 30_000)
    want = model(rows)
    monkeypatch.setattr(P, "SCANS", 1000)
    assert results(P.collocations(df)) == want
    monkeypatch.setattr(P, "SCANS", 0)
    assert results(P.collocations(df)) == want


def test_a_full_filter_loses_and_adds_nothing(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(P, "bloom", lambda buckets, n: (b"\xff" * 8192, 16))
    monkeypatch.setattr(P, "SHOWN", 100_000)
    assert results(P.collocations(df)) == model(rows)


def test_empty_table_and_rare_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert results(P.collocations(empty)) == []
    assert results(P.collocations(spark.createDataFrame([("one two three.", "en")] * 9, "text string, lang string"))) == []
    assert results(P.collocations(spark.createDataFrame([("one two. two one", "en")] * 10, "text string, lang string"))) == model([("en", "one two. two one")] * 10)


def test_ranks_are_cut_and_ties_ordered(spark, monkeypatch):
    monkeypatch.setattr(P, "TOP", 5)
    rows = [("en", f"w{i} v{i}") for i in range(12) for _ in range(10)] + [("en", f"é{i} ü{i}") for i in range(3) for _ in range(10)]
    assert results(P.collocations(spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string"))) == model(rows, top=5)


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(10**13, 10**13 + 7, 10**14 - 1), (10**14, 10**14, 10**14), (3, 7, 11), (99_999_999_999_999, 10**14 - 1, 10**14), (10, 10, 10)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", P.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in df.collect()] == [10**6 * a * a // (left * right) for a, left, right in cases]


@pytest.mark.parametrize("n", [1, 2, 40, 2000])
def test_double_arrays(n):
    rng = random.Random(n)
    keys = sorted({bytes(rng.choice(b"abcdefgh \x00\xff\x0b") for _ in range(rng.randint(0, 12))) for _ in range(n)})
    base, label, slots = P.double_array(keys)
    states = {}
    for key, slot in zip(keys, slots.tolist(), strict=True):
        s = 0
        for i, c in enumerate(key):
            s = int(base[s]) + c
            assert label[s] == c and states.setdefault(s, key[:i + 1]) == key[:i + 1]
        assert s == slot


def test_streams_of_words():
    texts = [r[1] or "" for r in random_rows(7, 60)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    stream = P.Stream(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    want = [p for t in texts for p in pieces(t) if p]
    assert stream.buffer.tobytes().decode() == "".join(" ".join(p) + "\n" for p in want)
    assert [stream.doc[0], stream.doc[-1]] == [min(i for i, t in enumerate(texts) if any(pieces(t))), max(i for i, t in enumerate(texts) if any(pieces(t)))]


def test_query_against_sql_and_model(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = results(P.op13_phrase_tries(spark, SF))
    assert got == sorted(con.sql(P.ORACLES["op13_phrase_tries"]).fetchall())
    rows = con.sql("select lang, text from documents").fetchall()
    assert got == model(rows)
