"""Encoding and decoding against the sentencepiece library."""

import hashlib

import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from linklens.llm import op11_prefix_tokens as T

SF = "/root/testdata/sf0.01"
BITS = [" ", "  ", "      ", "e", "r", "t", "he", "in", "*", "==", "--", "#", "\t", "\n", "é", "ß", "日", "本", "\U0001F9FF", "\x00", "▁", "</s>", "<s>", "<0x41>", "ﬁ", "́",
        "​", "﻿", "\xa0", "A", "0", "12"]


@pytest.fixture(scope="module")
def pieces():
    return T.Pieces()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.MODEL))


def agree(pieces, library, text):
    want = library.encode(text, add_eos=True)
    assert pieces.encode(text).tolist() == want
    assert pieces.decode(want) == library.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=40))
def test_built_texts(pieces, library, parts):
    agree(pieces, library, "".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_texts(pieces, library, text):
    agree(pieces, library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 258), st.sampled_from([259, 260, 28705, 272, 261]), st.integers(0, 31999)), max_size=12))
def test_any_ids_decode(pieces, library, ids):
    assert pieces.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("tail", ["", "the cat", "\U0001F9FF", "\n", "=="])
def test_runs_of_spaces(pieces, library, tail):
    for n in range(100):
        agree(pieces, library, " " * n + tail)
        agree(pieces, library, "a" + " " * n + tail)


def test_long_stretches(pieces, library):
    for text in ("a" * 20000, "ab" * 9000, "=" * 4001, "日本" * 3000, "x\U0001F9FF" * 2000, " " * 5000):
        agree(pieces, library, text)


def test_pairs_against_merging_in_full(pieces):
    import random

    rng, ids, tried = random.Random(5), list(pieces.id.values()), 0
    for _ in range(20000):
        whole = pieces.text[rng.choice(ids)]
        k = rng.randint(1, len(whole))
        left, right = (whole[:k], whole[k:]) if rng.random() < 0.6 else (pieces.text[rng.choice(ids)], whole)
        if left in pieces.id and right in pieces.id and left.strip(T.SPACE) and not right.startswith(T.SPACE):
            assert pieces.apart(pieces.id[left], pieces.id[right]) == (pieces.merged(left + right) == [left, right])
            tried += 1
    assert tried > 3000


def test_what_is_remembered_is_bounded(pieces, library, monkeypatch):
    monkeypatch.setattr(T, "STRETCHES", 5)
    monkeypatch.setattr(T, "PAIRS", 7)
    agree(pieces, library, " ".join(f"word{i % 17} other{i}" for i in range(300)))
    assert len(pieces.stretches[0]) <= 5


def test_query_on_all_documents(spark, library):
    got = {r.doc_id: r for r in T.op11_prefix_tokens(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_tables(spark, library):
    schema = "doc_id long, text string, row string, ids int"
    rows = [(1, None, "x", 1), (1, "", "x", 1), (None, "  a b", None, None), (2, "same", "y", 2), (2, "same", "y", 2)]
    got = T.encoded(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(d), library.encode(t or "", add_eos=True), t or "") for d, t, _, _ in rows)
    assert T.encoded(spark.createDataFrame([], schema)).count() == 0
