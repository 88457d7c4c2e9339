"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linklens.llm import op2_bpe_chunks as B
from linklens.llm import words as W

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def coder():
    return B.Coder(B.VOCABULARY, B.RANKS)


def by_chunks(coder, text, cut_bits):
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    rng = np.random.default_rng(len(data))
    starts = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
    own = sorted(i for i in starts if rng.random() < 2.0**-cut_bits)
    odd = np.concatenate([[0], np.cumsum(B.strange_bytes(data))])
    return B.encode_one(data.tobytes(), [0, *own, len(data)], B.sync_places(data), odd, coder).tolist()


PIECES = ["the", " erhand", " ", "  ", "\n", "'s", "'", "re", "123", "éü", "<|endoftext|>", "<|endo", "中文", "\u0085", " ", "!!", "a b", "🙂", "x" * 50, "\t", "ne ver"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 5))
def test_joins_agree_with_whole_text(coder, pieces, cut_bits):
    text = "".join(pieces)
    assert by_chunks(coder, text, cut_bits) == coder.exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(1, 4))
def test_any_text(coder, text, cut_bits):
    ids = by_chunks(coder, text, cut_bits)
    assert ids == coder.exact.encode(text, add_special_tokens=False).ids
    assert coder.decode(np.array(ids, dtype=np.uint32)) == coder.exact.decode(ids, skip_special_tokens=False)


def test_cuts_depend_on_content_only():
    text = np.frombuffer(b"".join(b"word%d and more " % i for i in range(3000)), dtype=np.uint8)
    powers = W.Powers(W.BYTE_BASE)
    bounds = np.array([0, len(text)])
    alone = B.cuts(text, bounds, powers)
    moved = B.cuts(np.concatenate([text[:777], text]), np.array([0, 777, 777 + len(text)]), powers)
    assert len(alone) > 5 and (moved[moved > 777] - 777).tolist() == alone.tolist()


def test_query_against_the_library(spark, coder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = B.op2_bpe_chunks(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = coder.exact.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.exact.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a <|endoftext|> b", "z"), (2, "long " * 40000, "w"), (2, "q" * 5000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").coalesce(2)
    got = {(r.doc_id, r.n_tokens): r.decoded for r in B.encoded(docs).collect()}
    assert len(got) >= 4 and B.encoded(docs).count() == 5
    assert got[1, 0] == "" and sorted(got.values(), key=len)[-1] == "long " * 40000
    assert any(r.n_tokens == 4 and 50256 in np.frombuffer(r.ids, "<u4") for r in B.encoded(docs).where("doc_id is null").collect())
    assert B.encoded(docs.limit(0)).count() == 0
