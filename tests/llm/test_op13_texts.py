"""Texts of the candidates: named once by a task, whatever it holds at a time."""

import numpy as np
import pyarrow as pa
import pytest

from linklens.llm import op13_phrase_tries as P
from linklens.llm import words as W

TEXTS = ["Über den Fluss, über den Berg. über den fluss", "the house of the river\nthe house of the sea", "", "日本 a\tb  a b 日本", "x"] * 40
LANGS = ["de", "en", "en", "und", "xx"] * 40


def batches():
    for low in range(0, len(TEXTS), 10):
        yield pa.RecordBatch.from_arrays([pa.array(LANGS[low:low + 10]), pa.array(TEXTS[low:low + 10])], names=["lang", "text"])


def named(places, monkeypatch):
    monkeypatch.setattr(P, "NAMED", places)
    monkeypatch.setattr(P, "HELD_PHRASES", 5)
    everything = np.full(1 << 10, -1, dtype=np.int64).tobytes()
    return [r for b in P.text_batches(batches(), everything, 16) for r in b.to_pylist()]


@pytest.mark.parametrize("places", [1, 7, 1 << 16])
def test_all_phrases(places, monkeypatch):
    rows = named(places, monkeypatch)
    wanted = {(r["lang"], r["phrase"], r["bucket"]) for b in P.candidate_batches(batches(), np.full(1 << 10, -1, dtype=np.int64).tobytes(), 16) for r in b.to_pylist() if r["phrase"] is not None}
    assert {(r["lang"], r["phrase"], r["bucket"]) for r in rows if r["phrase"] is not None} == wanted
    assert {r["lang"]: r["n"] for r in rows if r["phrase"] is None} == {"de": 360, "en": 400, "und": 240, "xx": 40}


def test_each_once(monkeypatch):
    phrases = [r["bucket"] for r in named(1 << 16, monkeypatch) if r["phrase"] is not None]
    assert len(phrases) == len(set(phrases))
