"""Counts and filters against plain n-gram sets, held-out accuracy, odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from linklens.llm import op10_language_masks as L

SF = "/root/testdata/sf0.01"


def plain(text):
    low = bytes(b | 32 if 65 <= b <= 90 else b for b in text.encode())
    out = Counter()
    for word in re.findall(rb"[a-z\x80-\xff]+", low):
        padded = b" " + word + b"  "
        out.update(int.from_bytes(padded[i:i + 4], "big") for i in range(len(word)))
    return out


def test_counts():
    texts = ["Der Hund, der Hund", "", "été 12 a", "The dog"]
    langs = ["de", "de", "fr", "en"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(langs)], names=["text", "lang"])
    got = Counter()
    for b in L.count_batches(iter([batch])):
        for lang, gram, n in zip(*(b.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
            got[lang, gram] += n
    want = Counter()
    for t, lang in zip(texts, langs, strict=True):
        for g, n in plain(t).items():
            want[lang, g] += n
    assert got == want


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null")
    model = L.fit(docs)
    counts = {}
    for r in docs.collect():
        counts.setdefault(r.lang, Counter()).update(plain(r.text or ""))
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    grams = sorted({g for c in counts.values() for g in c})
    best = {g: max(s.get(g, 0) for s in shares.values()) for g in grams}
    want = np.array([[s.get(g, 0) >= max(L.LEAST_SHARE, L.LEAST_OF_BEST * best[g]) for s in (shares[x] for x in model.languages)] for g in grams])
    got = model.hits(np.array(grams, dtype=np.uint64)).astype(bool)
    assert not (want & ~got).any()
    assert (got & ~want).mean() < 0.01


def test_held_out_accuracy(spark):
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = L.op10_language_masks(spark, SF).join(lang, "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the dog and the cat", "en", "a"), (2, None, "en", "b"), (3, "", "de", "c"), (4, "123 — !", "de", "d"), (5, "der hund und die katze", "de", "e"),
                                  (None, "中文", None, "f"), (5, "der hund", "de", "g"), (6, "the " * 50000, None, "h")], "doc_id long, text string, lang string, lang_pred string")
    learnt = docs.where("lang is not null and text is not null")
    got = [(r.doc_id, r.lang_pred) for r in L.languages(docs, L.fit(learnt)).collect()]
    assert sorted(got, key=repr) == sorted([(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "de"), (5, "de"), (6, "en")], key=repr)
    assert {r.lang_pred for r in L.languages(docs, L.fit(learnt.limit(0))).collect()} == {"und"}
    assert L.languages(docs.limit(0), L.fit(learnt)).count() == 0
