"""Phrases against a plain word scan, block matches against every window's set."""

import random
import re

from linklens.llm import op9_license_blocks as L

SF = "/root/testdata/sf0.01"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs):
    out = []
    for doc_id, text in docs:
        w = words_of(text)
        places = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        labels, score = {label for _, label in places}, 1.0 if places else 0.0
        for i in range(0, len(w), L.BLOCK // 2):
            held = set(w[i:i + L.BLOCK])
            for label, template in L.TEMPLATES:
                t = set(template.split())
                if 100 * len(t & held) >= L.SHARE * len(t):
                    labels.add(label)
                    score = max(score, len(t & held) / len(t))
        at = [i for i, _ in places]
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows(L.op9_license_blocks(spark, SF))
    assert got == brute(docs) and any("gpl-3" in r[6] for r in got)


def test_made_up_rows(spark):
    rng = random.Random(2)
    pool = [w for _, t in L.TEMPLATES for w in t.split()] + ["zz", "émit", "x1"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 30, 70, 400])))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "Under-the MIT_license, cc/by/nc"), (103, "Apache License, Version 2.0"), (103, "Apache License, Version 2.0"),
             (104, "pad " * 20000 + "released under the mit license")]
    stored = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs], "doc_id long, text string, labels string, score double")
    assert rows(L.licenses(stored)) == brute(docs)
    assert L.licenses(stored.limit(0)).count() == 0
