"""Every stage against a plain version of its decision on its own input."""

import re

import numpy as np

import corpus_pipeline as P
from linklens.llm import op2_bpe_chunks as B
from linklens.llm import op3_toxic_spans as T
from tests.llm.test_op1 import brute as leaks
from tests.llm.test_op5 import brute as near

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for number, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if number < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(kept[name])
    before = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in T.op3_toxic_spans(spark, SF).collect()}
    now = {i for i in before if scores[i] < 0.5}
    assert set(kept["toxicity"]) == now
    groups = {}
    for i in now:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", before[i].text or ""), []).append(i)
    now = {min(g, key=lambda i: (-len(before[i].text or ""), i)) for g in groups.values()}
    assert set(kept["exact dedup"]) == now
    now = {c for _, _, c in near([(i, before[i].text) for i in now], 5)}
    assert set(kept["near dedup"]) == now
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now -= {r[0] for r in leaks([(i, before[i].text) for i in now], items)}
    assert set(kept["decontamination"]) == now
    assert kept["decontamination"] == {i: before[i] for i in now}
    coder = B.Coder(B.VOCABULARY, B.RANKS)
    assert set(kept["encoding"]) == now
    for i, r in kept["encoding"].items():
        assert r.decoded == before[i].text
        assert np.frombuffer(r.ids, "<u4").tolist() == coder.exact.encode(before[i].text, add_special_tokens=False).ids
    again = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert again == kept["encoding"]
