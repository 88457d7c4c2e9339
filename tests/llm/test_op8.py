"""Base spans against the patterns as written, and consistency of repeated entities."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from linklens.llm import op8_pii_skip_chain as P

SF = "/root/testdata/sf0.01"


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len([c for c in m.group() if c in "0123456789"]) <= 15:
            out.append((3, *m.span()))
    return out


PIECES = ["a", "b.c", "@", "@x", ".", "..", "1", "255", "256", "0.0", "10.", " ", "-", "+", "+1", "(5)", "4111", "1111", " 1111", "é", "\n", "555-2678", "_", "%"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert P.base_spans(text) == brute(text)


def check(docs, got):
    texts = sorted(((i, t or "") for i, t in docs), key=repr)
    rows = sorted(got, key=lambda r: (repr(r.doc_id), r.doc_id is None))
    assert len(texts) == len(rows)
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(t)
    for r in rows:
        options = []
        for t in by_id[r.doc_id]:
            base = brute(t)
            line = ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base)
            options.append((tuple(sum(k == j for k, _, _ in base) for j in range(4)), hashlib.sha256(line.encode()).hexdigest(), set(filter(None, line.split(",")))))
        match = [o for o in options if o[:2] == ((r.n_email, r.n_ip, r.n_card, r.n_phone), r.base_sha256)]
        assert match and match[0][2] <= set(r.spans.split(","))


def test_query_against_the_patterns(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(docs, P.op8_pii_skip_chain(spark, SF).collect())


def test_repetitions_get_the_label(spark):
    rng = random.Random(4)
    docs = []
    for i in range(300):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        docs.append((i, f"call {phone} now or {phone} later, order 20{rng.randrange(10, 99)} of lot {rng.randrange(10**5, 10**6)}x"))
    docs += [(900, "tel +1 (736) 555-2678 and again 555-2678, or 555-2678."), (901, None), (902, ""), (903, "12" * 5000), (904, "a" * 20000 + "@"), (None, "x@y.z"), (None, "x@y.z")]
    stored = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, spans string")
    got = P.personal_data(stored, P.fit_on(stored)).collect()
    check(docs, got)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[900] == "phone:4:21,phone:32:40,phone:45:53"
    assert all(spans[i].count("phone") == 2 for i in range(300))
    assert P.personal_data(stored.limit(0), P.fit_on(stored.limit(0))).count() == 0
