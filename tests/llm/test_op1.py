"""Contaminated documents against a plain scan of every document for every item."""

import random
import re
from collections import Counter, defaultdict

from linklens.llm import op1_template_join as T

SF = "/root/testdata/sf0.01"


def template(text):
    out, last_end, last_number = [], 0, False
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
        word = m.group()
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        opens = not out or bool(re.search(r"[\n!.:?]", text[last_end:m.start()]))
        number = bool(re.search("[0-9]", word)) or low in T.NUMBER_WORDS
        kind = "<num>" if number else "<unit>" if last_number and low in T.UNITS else "<name>" if re.match("[A-ZÀ-Þ]", word) and not opens else None
        out.append((kind or low, word if kind else None))
        last_end, last_number = m.end(), number
    n = T.WINDOW
    return [(tuple(k for k, _ in out[i:i + n]), [(i + at, w) for at, (_, w) in enumerate(out[i:i + n]) if w is not None]) for i in range(len(out) - n + 1)]


def brute(docs, items):
    """In a shift a document's value stands for an item's one by a majority of the places of both; a window counts if it is unchanged or all its values stand."""
    out, wanted = [], [(i, template(t)) for i, t in items]
    for doc_id, text in docs:
        at = defaultdict(list)
        for p, (w, slots) in enumerate(template(text)):
            at[w].append((p, slots))
        for item_id, windows in wanted:
            shifts = defaultdict(list)
            for q, (w, slots) in enumerate(windows):
                for p, other in at.get(w, ()):
                    shifts[p - q].append((q, [(place, mine, theirs) for (place, mine), (_, theirs) in zip(slots, other, strict=True)]))
            places, changed = set(), False
            for met in shifts.values():
                values = {place: (mine, theirs) for _, slots in met for place, mine, theirs in slots}
                pairs, mine, theirs = Counter(values.values()), Counter(a for a, _ in values.values()), Counter(b for _, b in values.values())
                for q, slots in met:
                    same = all(a == b for _, a, b in slots)
                    if same or all(2 * pairs[a, b] > mine[a] and 2 * pairs[a, b] > theirs[b] for _, a, b in slots):
                        places.add(q)
                        changed |= not same
            if windows and places and 100 * len(places) >= T.SHARE * len(windows):
                out.append((doc_id, item_id, len(places), len(windows), "reparameterised" if changed else "verbatim"))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.item_id, r.n_windows, r.item_windows, r.kind) for r in df.collect()), key=repr)


def test_query_against_plain_scan(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = rows(T.op1_template_join(spark, SF))
    assert got == brute(docs, items) and got


def test_made_up_rows(spark):
    items = [(1, "A train leaves for Paris at 9 and runs 120 km until 11 while Anna waits for 120 minutes."), (2, "too few words here"), (3, None), (None, "Is the sum of two and 17 equal to nineteen or not?"),
             (1, "The red fox jumps over the lazy dog near the river bank.")]
    docs = [(1, "x. A train leaves for Paris at 9 and runs 120 km until 11 while Anna waits for 120 minutes. y"),
            (2, "x. A train leaves for Rome at 7 and runs 300 km until 10 while Bert waits for 300 minutes. y"),
            (3, "x. A train leaves for Rome at 7 and runs 300 km until 10 while Bert waits for 41 minutes. y"),
            (4, None), (5, ""), (6, "too few words here"), (None, "say: Is the sum of two and 17 equal to nineteen or not? yes"),
            (7, "the red fox jumps over the lazy dog near"), (8, "10 20 30 40 50 60 70 80 90 100 " * 50), (1, "The red fox jumps over the lazy dog near the river bank."), (9, "word " * 30000)]
    a = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, kind string, item_id int")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, row int")
    got = rows(T.leaks(a, b))
    assert got == brute(docs, items)
    kinds = {(r[0], r[1]): r[4] for r in got}
    assert kinds[1, 1] == "verbatim" and kinds[2, 1] == "reparameterised" and (3, 1) not in kinds
    left = T.drop_contaminated(a, b)
    assert left.columns == a.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert T.leaks(a.limit(0), b).count() == T.leaks(a, b.limit(0)).count() == 0


def test_values_by_majority(spark):
    """Random fillings of one text: values that change together, some places that don't, two values that become one."""
    rng = random.Random(4)
    text = "first add {0} and {1} then take {0} from {2} and {1} from {0} so that {2} stands beside {1} in row {0} of {2} of it"
    items = [(1, text.format(3, 5, 8)), (2, text.format(7, 7, 9))]
    docs = []
    for i in range(40):
        words = text.format(*(rng.choice(["3", "4", "41", "7"]) for _ in range(3))).split()
        for k, w in enumerate(words):
            if w[0].isdigit() and rng.random() < i / 100:
                words[k] = str(rng.randrange(60, 64))
        docs.append((i, "lead " * (i % 4) + " ".join(words)))
    stored = lambda rows_, name: spark.createDataFrame(rows_, f"{name} long, text string")
    got = rows(T.leaks(stored(docs, "doc_id"), stored(items, "item_id")))
    want = brute(docs, items)
    assert got == want and len({r[2] for r in want}) > 1
