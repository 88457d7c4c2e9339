"""Near-duplicate components against all pairs of shingle sets."""

import random
import re
from collections import defaultdict

from linklens.llm import op5_hamming_join as H

SF = "/root/testdata/sf0.01"


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if len(words) >= n else frozenset([tuple(words)])


def brute(docs, n=4):
    sets = [shingles(t, n) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = set()
    for group in holders.values():
        for k, i in enumerate(group):
            for j in group[k + 1:]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        up[root(j)] = root(i)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(docs))


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = H.op5_hamming_join(spark, SF)
    assert rows(got) == brute(docs)


def test_made_up_rows(spark):
    rng = random.Random(5)
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A B"), (6, "a b c"), (7, "a b c d"), (8, "x " * 500), (9, "X " * 900)]
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    for i in range(120):  # a group of near copies, some of them linked through others only
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 8])):
            words[rng.randrange(200)] = f"n{rng.randrange(10**6)}"
        docs.append((100 + i, " ".join(words)))
    docs += [(400 + i, " ".join(base[:60] + [f"u{rng.randrange(10**6)}" for _ in range(80)])) for i in range(40)]
    docs.append((100, docs[9][1]))
    stored = spark.createDataFrame([(i, t, 1, b"x") for i, t in docs], "doc_id long, text string, comp int, signature binary")
    groups = H.near_groups(stored, 4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in groups) == brute(docs)
    assert sorted(r.doc_id for r in groups if r.stays) == sorted({c for _, _, c in brute(docs)})


def test_no_rows_and_columns_kept(spark):
    stored = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9)], "doc_id long, text string, row int")
    assert H.near_groups(stored.limit(0)).count() == 0
    assert sorted(H.drop_near_copies(stored).collect()) == [(1, "a b c d e f", 7), (3, None, 9)]


def family(rng, members, common, own):
    """Texts that share `common` words at their end, each after `own` words of its own."""
    tail = [f"c{rng.randrange(10**9)}" for _ in range(common)]
    return [" ".join([f"o{rng.randrange(10**9)}" for _ in range(own)] + tail) for _ in range(members)]


def test_members_of_a_family_that_are_not_alike_enough_do_not_meet(spark, monkeypatch):
    """Similarity 0.73 and 0.78: the signatures share keys, and a pair-wise comparison would meet 80,000 pairs."""
    rng = random.Random(11)
    met = []
    prefix_pairs = H.prefix_pairs
    monkeypatch.setattr(H, "prefix_pairs", lambda tokens, nodes: (lambda p: (met.append((nodes.count(), p.count())), p)[1])(prefix_pairs(tokens, nodes)))
    texts = family(rng, 400, 300, 55) + family(rng, 400, 300, 40)
    docs = list(enumerate(texts))
    groups = H.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert len({r.component_id for r in groups}) == len(docs)
    (nodes, pairs), = met
    assert nodes > 300 and pairs < nodes


def test_pairs_just_above_the_threshold_are_linked(spark):
    """As close above 0.8 as the length allows, among others that are just below it."""
    rng = random.Random(12)
    docs, linked = [], 0
    for i in range(600):
        n = rng.randrange(40, 400)
        a = [f"a{i}x{k}" for k in range(n)]
        shingles_ = n - 3
        # k words changed at the end lose k shingles of both: (s - k) / (s + k) >= 0.8
        k = shingles_ // 9 + (i % 3 == 0)
        b = a[:n - k] + [f"b{i}x{j}" for j in range(k)]
        linked += 100 * (shingles_ - k) >= 80 * (shingles_ + k)
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    groups = H.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect()
    assert 390 < linked < 410
    assert sum(r.doc_id != r.component_id for r in groups) == linked
    assert rows(spark.createDataFrame(groups)) == brute(docs)


def test_links_through_a_chain_of_near_copies(spark):
    """Each text is near to its neighbours only; families between them share the same common words."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(200)]
    docs = [(0, " ".join(words))]
    for i in range(1, 60):
        at = rng.randrange(180)
        words = words[:at] + [f"n{i}x{j}" for j in range(rng.choice([4, 8, 12, 16]))] + words[at + 10:]
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, t) for i, t in enumerate(family(rng, 60, 100, 12) + family(rng, 60, 100, 30))]
    groups = spark.createDataFrame(H.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), 4).collect())
    assert rows(groups) == brute(docs)
