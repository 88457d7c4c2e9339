"""Turns that are merged over partition borders, and results that don't depend on the partitions."""

import random
from itertools import groupby

from linklens.llm import op7_role_repair as R
from tests.llm.test_op7 import legal


def outcome(spark, stored, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = R.repaired(stored).drop("part").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_same_for_all_partitions(spark):
    rng = random.Random(5)
    kinds = ["user", "assistant", "system", "tool", None]
    rows = [(1, i, rng.choice(kinds), f"t{i}") for i in range(300)] + [(2, i, "user", f"u{i}") for i in range(200)]
    rows += [(None, i, rng.choice(kinds[:2]), f"n{i}") for i in range(200)] + [(c, i, rng.choice(kinds), None) for c in range(3, 30) for i in range(4)]
    stored = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    one = outcome(spark, stored, 1)
    for parts in (3, 40):
        assert outcome(spark, stored, parts) == one
    for conv, turns in groupby(one, key=lambda r: r[0]):
        turns = list(turns)
        assert legal([r[2] for r in turns]) and [r[1] for r in turns] == list(range(len(turns)))
        assert not any(r[6].startswith("merge") for r in turns)
    merged = next(r for r in one if r[0] == 2 and r[5] == 200)
    assert merged[3] == "\n".join(f"u{i}" for i in range(200))


def test_pieces_choose_as_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        roles = [rng.randrange(4) for _ in range(rng.randrange(2, 14))]
        cuts = sorted(rng.sample(range(1, len(roles)), rng.randrange(1, min(4, len(roles)))))
        cut = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)], strict=True)]
        edges = [Edge(7, k, 0, *(x.ravel().tolist() for x in R.transfer(piece))) for k, piece in enumerate(cut)]
        known, got, turns = R.decided(edges), [], 0
        for k, piece in enumerate(cut):
            begin, end, offset = known[k, 7]
            assert offset == turns
            actions = [(a, role) for a, role, _ in R.repair(piece, begin, end)[0]]
            turns += sum(a != "merge" for a, _ in actions)
            got += actions
        assert got == [(a, role) for a, role, _ in R.repair(roles)[0]]


class Edge:
    def __init__(self, conv_id, part, number, costs, made, ranks):
        self.conv_id, self.part, self.number, self.costs, self.made, self.ranks = conv_id, part, number, costs, made, ranks
