"""Repairs against an exhaustive search, and conversations cut over many partitions."""

import heapq
import random
from itertools import groupby

from linklens.llm import op7_role_repair as R

SF = "/root/testdata/sf0.01"


def least(roles):
    """Dijkstra over (turns read, state): an independent search for the least cost."""
    heap, done = [(0.0, 0, 0)], set()
    while heap:
        cost, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(roles) and s == R.FINAL:
            return cost
        for b in R.NEXT[s]:
            heapq.heappush(heap, (cost + R.INSERT + R.TURN, i, b))
            if i < len(roles):
                heapq.heappush(heap, (cost + R.TURN + (b != roles[i]) * R.RELABEL, i + 1, b))
        if i < len(roles) and s:
            heapq.heappush(heap, (cost + R.MERGE + (s != roles[i]) * R.RELABEL, i + 1, s))


def cost_of(actions, roles):
    price = {"keep": R.TURN, "relabel": R.RELABEL + R.TURN, "insert": R.INSERT + R.TURN}
    return sum(R.MERGE + (role != roles[i]) * R.RELABEL if a == "merge" else price[a] for a, role, i in actions)


def legal(roles):
    state = 0
    for r in roles:
        b = R.STATES.index(r)
        if b not in R.NEXT[state]:
            return False
        state = b
    return state == R.FINAL


def test_least_cost():
    rng = random.Random(1)
    for _ in range(400):
        roles = [rng.randrange(4) for _ in range(rng.randrange(9))]
        actions, _ = R.repair(roles)
        assert abs(cost_of(actions, roles) - least(roles)) < 1e-9
        assert [i for _, _, i in actions if i >= 0] == list(range(len(roles)))


def check(rows, stored):
    got = sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.part, r.piece))
    seen = {}
    for conv, turns in groupby(got, key=lambda r: r.conv_id):
        seen[conv] = list(turns)
    assert set(seen) == {r[0] for r in stored}
    for conv, turns in seen.items():
        own = sorted((r for r in stored if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        roles, texts = [], []
        for r in turns:
            if r.action.startswith("merge"):
                assert roles and roles[-1] == r.role
            else:
                roles.append(r.role)
            texts += [] if r.action == "insert" else r.text.split("\n") if r.n_merged > 1 else [r.text]
            assert r.rendered == f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n"
        assert legal(roles)
        assert "\n".join(texts).split("\n") == "\n".join(r[3] or "" for r in own).split("\n") or not own
        price = {"keep": R.TURN, "relabel": R.RELABEL + R.TURN, "insert": R.INSERT + R.TURN, "merge": R.MERGE}
        numbers = [R.role_number(r[2]) for r in own]
        base = sum(price[a] for r in turns for a in r.action.split())
        assert base <= least(numbers) + 1e-9  # merges of other roles cost a relabelling more


def test_query(spark):
    stored = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(R.op7_role_repair(spark, SF).collect(), stored)


def test_made_up_rows(spark):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "tool", None, " User "]), f"t{i}") for i in range(500)]  # crosses partitions
    rows += [(c, i, rng.choice(["user", "assistant"]), f"c{c}-{i}") for c in range(2, 40) for i in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", None), (None, None, "assistant", "x"), (50, 1, "user", "same"), (50, 1, "user", "same"), (51, 0, "user", "long " * 50000)]
    stored = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn int, role string, text string, part int, rendered string")
    got = R.repaired(stored)
    check(got.collect(), rows)
    assert len({r.part for r in got.collect() if r.conv_id == 1}) > 1
    assert R.repaired(stored.limit(0)).count() == 0
