"""Repairs against enumeration of all edits, and the query against a plain model of its rules."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from linklens.llm import op12_audited_repair as R

SF = "/root/testdata/sf0.01"
LEGAL = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        ending = text.rstrip(BLANKS)
        out.append(R.BLANK if not ending else R.DUPLICATE if (role, text) in seen else R.TRUNCATED if ending[-1] not in ".!?" else R.NONE)
        seen.add((role, text))
    return out


def all_edits(turns, found):
    """Cheapest by trying everything: up to two empty turns in each gap."""
    gaps = [g for n in range(3) for g in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def options(i):
        _, role, _ = turns[i]
        yield 4, "D", None
        if found[i] not in (R.BLANK, R.DUPLICATE):
            more = 3 if found[i] == R.TRUNCATED else 0
            yield more, "K", role
            for r in ("user", "assistant"):
                yield more + 3, "R", r

    for inserted in itertools.product(gaps, repeat=len(turns) + 1):
        for chosen in itertools.product(*(list(options(i)) for i in range(len(turns)))):
            cost, audit, roles = 0, "", []
            for i, g in enumerate(inserted):
                cost, audit = cost + 3 * len(g), audit + "I" * len(g)
                roles += [(r, "") for r in g]
                if i < len(turns):
                    c, letter, r = chosen[i]
                    cost, audit = cost + c, audit + letter
                    roles += [] if r is None else [(r, turns[i][2])]
            if (best is None or (cost, audit) < best[:2]) and LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in roles)):
                best = cost, audit, roles
    return best


def by_tuples(turns, found):
    """Cheapest by a search over (turn, initials so far as far as they matter) with tuples (cost, audit)."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, roles = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(unrolled(roles))
        if (i, state) in done:
            continue
        done.add((i, state))
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for r in ("user", "assistant"):
            if r[0] in allowed:
                heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (roles, (r, ""))))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, roles))
            if found[i] not in (R.BLANK, R.DUPLICATE):
                more = 3 if found[i] == R.TRUNCATED else 0
                if role[:1] and role[:1] in allowed:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (roles, (role, text))))
                for r in ("user", "assistant"):
                    if r[0] in allowed:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, r[0], (roles, (r, text))))


def unrolled(roles):
    out = []
    while roles:
        roles, one = roles
        out.append(one)
    return reversed(out)


def model(rows):
    out = {}
    for conv, turns in damage(rows).items():
        found = faults(turns)
        cost, audit, lines = by_tuples(turns, found)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        out[conv] = (gaps, *(found.count(f) for f in (R.BLANK, R.DUPLICATE, R.TRUNCATED)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def results(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def decided(turns, found):
    path = R.Path()
    for (_, role, _), fault in zip(turns, found, strict=True):
        path.add(role[:1], fault)
    cost, audit, edits, tail = R.planned(path)
    lines = []
    for (letter, role, before), (_, own, text) in zip(edits, turns, strict=True):
        lines += [(r, "") for r in before] + ([] if letter == "D" else [(role or own, text)])
    return cost, audit, lines + [(r, "") for r in tail]


ROLES = ["user", "assistant", "system", "tool", " ", "", "ultra"]


def random_turns(rng, n):
    return [(i, rng.choice(ROLES), rng.choice(["a.", "b", "", "c!", "a."])) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_against_all_edits(n):
    rng = random.Random(n)
    for _ in range(25):
        turns = random_turns(rng, n)
        found = faults(turns)
        want = all_edits(turns, found)
        assert decided(turns, found) == want
        assert by_tuples(turns, found) == want


def test_against_all_edits_of_three_turns():
    rng = random.Random(3)
    for _ in range(3):
        turns = random_turns(rng, 3)
        assert decided(turns, faults(turns)) == all_edits(turns, faults(turns))


def test_long_ones_against_tuples():
    """Ties have to be broken alike over many blocks."""
    rng = random.Random(4)
    for n in (5, 31, 32, 33, 64, 65, 200, 300):
        for _ in range(6):
            turns = [(i, r, f"{i}" + rng.choice([".", "."])) for i, r in enumerate(rng.choice(ROLES[:3] if _ % 2 else ROLES[:2]) for _ in range(n))]
            found = [rng.choice([R.NONE, R.NONE, R.TRUNCATED, R.BLANK]) for _ in range(n)]
            assert decided(turns, found) == by_tuples(turns, found)


def test_query_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(R.op12_audited_repair(spark, SF)) == model(rows)


SCHEMA = "text string, conv_id long, turn long, role string, fault string, at int, dropped string"


def odd_rows():
    rng = random.Random(9)
    rows = [(c, t, rng.choice([*ROLES, None]), rng.choice(["x.", "x.", "y", "", "\t\r\n", None, "z? \n", "é"]))
            for c in [None, 1, 2, 3, -4, 2**40] for t in [None, None, 0, 1, 1, 2, 5, 9, 11, 12, 13, 14, 15, 16, 17] for _ in range(rng.choice([1, 1, 2]))]
    dropped = next(t for t in range(1000) if zlib.crc32(f"77:{t}".encode()) % 20 == 0)
    return [*rows, (77, dropped, "user", "gone."), (78, None, None, None)]


def test_odd_tables(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(x, c, t, r, "?", 1, "?") for c, t, r, x in rows], SCHEMA)
    got = results(R.summaries(R.damaged(df)))
    assert got == model(rows)
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert results(R.summaries(R.damaged(df.limit(0)))) == {}


def test_texts_too_long_to_hold(spark, monkeypatch):
    """The same digests by way of stored edits."""
    rows = odd_rows() + [(5, t, ("user", "assistant")[t % 3 % 2], "w" * (t * 37 % 900) + ".") for t in range(300)]
    df = spark.createDataFrame([(x, c, t, r, "?", 1, "?") for c, t, r, x in rows], SCHEMA)
    want = model(rows)
    monkeypatch.setattr(R, "HELD", 400)
    assert results(R.summaries(R.damaged(df))) == want
    lines = {}
    for r in R.repaired_turns(R.damaged(df)).orderBy("conv_id", "at", "part").collect():
        lines.setdefault(r.conv_id, []).extend([] if r.role is None else [f"{r.role}:{r.text}"])
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: x[-1] for c, x in want.items()}
