"""Repair of a conversation's structure at least cost, with an audit of the edits.

Every turn of a conversation, in order, gets one edit: Keep (free), Rerole to user or
assistant (3) or Delete (4; blank turns and repetitions must go).  Empty turns of user
or assistant may be Inserted anywhere (3 each), and a truncated turn that stays costs 3
more.  The initials of the roles that result must read `(s?(ua)+)?`.  Of the cheapest
sequences of edits the one whose initials are least in ASCII is taken.

This is a shortest path in an acyclic graph of (turn, state of the automaton), decided
by one comparison of integers: the high digits of a path's weight are its cost, and
below them the initials follow from the left as digits of three bits (D < I < K < R),
with zeros behind the last one.  Paths that meet in a node have used up the same turns,
and each ends with the edit of a turn, so neither's initials can be the beginning of
the other's; the common rest therefore doesn't change their order, and the minimum in
each node is enough.  After `BLOCK` turns the initials of the four states are replaced
by their rank, one digit, which keeps weights short and the work linear in the length.

Faults of a turn, the first that holds: blank (nothing but white space), duplicate
(role and text of an earlier turn), truncated (doesn't end with `.`, `!` or `?`).

Turns are dealt by conversation, sorted and flagged by Spark, and streamed through the
decision; a conversation's texts are held up to `HELD` bytes.  Of longer ones only four
bytes a turn are held: their edits are written out, joined with the turns, and the
repaired text is streamed into its digest.  The digest of one conversation is sequential
by its definition, so one task reads a conversation's turns, in bounded pieces.

Defined results: null conv_ids are one conversation; a null turn comes first; a null
role or text is one space; turns of one number are ordered by role, then text, and equal
rows are turns of their own; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linklens.llm import common as C

#: States: nothing yet, or the initial of the last role; legal next initials; states a conversation may end in.
START, S, U, A = range(4)
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
FINAL = (START, A)
LEGAL = {"su", "ua", "au"}
NAMES = {U: "user", A: "assistant"}
#: Costs of the edits, and of a truncated turn that stays.
RETYPED, DELETED, INSERTED, CUT_OFF = 3, 4, 3, 3
#: Digits of the initials; zero is the end.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {d: x for x, d in DIGIT.items()}
#: Turns after which initials become a rank; digits of a weight's low part: the rank, three a turn, two at the end.
BLOCK = 32
WIDTH = 1 + 3 * BLOCK + 2
#: Bytes of text of one conversation that are held.
HELD = 8 << 20
#: Faults.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
WHITE = " \t\n\x0b\x0c\r"
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, at long, edit string, new_role string, before string, after string"


def inserts() -> dict[int, list[tuple[int, int]]]:
    """For each state the states that fewest empty turns lead to, with their number."""
    out = {}
    for s in NEXT:
        reached, at, n = [(s, 0)], s, 0
        while True:
            at, n = next(t for x, t in NEXT[at].items() if x != "s"), n + 1
            if at in [t for t, _ in reached]:
                break
            reached.append((at, n))
        out[s] = reached
    return out


EMPTY = inserts()


def steps(initial: str, fault: int) -> list[tuple[int, int, int, int, int, int]]:
    """Edges over one turn: state before, state after, inserted turns, cost, digits of the initials, letter."""
    out = []
    for s, reached in EMPTY.items():
        for t, n in reached:
            digits = int("0" + "2" * n, 8)
            out.append((s, t, n, INSERTED * n + DELETED, digits * 8 + DIGIT["D"], DIGIT["D"]))
            if fault in (BLANK, DUPLICATE):
                continue
            stays = INSERTED * n + (CUT_OFF if fault == TRUNCATED else 0)
            for x, to in NEXT[t].items():
                if x == initial:
                    out.append((s, to, n, stays, digits * 8 + DIGIT["K"], DIGIT["K"]))
                if to in NAMES:
                    out.append((s, to, n, stays + RETYPED, digits * 8 + DIGIT["R"], DIGIT["R"]))
    return out


STEPS = {(x, fault): steps(x, fault) for x in ("s", "u", "a", "") for fault in range(4)}


class Path:
    """The cheapest path over the turns so far to each state; four bytes are kept for a turn."""

    def __init__(self):
        self.weight: list[int | None] = [0, None, None, None]
        self.used = [0, 0, 0, 0]
        self.base, self.turns = 0, 0
        self.came = bytearray()

    def add(self, initial: str, fault: int) -> None:
        if self.turns and self.turns % BLOCK == 0:
            self.rank()
        weight: list[int | None] = [None] * 4
        used, came = [0] * 4, [0] * 4
        for s, t, n, cost, digits, letter in STEPS[initial if initial in "sua" else "", fault]:
            w = self.weight[s]
            if w is None:
                continue
            length = self.used[s] + n + 1
            w += (cost << 3 * WIDTH) + (digits << 3 * (WIDTH - length))
            if weight[t] is None or w < weight[t]:
                weight[t], used[t], came[t] = w, length, s | n << 2 | letter << 4
        self.weight, self.used = weight, used
        self.came += bytes(came)
        self.turns += 1

    def rank(self) -> None:
        """Initials so far become one digit: their place among those of the states."""
        low = (1 << 3 * WIDTH) - 1
        order = sorted({w & low for w in self.weight if w is not None})
        least = min(w >> 3 * WIDTH for w in self.weight if w is not None)
        self.base += least
        self.weight = [None if w is None else ((w >> 3 * WIDTH) - least << 3 * WIDTH) + (order.index(w & low) + 1 << 3 * (WIDTH - 1)) for w in self.weight]
        self.used = [1] * 4

    def finish(self) -> tuple[int, list[tuple[str, int, int, int]], int, int]:
        """Cost; edit, state before, inserted turns, state after of each turn; the last state and the turns inserted after it."""
        best = None
        for s, w in enumerate(self.weight):
            for t, n in EMPTY[s]:
                if w is not None and t in FINAL:
                    end = w + (INSERTED * n << 3 * WIDTH) + (int("0" + "2" * n, 8) << 3 * (WIDTH - self.used[s] - n))
                    if best is None or end < best[0]:
                        best = end, s, n
        weight, state, tail = best
        last, edits = state, []
        for i in range(self.turns - 1, -1, -1):
            code = self.came[4 * i + state]
            edits.append((LETTER[code >> 4], code & 3, code >> 2 & 3, state))
            state = code & 3
        edits.reverse()
        return self.base + (weight >> 3 * WIDTH), edits, last, tail


def inserted_roles(state: int, n: int) -> list[str]:
    out = []
    for _ in range(n):
        state = next(t for x, t in NEXT[state].items() if x != "s")
        out.append(NAMES[state])
    return out


def planned(path: Path) -> tuple[int, str, list[tuple[str, str | None, list[str]]], list[str]]:
    """Cost, audit, for each turn its edit, new role (null: its own) and the roles inserted before it; the roles inserted at the end."""
    cost, edits, last, tail = path.finish()
    audit = "".join("I" * n + letter for letter, _, n, _ in edits) + "I" * tail
    return cost, audit, [(letter, NAMES[after] if letter == "R" else None, inserted_roles(before, n)) for letter, before, n, after in edits], inserted_roles(last, tail)


class Conversation:
    """What is counted of one conversation while its turns go by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.path = conv_id, Path()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.held: list[tuple[str, str]] | None = []
        self.size = 0

    def add(self, turn: int | None, role: str, fault: int, text: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        self.faults[fault] += 1
        self.path.add(role[:1], fault)
        if self.held is not None:
            self.size += len(text or "") + len(role) + 150
            self.held.append((role, text or ""))
            if self.size > HELD:
                self.held = None

    def summary(self) -> tuple:
        """A row of SUMMARY; the digest is null if the texts were too long to be held."""
        cost, audit, edits, tail = planned(self.path)
        digest = None
        if self.held is not None:
            lines = []
            for (letter, role, before), (own, text) in zip(edits, self.held, strict=True):
                lines += [f"{r}:" for r in before]
                if letter != "D":
                    lines.append(f"{role or own}:{text}")
            lines += [f"{r}:" for r in tail]
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit, digest


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def conversations_of(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[Conversation]:
    """Consecutive turns of one conv_id; a dropped turn only makes its conversation known."""
    now = None
    names = ["conv_id", "turn", "role", "fault", "dropped"] + ["text"] * texts
    for batch in batches:
        # turn by turn into Python, so that a batch of long texts isn't held twice
        for at in range(0, batch.num_rows, 256):
            few = batch.slice(at, 256)
            for conv_id, turn, role, fault, dropped, *text in zip(*(few.column(n).to_pylist() for n in names), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now
                    now = Conversation(conv_id)
                    if not texts:
                        now.held = None
                if not dropped:
                    now.add(turn, role, fault, *(text or [None]))
    if now is not None:
        yield now


def summary_batches(batches: Iterator[pa.RecordBatch], texts: bool = True) -> Iterator[pa.RecordBatch]:
    rows = []
    for conversation in conversations_of(batches, texts):
        rows.append(conversation.summary())
        if len(rows) >= 1000 or len(rows[-1][7]) > 100_000:
            yield arrow(rows, SUMMARY)
            rows.clear()
    yield arrow(rows, SUMMARY)


def edit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for conversation in conversations_of(batches, False):
        _, _, edits, tail = planned(conversation.path)
        for at, (letter, role, before) in enumerate(edits, 1):
            rows.append((conversation.conv_id, at, letter, role, ",".join(before), ",".join(tail) if at == len(edits) else ""))
            if len(rows) >= 5000:
                yield arrow(rows, EDITS)
                rows.clear()
    yield arrow(rows, EDITS)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation of consecutive rows, from lines in order."""
    conv_id, digest, any_, rows = None, None, False, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if digest is None or conv != conv_id:
                if digest is not None:
                    rows.append((conv_id, digest.hexdigest()))
                conv_id, digest, any_ = conv, hashlib.sha256(), False
            if role is not None:
                digest.update(("\n" * any_ + f"{role}:{text}").encode())
                any_ = True
    if digest is not None:
        rows.append((conv_id, digest.hexdigest()))
    yield arrow(rows, "conv_id long, digest string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, dropped: one turn in twenty is dropped, emptied, cut off, repeated or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    dropped = F.col("kind") == 0
    text = F.when(dropped | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), dropped.alias("dropped"))


def order() -> list[Column]:
    return [F.col("dropped"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def flagged(turns: DataFrame) -> DataFrame:
    """The turns with fault and place, dealt by conversation and sorted; the texts are shuffled once."""
    ending = F.rtrim(F.col("text"), F.lit(WHITE))
    dealt = turns.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = F.when(ending == "", BLANK).when(again, DUPLICATE).when(~F.substring(ending, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    placed = dealt.withColumn("fault", fault).withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order())).cast("long"))
    return placed.sortWithinPartitions("conv_id", *order())  # the optimizer may run the windows the other way round


def plain(turns: DataFrame) -> DataFrame:
    """Stored turns as they are, in the columns of `damaged`."""
    space = F.lit(" ")
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("dropped"))


def edits(turns: DataFrame) -> DataFrame:
    """One row per turn of the columns of `damaged`: its edit, its new role, and the roles inserted before and, at the end, after it."""
    rows = flagged(turns).where("not dropped").sortWithinPartitions("conv_id", "at").select("conv_id", "turn", "role", "fault", "dropped")
    return rows.mapInArrow(edit_batches, EDITS)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at, part, role, text: the repaired turns, in the order of conv_id, at, part.

    A conversation of which nothing is left has one row with a null role.
    """
    found = C.stored(edits(turns), "edits")
    rows = flagged(turns).alias("t").join(found.alias("e"), F.expr("t.conv_id <=> e.conv_id and t.at = e.at and not t.dropped"), "left")
    lines = lambda column: F.transform(F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda r: r != ""), lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    nothing = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    own = F.struct(F.coalesce("e.new_role", "t.role").alias("role"), F.col("t.text").alias("text"))
    middle = F.when(F.col("edit").isNull() | (F.col("edit") == "D"), F.array(nothing)).otherwise(F.array(own))
    exploded = rows.select("t.conv_id", "t.at", F.posexplode(F.concat(lines(F.col("before")), middle, lines(F.col("after")))).alias("part", "line"))
    return exploded.select("conv_id", "at", "part", "line.*")


def summaries(turns: DataFrame) -> DataFrame:
    """One row of SUMMARY for each conversation of turns in the columns of `damaged`."""
    first = C.stored(flagged(turns).mapInArrow(summary_batches, SUMMARY), "conversations")
    long = first.where("repaired_sha256 is null").select("conv_id")
    if long.isEmpty():
        return first
    # null-safe: the turns without a conv_id may be the long conversation
    theirs = turns.alias("t").join(long.alias("l"), F.expr("t.conv_id <=> l.conv_id"), "left_semi")
    lines = repaired_turns(theirs).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    digests = C.stored(lines.mapInArrow(digest_batches, "conv_id long, digest string"), "digests")
    both = first.alias("f").join(digests.alias("d"), F.expr("f.conv_id <=> d.conv_id"), "left")
    return both.select(*[F.col(f"f.{c}") for c in first.columns[:-1]], F.coalesce("f.repaired_sha256", "d.digest").alias("repaired_sha256"))


def op12_audited_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(damaged(C.table(spark, sf_dir, "conversations")))


QUERIES = {"op12_audited_repair": op12_audited_repair}
ORACLES: dict[str, str] = {}
