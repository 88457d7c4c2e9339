"""Chat formatting with a minimum-cost repair of the turns' roles.

Legal conversations are those of a small automaton: an optional system turn, then
user and assistant in alternation, beginning with the user and ending with the
assistant.  Each stored turn is kept, relabelled, or merged into the turn before it if
that has the role it is read as; where a role is missing an empty turn is inserted.
Every action has a cost, and dynamic programming over the automaton's states finds the
sequence of least cost, of those the one with fewest turns.  The repaired turns are
rendered one row each; a conversation's text is its rows in order.

Conversations are ranged by (conv_id, turn), so that one conversation of any length
spreads over partitions.  A partition's first and last conversation may go on outside
it: the costs from every state to every state of these two pieces, a matrix of fixed
size, are chained between partitions (two rows for each partition reach the driver),
and each piece is then repaired between the states that the chain decided.  Output
turns are numbered over the whole conversation; where a piece begins with a merge its
first row has the number of the turn before, and rows of one number at a border are
joined.  Costs are whole numbers and ties are broken alike in a piece and in the whole,
so all columns but `part`, where a turn begins, are the same for any partitions.

Defined results: turns are ordered by turn (null first), then role, then text; a null
text is empty; a role is lower-cased and trimmed, and a null or unknown one costs a
relabelling whatever it is read as; repeated rows are turns of their own; turns with a
null conv_id are one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
STATES = ("start", *ROLES)
FINAL = 3
#: Costs; a turn of the output costs a little, so that ties go to fewer turns.
RELABEL, MERGE, INSERT, TURN = 4.0, 1.0, 3.0, 1e-6
#: Legal next roles of each state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: The same in units of TURN: sums of whole numbers don't depend on their order.
RELABEL_U, MERGE_U, INSERT_U, TURN_U = (float(round(x / TURN)) for x in (RELABEL, MERGE, INSERT, TURN))
OUT = "conv_id long, part int, piece long, role string, text string, first_turn long, n_merged int, action string, border boolean"


def insertions() -> tuple[np.ndarray, dict[tuple[int, int], list[int]]]:
    """Least cost of reaching each state from each by empty turns alone, and those turns."""
    n = len(STATES)
    cost, path = np.full((n, n), np.inf), {}
    for s in range(n):
        cost[s, s], path[s, s] = 0.0, []
        front = [s]
        while front:
            a = front.pop(0)
            for b in NEXT[a]:
                if cost[s, a] + INSERT_U + TURN_U < cost[s, b]:
                    cost[s, b], path[s, b] = cost[s, a] + INSERT_U + TURN_U, [*path[s, a], b]
                    front.append(b)
    return cost, path


EMPTY, EMPTY_PATH = insertions()


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return STATES.index(name) if name in ROLES else 0


def step_costs(role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost from state to state over one stored turn, the state before the turn itself (-1: merged), and the output turns made."""
    n = len(STATES)
    cost, before, made = np.full((n, n), np.inf), np.full((n, n), -1), np.zeros((n, n), dtype=np.int64)
    for s in range(n):
        for b in range(1, n):
            change = 0.0 if b == role else RELABEL_U
            if s == b:
                cost[s, b] = MERGE_U + change
            for a in range(n):
                if b in NEXT[a] and EMPTY[s, a] + change + TURN_U < cost[s, b]:
                    cost[s, b], before[s, b], made[s, b] = EMPTY[s, a] + change + TURN_U, a, 1 + len(EMPTY_PATH[s, a])
    return cost, before, made


STEPS = [step_costs(r) for r in range(len(STATES))]


def transfer(roles: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From every state before some turns to every state after them: least cost, output turns made, and rank.

    The rank orders the paths that come from different states to the same one as
    repair() would choose among them if they cost the same: the lower state at the last
    turn where they differ.
    """
    n = len(STATES)
    row, column = np.arange(n)[:, None], np.arange(n)[None]
    total, made, rank = np.where(row == column, 0.0, np.inf), np.zeros((n, n), dtype=np.int64), np.repeat(row, n, axis=1)
    for r in roles:
        cost, _, more = STEPS[r]
        both = total[:, :, None] + cost[None]
        came = both.argmin(axis=1)
        total, made = both.min(axis=1), made[row, came] + more[came, column]
        key = came * n + rank[row, came]
        rank = (key[None] < key[:, None]).sum(axis=1)
    return total, made, rank


def repair(roles: list[int], begin: int = 0, end: int | None = None) -> tuple[list[tuple[str, int, int]], int]:
    """Actions of least cost (action, role, stored turn or -1) from state `begin`, and the state after them.

    With `end` the state after the last stored turn is given; without it the
    conversation is closed by empty turns.
    """
    n = len(STATES)
    cost = np.full(n, np.inf)
    cost[begin] = 0.0
    came = []
    for r in roles:
        both = cost[:, None] + STEPS[r][0]
        came.append(both.argmin(axis=0))
        cost = both.min(axis=0)
    state = int((cost + EMPTY[:, FINAL]).argmin()) if end is None else end
    last, out = state, []
    for i in range(len(roles) - 1, -1, -1):
        s = int(came[i][state])
        a = int(STEPS[roles[i]][1][s, state])
        changed = state != roles[i]
        if a < 0:
            out.append(("merge", state, i))
        else:
            out.append(("relabel" if changed else "keep", state, i))
            out += [("insert", b, -1) for b in reversed(EMPTY_PATH[s, a])]
        state = s
    out.reverse()
    if end is None:
        out += [("insert", b, -1) for b in EMPTY_PATH[last, FINAL]]
    return out, last


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Consecutive turns of one conversation in a partition, as (role, text, turn)."""
    conv, held, any_ = None, [], False
    for batch in batches:
        for c, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text")), strict=True):
            if any_ and c != conv:
                yield conv, held
                held = []
            conv, any_ = c, True
            held.append((role, text, turn))
    if any_:
        yield conv, held


def edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of a partition's first and last piece."""
    def watched() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and not parts:
                parts.append(batch.column("part")[0].as_py())
            yield batch

    parts: list[int] = []
    first = last = None
    for number, (conv, turns) in enumerate(pieces(watched())):
        last = number, conv, [role_number(r) for r, _, _ in turns]
        first = first or last
    rows = [] if first is None else [first] if first[0] == last[0] else [first, last]
    tables = [[x.ravel().tolist() for x in transfer(roles)] for _, _, roles in rows]
    costs, made, ranks = zip(*tables, strict=True) if tables else ([], [], [])
    yield pa.RecordBatch.from_arrays([pa.array([c for _, c, _ in rows], pa.int64()), pa.array(parts * len(rows), pa.int32()), pa.array([n for n, _, _ in rows], pa.int64()),
                                      pa.array(costs, pa.list_(pa.float64())), pa.array(made, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int64()))],
                                     names=["conv_id", "part", "number", "costs", "made", "ranks"])


def decided(edges: list) -> dict[tuple[int, int | None], tuple[int, int | None, int]]:
    """By part and conv_id of each piece of the conversations that cross partitions: states before and after it (None after the last), output turns before it."""
    n = len(STATES)
    square = lambda x: np.array(x).reshape(n, n)
    chains: dict[int | None, list] = {}
    for e in sorted(edges, key=lambda e: (e.part, e.number)):
        chains.setdefault(e.conv_id, []).append(e)
    out = {}
    for conv, chain in chains.items():
        if len(chain) < 2:
            continue
        cost, came = np.where(np.arange(n) == 0, 0.0, np.inf), []
        for e in chain:
            both = cost[:, None] + square(e.costs)
            cost = both.min(axis=0)
            came.append(np.where(both == cost, square(e.ranks), n).argmin(axis=0))
        states = [int((cost + EMPTY[:, FINAL]).argmin())]
        for c in reversed(came):
            states.append(int(c[states[-1]]))
        states.reverse()
        offset = 0
        for i, e in enumerate(chain):
            out[e.part, conv] = states[i], None if i == len(chain) - 1 else states[i + 1], offset
            offset += int(square(e.made)[states[i], states[i + 1]])
    return out


def render_batches(batches: Iterator[pa.RecordBatch], known: dict[tuple[int, int | None], tuple[int, int | None, int]]) -> Iterator[pa.RecordBatch]:
    parts: list[int] = []

    def watched() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and not parts:
                parts.append(batch.column("part")[0].as_py())
            yield batch

    rows: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_())
        names = ["conv_id", "part", "piece", "role", "text", "first_turn", "n_merged", "action", "border"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for conv, turns in pieces(watched()):
        begin, end, offset = known.get((parts[0], conv), (0, None, 0))
        actions, _ = repair([role_number(r) for r, _, _ in turns], begin, end)
        made: list[list] = []
        for action, role, at in actions:
            text, turn = (turns[at][1] or "", turns[at][2]) if at >= 0 else ("", None)
            if action == "merge" and made:
                made[-1][1].append(text)
                made[-1][3] += " merge"
            else:
                made.append([ROLES[role - 1], [text], turn, action])
        # a piece that begins with a merge goes on with the turn of the piece before
        goes_on = made[0][3].startswith("merge")
        for i, (role, texts, turn, action) in enumerate(made):
            border = goes_on and i == 0 or end is not None and i == len(made) - 1
            rows.append((conv, parts[0], offset - goes_on + i, role, "\n".join(texts), turn, len(texts), action, border))
        if len(rows) >= 2000:
            yield flushed()
            rows.clear()
    yield flushed()


def joined_borders(rows: DataFrame) -> DataFrame:
    """The rows with those of one turn on both sides of a border made one; no other rows are shuffled."""
    part = F.struct("part", "role", "text", "first_turn", "n_merged", "action")
    met = rows.where("border").groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(part)).alias("met"))  # at most one row for each partition
    head, end = F.col("met")[0], lambda name, by: F.array_join(F.col("met")[name], by)
    one = met.select("conv_id", head["part"].alias("part"), "piece", head["role"].alias("role"), end("text", "\n").alias("text"), head["first_turn"].alias("first_turn"),
                     F.aggregate(F.col("met")["n_merged"], F.lit(0), lambda a, x: a + x).alias("n_merged"), end("action", " ").alias("action"))
    return rows.where("not border").drop("border").unionByName(one)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per repaired turn, in the order of conv_id, piece."""
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    # the order of rows in a partition is kept by the checkpoint, so both passes see the same pieces
    ranged = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    ranged = C.checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    # two rows for each partition at most
    edges = ranged.mapInArrow(edge_batches, "conv_id long, part int, number long, costs array<double>, made array<long>, ranks array<long>").collect()
    known = decided(edges)
    # conversations that cross a border, of which a partition has two at most, are rendered apart and stored
    crossing = {conv for _, conv in known}
    crosses = F.coalesce(F.col("conv_id").isin([c for c in crossing if c is not None]), F.lit(None in crossing))
    rows = ranged.where(~crosses).mapInArrow(lambda batches: render_batches(batches, known), OUT).drop("border")
    if crossing:
        apart = C.stored(ranged.where(crosses).mapInArrow(lambda batches: render_batches(batches, known), OUT), "crossing")
        rows = rows.unionByName(joined_borders(apart))
    return rows.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")))


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(C.table(spark, sf_dir, "conversations"))


QUERIES = {"op7_role_repair": op7_role_repair}
ORACLES: dict[str, str] = {}
