"""Chat formatting with minimum-cost role repair.

Legal conversations are those an automaton accepts: an optional system turn, then user and
assistant in turn, ending with the assistant.  Dynamic programming over (turn, state) finds
the cheapest repair: keep a turn, relabel it, merge it into the turn before, or put an empty
turn in front of it.  Costs are ``KEEP`` 0, ``MERGE`` 1, ``INSERT`` 2, ``RELABEL`` 3 (1 if
the role is null or unknown).  Of equally cheap repairs the one is taken that, from the
start on, prefers new turns to inserted to merged ones, and then the lower state.

Rows are sorted by conversation and turn over all tasks, so a long conversation spans
several; each of its segments is condensed to a 4 x 4 cost matrix, from which the driver
(two matrices a task at most) finds the cost to go at each segment's end and the state at
its start.  The result does not depend on where segments end.

Turns of one number are ordered by role, then by their text's first ``PREFIX`` characters and
a hash of the text, null first; equal rows are all kept.  So whole texts are no sort keys of
which samples reach the driver.  A null text is empty.  A null conv_id is a conversation of
its own.  Other columns may have any name.  An empty table gives an empty one.  A task holds its
share of one conversation at a time, texts included, whatever their length.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, written

#: States: nothing yet, and the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
INF = 1 << 40
#: Cost of ending in a state: a missing reply (and a missing question) is inserted.
FINAL = (0, 2 * INSERT, INSERT, 0)

#: Characters of a text that order turns of one number and role.
PREFIX = 64

OUT = "conv_id long, position long, step int, turn long, action string, role string, text string, rendered string"


def role_of(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), START)


def moves(role: int) -> list[list[tuple[int, int, int]]]:
    """For each state: (cost, action, next state); actions 0 new, 1 inserted + new, 2 merged."""
    out = []
    for s in range(4):
        own = []
        for q in (SYSTEM, USER, ASSISTANT):
            change = 0 if q == role else RELABEL if role else UNKNOWN
            if q in LEGAL[s]:
                own.append((change, 0, q))
            elif any(q in LEGAL[x] for x in LEGAL[s]):
                own.append((change + INSERT, 1, q))
            if q == s:
                own.append((change + MERGE, 2, q))
        out.append(own)
    return out


MOVES = [moves(r) for r in range(4)]


def costs_to_go(roles: list[int], final) -> list[tuple[int, ...]]:
    """By place: the least cost from each state to the end."""
    out = [tuple(final)]
    for role in reversed(roles):
        after = out[-1]
        out.append(tuple(min(c + after[q] for c, _, q in own) for own in MOVES[role]))
    return out[::-1]


def path(roles: list[int], state: int, final) -> list[tuple[int, int, int]]:
    """(state before, action, state after) of each turn, from the preferred cheapest repair."""
    to_go, out = costs_to_go(roles, final), []
    for i, role in enumerate(roles):
        _, action, q = min((c + to_go[i + 1][q], a, q) for c, a, q in MOVES[role][state])
        out.append((state, action, q))
        state = q
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost from each state to each state over a segment."""
    columns = [costs_to_go(roles, [0 if s == t else INF for s in range(4)])[0] for t in range(4)]
    return [[min(columns[t][s], INF) for t in range(4)] for s in range(4)]


def render(conv_id, turns: list[tuple], state: int, final, position: int, is_last: bool) -> list[tuple]:
    """Output rows of a segment; ``turns``: (turn, role, text)."""
    rows = []
    opened = lambda s, q: ("<|im_end|>\n" if s else "") + f"<|im_start|>{NAMES[q]}\n"
    for (turn, role, text), (s, action, q) in zip(turns, path([role_of(t[1]) for t in turns], state, final), strict=True):
        text, named = text or "", role_of(role)
        what = "keep" if named == q else "relabel"
        if action == 1:
            x = next(x for x in LEGAL[s] if q in LEGAL[x])
            rows.append([conv_id, position, 0, None, "insert", NAMES[x], "", opened(s, x)])
            s = x
        if action == 2:
            rows.append([conv_id, position, 1, turn, "merge" if named == q else "relabel+merge", NAMES[q], text, "\n\n" + text])
        else:
            rows.append([conv_id, position, 1, turn, what, NAMES[q], text, opened(s, q) + text])
        state, position = q, position + 1
    if is_last and turns:
        for q in {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ()):
            rows.append([conv_id, position - 1, 1 + q, None, "insert", NAMES[q], "", opened(state, q)])
            state = q
        rows[-1][7] += "<|im_end|>\n"
    return [tuple(r) for r in rows]


def _segments(batches):
    """(pid, conv_id), turns; input sorted by pid and seq."""
    key, held = None, []
    for batch in batches:
        for pid, conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (pid, conv) != key:
                if held:
                    yield key, held
                key, held = (pid, conv), []
            held.append(tuple(turn))
    if held:
        yield key, held


def _repair(ends: dict):
    """``ends``: by (pid, conv_id): state before, cost to go after, place, whether the last one."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 4]
        names = [c.split()[0] for c in OUT.split(", ")]
        rows = []
        for key, turns in _segments(batches):
            rows += render(key[1], turns, *ends.get(key, (START, FINAL, 0, True)))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _condense(finals: dict | None):
    """Per segment: its matrix, or where each state leads under the costs to go at its end."""

    def run(batches):
        for key, turns in _segments(batches):
            roles = [role_of(t[0]) for t in turns]
            if finals is None:
                cells = [c for row in matrix(roles) for c in row]
            else:
                cells = [path(roles, s, finals[key])[-1][2] for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([len(turns)], pa.int64()), pa.array([cells], pa.list_(pa.int64()))], ["pid", "conv_id", "n", "cells"])

    return run


def repair(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) repaired and rendered.

    One row a turn, in order of (position, step): position counts a conversation's turns,
    step 0 is an empty turn put before, 1 the turn itself, 3 and 4 empty turns at the end.
    ``rendered`` of a conversation's rows, joined in order, is its rendered text.
    """
    spark = turns.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "start", "hash", "n"]
    start = F.substring("text", 1, PREFIX)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", start.alias("start"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("n"))
    rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", "turn", "role", "text", F.spark_partition_id().cast("long").alias("pid"), F.monotonically_increasing_id().alias("seq")), "turns")
    # Conversations in more than one task: at most one per task boundary.
    long = rows.groupBy("conv_id").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("hi > lo").select(F.col("conv_id").alias("__long"))
    long = written(long, "long")
    ends: dict = {}
    if not long.isEmpty():
        parts = join_checked(rows, long, F.col("conv_id").eqNullSafe(F.col("__long")), "inner").select("pid", "conv_id", "role", "seq")
        parts = written(parts, "parts").repartition(count, "pid").sortWithinPartitions("pid", "seq").select("pid", "conv_id", "role")
        schema = "pid long, conv_id long, n long, cells array<long>"
        by_conv: dict = {}
        for r in parts.mapInArrow(_condense(None), schema).collect():
            by_conv.setdefault(r["conv_id"], []).append((r["pid"], r["n"], r["cells"]))
        finals, place = {}, {}
        for conv, segments in by_conv.items():
            segments.sort(key=lambda x: x[0])
            to_go, at = FINAL, 0
            for pid, n, _ in segments:
                place[pid, conv], at = at, at + n
            for pid, _, cells in reversed(segments):
                finals[pid, conv] = to_go
                to_go = tuple(min(cells[4 * s + t] + to_go[t] for t in range(4)) for s in range(4))
        leads = {(r["pid"], r["conv_id"]): r["cells"] for r in parts.mapInArrow(_condense(finals), schema).collect()}
        for conv, segments in by_conv.items():
            state = START
            for i, (pid, _, _) in enumerate(segments):
                ends[pid, conv] = (state, finals[pid, conv], place[pid, conv], i + 1 == len(segments))
                state = leads[pid, conv][state]
    ready = rows.repartition(count, "pid").sortWithinPartitions("pid", "seq").select("pid", "conv_id", "turn", "role", "text")
    return ready.mapInArrow(_repair(ends), OUT)
