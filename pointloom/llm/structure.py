"""Repair of conversation structure: a legal sequence of roles for the fewest edits.

A turn is faulty if it is blank, else if role and text were seen earlier in its conversation
(duplicate), else if its last character that is no blank does not end a sentence (truncated).
Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty user or assistant
turn 3; blank and duplicate turns must be deleted, and each other truncated turn that stays
adds 3.  What is left must read ``(s?(ua)+)?`` by the roles' initials.  Of equally cheap
repairs the one with the least string of initials (D, I, K, R) is taken.

Turns that must go leave the automaton's state alone, and deleting them comes first in any
tie, so only the others enter the dynamic program.  Conversations are put into buckets of
like length and laid out time-major; each turn updates the costs to go of all conversations
of a bucket at once, the costs are stored for every turn, and a second walk, forwards, reads
all edits off them at once, too.

Rows are sorted by conversation over all tasks.  A task finishes the conversations that lie
wholly inside it; the first and last one of each task may go on in others, and of these each
task's share is condensed to a 4 x 4 matrix of costs, from which the costs to go at its end
and the state at its start follow.  The digest of a repaired conversation that spans tasks
is computed by one task in a stream, as SHA-256 cannot be put together from parts; only the
string of edits is held, one byte a turn.

Turns of one number are ordered by role, then by the text's SHA-256; a null turn comes first.
Null roles and texts are one space.  Rows equal in all of these are merged before anything is
sorted, and counted.  A null conv_id is a conversation of its own.  An empty table gives an
empty one; other columns may have any name and are not read.  Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BLANKS, join_checked, written

#: States: nothing yet, then the initial of the last role.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
INITIALS = "-sua"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The state after an inserted or reroled turn.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept turn, by state and initial; 4: none.
KEEP = np.full((4, 4), 4)
KEEP[START, SYSTEM], KEEP[START, USER], KEEP[SYSTEM, USER], KEEP[USER, ASSISTANT], KEEP[ASSISTANT, USER] = SYSTEM, USER, USER, ASSISTANT, USER
#: Whether two neighbours' initials may stand together.
TOGETHER = np.zeros((4, 4), bool)
TOGETHER[SYSTEM, USER] = TOGETHER[USER, ASSISTANT] = TOGETHER[ASSISTANT, USER] = True
INF = 1 << 40
#: Costs of ending in a state, and the inserted turns that end it.
FINAL = np.array([0, 2 * INSERT, INSERT, 0])
ENDING = (0, 2, 1, 0)

#: Kinds of rows.
GONE, BLANK, AGAIN, CUT, WHOLE = range(5)
#: Rows and characters of a task, about.
TASK_ROWS, TASK_CHARS = 100_000, 32 << 20
#: Characters of a piece of a conversation that spans tasks, about.
PIECE = 8192

COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"
#: Rows of a task's first and last conversation; ``share`` grows along a conversation.
ROW = "share long, seq long, turn long, initial int, kind int, n long, role string, text string"


def costs_to_go(initials: np.ndarray, cuts: np.ndarray, counts: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Least costs by turn, conversation, ending and state.

    ``initials`` and ``cuts`` (what a kept turn adds) are time-major, conversations from long
    to short; ``counts``: conversations that have each turn; ``final``: conversation, ending,
    state.
    """
    many, endings = final.shape[:2]
    out = np.empty((len(counts) + 1, many, endings, 4), np.int64)
    out[-1] = final
    for t in range(len(counts) - 1, -1, -1):
        k = counts[t]
        after = out[t + 1, :k]
        cut = cuts[t, :k, None, None]
        padded = np.concatenate([after, np.full((k, endings, 1), INF)], axis=2)
        kept = np.take_along_axis(padded, np.broadcast_to(KEEP.T[initials[t, :k]][:, None, :], (k, endings, 4)), axis=2) + cut
        best = np.minimum(np.minimum(after + DELETE, kept), after[:, :, NEXT] + REROLE + cut)
        # Turns put in before this one; two in a row never pay in states that follow each other.
        user, assistant = best[..., USER].copy(), best[..., ASSISTANT].copy()
        best[..., USER] = np.minimum(user, assistant + INSERT)
        best[..., ASSISTANT] = np.minimum(assistant, user + INSERT)
        for state in (SYSTEM, START):
            best[..., state] = np.minimum(best[..., state], best[..., USER] + INSERT)
        out[t, :k] = np.minimum(best, INF)
        out[t, k:] = out[t + 1, k:]
    return out


def edits(initials: np.ndarray, cuts: np.ndarray, counts: np.ndarray, costs: np.ndarray, state: np.ndarray):
    """All conversations' edits under one ending each: inserted before, edit (0 D, 2 K, 3 R), state before, by turn; and the states at the end."""
    state = state.copy()
    inserted, edit, before = (np.zeros(initials.shape, np.int8) for _ in range(3))
    for t, k in enumerate(counts):
        now, after = costs[t, :k], np.concatenate([costs[t + 1, :k], np.full((k, 1), INF)], axis=1)
        q, each = state[:k], np.arange(k)
        before[t, :k] = q
        while True:
            left = now[each, q]
            deletes = after[each, q] + DELETE == left
            inserts = ~deletes & (now[each, NEXT[q]] + INSERT == left)
            if not inserts.any():
                break
            inserted[t, :k] += inserts
            q = np.where(inserts, NEXT[q], q)
        kept = KEEP[q, initials[t, :k]]
        keeps = ~deletes & (after[each, kept] + cuts[t, :k] == left)
        edit[t, :k] = np.where(deletes, 0, np.where(keeps, 2, 3))
        state[:k] = np.where(deletes, q, np.where(keeps, kept, NEXT[q]))
    return inserted, edit, before, state


class Share:
    """What one task has of one conversation; ``given``: the state before, costs to go after it, and whether it is the last."""

    given = (START, FINAL, True)

    def __init__(self, conv, table: pa.Table):
        self.conv, self.table = conv, table
        column = lambda name: table.column(name).to_numpy()
        self.kind, self.n, self.initial = column("kind"), column("n"), column("initial")
        self.live = np.flatnonzero(self.kind >= CUT)

    def counts(self) -> dict:
        """Faults, neighbours and turns, and what joining shares needs of the ends."""
        there = np.flatnonzero(self.kind != GONE)
        n, kind, initial = self.n[there], self.kind[there], self.initial[there]
        turns = self.table.column("turn").take(pa.array(there)).drop_null().to_numpy()
        of = lambda k: int(n[kind == k].sum())
        live = int((kind >= CUT).sum())
        return {
            "blank": of(BLANK), "duplicate": int(n[kind != BLANK].sum()) - live, "truncated": int((kind == CUT).sum()),
            "illegal": int((n - 1).sum()) + int((~TOGETHER[initial[:-1], initial[1:]]).sum()), "cost": DELETE * (int(n.sum()) - live),
            "first": int(initial[0]) if len(there) else -1, "last": int(initial[-1]) if len(there) else -1,
            "lo": int(turns[0]) if len(turns) else None, "hi": int(turns[-1]) if len(turns) else None, "turns": int((np.diff(turns) != 0).sum()) + 1 if len(turns) else 0,
        }

    def written(self, inserted, edit, before, ending: int):
        """Pieces of (audit, lines) in order."""
        roles, texts = self.table.column("role"), self.table.column("text")
        audit, lines, room, at = [], [], PIECE, 0
        for i, (kind, n) in enumerate(zip(self.kind.tolist(), self.n.tolist(), strict=True)):
            if kind < CUT:
                audit.append("D" * n)
            else:
                state = int(before[at])
                for _ in range(inserted[at]):
                    state = NEXT[state]
                    lines.append(f"{NAMES[state]}:")
                audit.append("I" * inserted[at] + "DIKR"[edit[at]] + "D" * (n - 1))
                if edit[at]:
                    text = texts[i].as_py()
                    lines.append(f"{roles[i].as_py() if edit[at] == 2 else NAMES[NEXT[state]]}:{text}")
                    room -= len(text)
                at += 1
            if room < 0:
                yield "".join(audit), lines
                audit, lines, room = [], [], PIECE
        audit.append("I" * ENDING[ending])
        for _ in range(ENDING[ending]):
            ending = NEXT[ending]
            lines.append(f"{NAMES[ending]}:")
        yield "".join(audit), lines


def _buckets(shares: list[Share]):
    """Shares by the power of two above their length: shares, and their time-major arrays."""
    by_size: dict[int, list[Share]] = {}
    for s in shares:
        by_size.setdefault(len(s.live).bit_length(), []).append(s)
    for own in by_size.values():
        own.sort(key=lambda s: -len(s.live))
        sizes = np.array([len(s.live) for s in own])
        initials, cuts = (np.zeros((sizes[0], len(own)), np.int8) for _ in range(2))
        for c, s in enumerate(own):
            initials[: sizes[c], c] = s.initial[s.live]
            cuts[: sizes[c], c] = TRUNCATED * (s.kind[s.live] == CUT)
        counts = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        yield own, initials, cuts, counts


def _repaired(shares: list[Share]):
    """(share, its cost, its pieces) of all shares."""
    for own, initials, cuts, counts in _buckets(shares):
        given = [s.given for s in own]
        costs = costs_to_go(initials, cuts, counts, np.array([g[1] for g in given])[:, None])[:, :, 0]
        state = np.array([g[0] for g in given])
        inserted, edit, before, end = edits(initials, cuts, counts, costs, state)
        each = np.arange(len(own))
        spent = costs[0, each, state] - np.where([g[2] for g in given], 0, costs[-1, each, end])
        for c, s in enumerate(own):
            size = len(s.live)
            yield s, int(spent[c]), s.written(inserted[:size, c].tolist(), edit[:size, c].tolist(), before[:size, c].tolist(), int(end[c]) if given[c][2] else START)


def _runs(batches):
    """Lists of (conv_id, table, whether the last run) from batches sorted by conversation, in each share if there are shares."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        new = np.zeros(table.num_rows, bool)
        for name in ("conv_id", "share"):
            if name in table.column_names:
                own = table.column(name).combine_chunks()
                null, value = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy()
                new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
        cuts = [0, *np.flatnonzero(new).tolist()]
        if len(cuts) > 1:
            yield [(table.column("conv_id")[a].as_py(), table.slice(a, b - a), False) for a, b in zip(cuts, cuts[1:])]
        held = table.slice(cuts[-1])
    if held is not None:
        yield [(held.column("conv_id")[0].as_py(), held, True)]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _gaps(lo, hi, turns) -> int:
    return 0 if lo is None else hi - lo + 1 - turns


def _finish(with_text: bool):
    """Conversations that lie inside a task are done; rows of its first and last one go on."""
    done, raw = _schema(DONE), _schema(ROW)
    both = pa.schema([*done, *raw])

    def run(batches):
        first = True
        for runs in _runs(batches):
            shares = []
            for conv, table, last in runs:
                if not (first or last):
                    shares.append(Share(conv, table))
                    continue
                n = table.num_rows
                share = pa.array(np.full(n, 2 * table.column("pid")[0].as_py() + last), pa.int64())
                first = False
                yield from pa.table([table.column("conv_id"), *[pa.nulls(n, f.type) for f in list(done)[1:]], share, *[table.column(f.name) for f in list(raw)[1:]]], schema=both).to_batches()
            rows = []
            for s, cost, pieces in _repaired(shares):
                audit, lines = zip(*pieces, strict=True)
                text = "\n".join(x for part in lines for x in part)
                c = s.counts()
                rows.append({**{k: c[k] for k in COUNTS}, "conv_id": s.conv, "cost": c["cost"] + cost, "gaps": _gaps(c["lo"], c["hi"], c["turns"]), "audit": "".join(audit), "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), "repaired": text if with_text else None})
            if rows:
                yield from pa.Table.from_pylist(rows, schema=both).to_batches()

    return run


CELLS = "conv_id long, share long, cells array<long>"


def _condense(batches):
    """Least cost of a share from each state to each state."""
    ends = np.where(np.eye(4, dtype=bool), 0, INF)
    for runs in _runs(batches):
        for own, initials, cuts, counts in _buckets([Share(conv, table) for conv, table, _ in runs]):
            costs = costs_to_go(initials, cuts, counts, np.broadcast_to(ends, (len(own), 4, 4)))[0]
            yield from _cells(own, [c.T.ravel().tolist() for c in costs])


def _cells(shares: list[Share], cells: list[list[int]]):
    rows = [{"conv_id": s.conv, "share": s.table.column("share")[0].as_py(), "cells": c} for s, c in zip(shares, cells, strict=True)]
    yield from pa.Table.from_pylist(rows, schema=_schema(CELLS)).to_batches()


def _leads(batches):
    """Where a share ends from each state, under the costs to go at its end."""
    for runs in _runs(batches):
        for own, initials, cuts, counts in _buckets([Share(conv, table) for conv, table, _ in runs]):
            costs = costs_to_go(initials, cuts, counts, np.array([s.table.column("final")[0].as_py() for s in own])[:, None])[:, :, 0]
            ends = [edits(initials, cuts, counts, costs, np.full(len(own), state))[3] for state in range(4)]
            yield from _cells(own, np.stack(ends, axis=1).tolist())


def _finals(shares: pd.DataFrame) -> pd.DataFrame:
    """Costs to go at the end of each share of a conversation, from the shares' matrices."""
    shares = shares.sort_values("share")
    after, out = FINAL, []
    for cells in shares["cells"][::-1]:
        out.append(after.tolist())
        after = (np.reshape(cells, (4, 4)) + after).min(axis=1)
    return pd.DataFrame({"share": shares["share"], "final": out[::-1], "ends": [False] * (len(out) - 1) + [True]})


def _states(shares: pd.DataFrame) -> pd.DataFrame:
    """The state before each share."""
    shares = shares.sort_values("share")
    state, out = START, []
    for cells in shares["cells"]:
        out.append(state)
        state = int(cells[state])
    return pd.DataFrame({"share": shares["share"], "state": out})


PIECES = "conv_id long, share long, part long, audit string, lines string, first int, last int, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, cost long"


def _pieces(batches):
    """Pieces of the shares' edits and repaired lines; the first piece of each carries its counts."""
    schema = _schema(PIECES)
    for runs in _runs(batches):
        shares = [Share(conv, table) for conv, table, _ in runs]
        for s in shares:
            s.given = tuple(s.table.column(c)[0].as_py() for c in ("state", "final", "ends"))
        rows = []
        for s, cost, pieces in _repaired(shares):
            share = s.table.column("share")[0].as_py()
            for part, (audit, lines) in enumerate(pieces):
                row = {"conv_id": s.conv, "share": share, "part": part, "audit": audit, "lines": "\n".join(lines) if lines else None}
                if not part:
                    c = s.counts()
                    row |= c | {"cost": c["cost"] + cost}
                rows.append(row)
                if len(rows) >= 1000:
                    yield from pa.Table.from_pylist(rows, schema=schema).to_batches()
                    rows = []
        if rows:
            yield from pa.Table.from_pylist(rows, schema=schema).to_batches()


def _together(with_text: bool):
    """Conversations from their sorted pieces: one digest runs over all of a conversation's lines."""

    def run(batches):
        for runs in _joined(batches, with_text):
            yield from pa.Table.from_pylist([runs], schema=_schema(DONE)).to_batches()

    return run


def _joined(batches, with_text: bool):
    conv = now = None
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != conv:
                if now is not None:
                    yield _closed(conv, now, with_text)
                conv, now = row["conv_id"], {**dict.fromkeys(COUNTS, 0), "digest": hashlib.sha256(), "audit": [], "lines": [], "some": False, "last": -1, "lo": None, "hi": None, "turns": 0}
            now["audit"].append(row["audit"])
            if row["lines"] is not None:
                now["digest"].update(("\n" * now["some"] + row["lines"]).encode())
                now["some"] = True
                if with_text:
                    now["lines"].append(row["lines"])
            if row["part"] == 0:
                for k in COUNTS:
                    now[k] += row[k]
                if row["first"] >= 0:
                    now["illegal"] += now["last"] >= 0 and not TOGETHER[now["last"], row["first"]]
                    now["last"] = row["last"]
                if row["lo"] is not None:
                    now["turns"] += row["turns"] - (now["hi"] == row["lo"])
                    now["lo"], now["hi"] = row["lo"] if now["lo"] is None else now["lo"], row["hi"]
    if now is not None:
        yield _closed(conv, now, with_text)


def _closed(conv, now: dict, with_text: bool) -> dict:
    counts = {k: int(now[k]) for k in COUNTS}
    return counts | {"conv_id": conv, "gaps": _gaps(now["lo"], now["hi"], now["turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["digest"].hexdigest(), "repaired": "\n".join(now["lines"]) if with_text else None}


def _prepared(rows: DataFrame, copies: str | None) -> DataFrame:
    """Distinct turns with their number, kind and initial; a written table."""
    n = F.lit(1) if copies is None else F.coalesce(F.col(copies), F.lit(0))
    there = n > 0
    text = F.when(there, F.coalesce("text", F.lit(" ")))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(there, F.coalesce("role", F.lit(" "))).alias("role"), text.alias("text"), F.sha2(text, 256).alias("hash"), n.cast("long").alias("n"))
    same = written(own.groupBy("conv_id", "turn", "role", "hash").agg(F.sum("n").alias("n"), F.first("text").alias("text")), "turns")
    # Of the turns with a role and text, that with the least number is the first; all others were seen earlier.
    number = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    keys = same.where("n > 0").select("conv_id", "role", "hash", "turn")
    firsts = keys.groupBy("conv_id", "role", "hash").agg(F.min(number)["turn"].alias("turn"), F.count("*").alias("times"))
    names = [c for c in firsts.columns if c != "times"]
    seen = written(firsts.where("times > 1").select(*[F.col(c).alias(f"__{c}") for c in names]), "seen")
    on = [F.col("conv_id").eqNullSafe(F.col("__conv_id")), F.col("role") == F.col("__role"), F.col("hash") == F.col("__hash")]
    number_too = F.col("turn").eqNullSafe(F.col("__turn"))
    if seen.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        marked, again = same.join(F.broadcast(seen), on, "left"), F.col("__hash").isNotNull() & ~number_too
    else:  # by the number too, so that no key has many rows
        every = firsts.select(*[F.col(c).alias(f"__{c}") for c in names]).hint("merge")
        marked, again = same.join(every, [*on, number_too], "left"), F.col("__hash").isNull()
    return _kinds(marked.select(*same.columns, again.alias("again")))


def _kinds(turns: DataFrame) -> DataFrame:
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    kind = F.when(F.col("n") == 0, GONE).when(end == "", BLANK).when(F.col("again"), AGAIN).when(~end.isin(".", "!", "?"), CUT).otherwise(WHOLE)
    initial = F.instr(F.lit(INITIALS[1:]), F.substring(F.coalesce("role", F.lit(" ")), 1, 1))
    initial = F.when(F.coalesce("role", F.lit("")) == "", 0).otherwise(initial)
    return turns.select("conv_id", "turn", "role", "hash", "text", "n", kind.cast("int").alias("kind"), initial.cast("int").alias("initial"))


def repair(rows: DataFrame, copies: str | None = None, with_text: bool = True) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): its faults, the cheapest edits and the repaired lines.

    ``gaps`` counts missing numbers between the least and the largest turn.  ``copies`` names
    a column with how often each row occurs; 0 only names its conversation.
    """
    spark = rows.sparkSession
    turns = _prepared(rows, copies)
    size = turns.agg(F.count("*"), F.sum(F.length("text"))).collect()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size[0] / TASK_ROWS), math.ceil((size[1] or 0) / TASK_CHARS))
    order = ["conv_id", "turn", "role", "hash"]
    dealt = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().cast("long").alias("pid"), F.monotonically_increasing_id().alias("seq"), "conv_id", "turn", "initial", "kind", "n", "role", "text")
    out = written(dealt.mapInArrow(_finish(with_text), f"{DONE}, {ROW}"), "repaired")
    done = out.where("share IS NULL").select(*[c.split()[0] for c in DONE.split(", ")])
    edge = out.where("share IS NOT NULL").select("conv_id", *[c.split()[0] for c in ROW.split(", ")])

    def along(ends: DataFrame | None) -> DataFrame:
        own = edge if ends is None else join_checked(edge, ends, "share", "inner")
        return own.repartition(tasks, "share").sortWithinPartitions("share", "seq")

    condensed = along(None).drop("role", "text").mapInArrow(_condense, CELLS)
    finals = written(condensed.groupBy("conv_id").applyInPandas(_finals, "share long, final array<long>, ends boolean"), "finals")
    leads = along(finals).drop("role", "text").mapInArrow(_leads, CELLS)
    states = leads.groupBy("conv_id").applyInPandas(_states, "share long, state int")
    ends = written(finals.join(states, "share"), "ends")
    pieces = along(ends).mapInArrow(_pieces, PIECES)
    spanning = pieces.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "share", "part").mapInArrow(_together(with_text), DONE)
    return done.unionByName(spanning)
