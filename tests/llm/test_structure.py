"""Conversation structure repair against plain recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from pointloom.llm import common, queries, structure

SCHEMA = "conv_id long, turn long, role string, text string, n int, audit string"
WORDS = ["Yes.", "No", "Why?", "go on", "", " ", "\t\n", "Done!  ", "a.b", "é", "…", "x "]


def cheapest(turns, start=""):
    """(cost, audit, lines) of the cheapest repair; turns: (role, text, must go, truncated)."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts=0):
        out = []
        if i == len(turns):
            if state in ("", "a"):
                return 0, "", ()
        else:
            role, text, must_go, cut = turns[i]
            c, a, rest = best(i + 1, state)
            out.append((c + 4, "D" + a, rest))
            if not must_go:
                if role[:1] == after[state] or state == "" and role[:1] == "s":
                    c, a, rest = best(i + 1, role[:1])
                    out.append((c + 3 * cut, "K" + a, (f"{role}:{text}", *rest)))
                c, a, rest = best(i + 1, after[state])
                out.append((c + 3 + 3 * cut, "R" + a, (f"{names[after[state]]}:{text}", *rest)))
        if inserts < 3:
            c, a, rest = best(i, after[state], inserts + 1)
            out.append((c + 3, "I" + a, (f"{names[after[state]]}:", *rest)))
        return min(out, default=(10**9, "", ()))

    return best(0, start)


def brute(rows):
    """Results by conversation of (conv_id, turn, role, text, n)."""
    by_conv = {}
    for conv, turn, role, text, n, *_ in rows:
        by_conv.setdefault(conv, []).extend([(turn, " " if role is None else role, " " if text is None else text)] * (n or 0))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        kinds, seen = [], set()
        for _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, lines = cheapest([(r, t, k in ("blank", "duplicate"), k == "truncated") for (_, r, t), k in zip(turns, kinds)])
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines))
    return out


def repaired(spark, rows, **kw):
    got = structure.repair(spark.createDataFrame(rows, SCHEMA), "n", **kw).collect()
    out = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def made(rng, conv, size, roles=("system", "user", "assistant", "User", "", "agent", None)):
    return [(conv, rng.choice([None, i, i, i, i + 1]), rng.choice(roles), rng.choice([*WORDS, f"own {i}.", None]), rng.choice([1, 1, 1, 2, 3, 0]), "x") for i in range(size)]


def test_repairs_equal_plain_recursion(spark):
    rng = random.Random(3)
    rows = [row for conv in range(400) for row in made(rng, conv, rng.randrange(1, 9))]
    rows += [row for conv in range(400, 600) for row in made(rng, conv, rng.randrange(1, 12), ("system", "user", "assistant"))]
    rows += made(rng, None, 6) + [(9001, 1, "user", "gone.", 0, None), (9002, None, None, None, 1, None), (9002, None, None, None, 1, None)]
    assert repaired(spark, rows) == brute(rows)


def test_conversations_that_span_all_tasks(spark, monkeypatch):
    rng = random.Random(4)
    long = [(7, i, rng.choice(["system", "user", "assistant", "user", "assistant", "bot"]), rng.choice([f"say {i}.", f"cut {i}", "Same.", " "]), rng.choice([1, 1, 1, 1, 2, 0]), None) for i in range(900)]
    rows = long + made(rng, 6, 5) + made(rng, None, 40) + [(8, 1, "user", "Again.", 1, None)] * 300
    want = brute(rows)
    assert repaired(spark, rows) == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert repaired(spark, rows) == want


def test_empty_tables_long_texts_and_counts_left_out(spark):
    assert repaired(spark, []) == {}
    text = "long words " * 100_000
    rows = [(1, 1, "user", text + ".", 1, None), (1, 2, "assistant", text, 1, None), (2, 0, "assistant", "Hello.", 1, None)]
    assert repaired(spark, rows) == brute(rows)
    assert all(r[-1] is None for r in repaired(spark, rows, with_text=False).values())
    plain = structure.repair(spark.createDataFrame(rows, SCHEMA).drop("n", "audit"))
    assert {r.conv_id: tuple(r)[1:] for r in plain.collect()} == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_states_before_and_costs_after_join_shares(size):
    """A conversation cut anywhere has the edits of the whole one."""
    rng = np.random.default_rng(size)
    initials, cuts = rng.integers(0, 4, (size, 1)), 3 * rng.integers(0, 2, (size, 1))
    ones = lambda n: np.ones(n, int)
    final = structure.FINAL[None, None]
    whole = structure.costs_to_go(initials, cuts, ones(size), final)[:, :, 0]
    ins, edit, before, end = structure.edits(initials, cuts, ones(size), whole, np.zeros(1, int))
    for at in range(size + 1):
        late = structure.costs_to_go(initials[at:], cuts[at:], ones(size - at), final)[:, :, 0]
        early = structure.costs_to_go(initials[:at], cuts[:at], ones(at), late[0][:, None])[:, :, 0]
        a = structure.edits(initials[:at], cuts[:at], ones(at), early, np.zeros(1, int))
        b = structure.edits(initials[at:], cuts[at:], ones(size - at), late, a[3])
        assert [np.concatenate([x, y]).tolist() for x, y in zip(a[:3], b[:3])] == [ins.tolist(), edit.tolist(), before.tolist()] and b[3] == end


def test_registered_query_equals_plain_recursion(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        harm = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", r.text) if harm == 2 else r.text
        rows.append((r.conv_id, r.turn, "user" if harm == 4 else r.role, text, {0: 0, 3: 2}.get(harm, 1)))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_structure(spark, sf_dir).collect()}
    assert got == {conv: x[:-1] for conv, x in brute(rows).items()}
