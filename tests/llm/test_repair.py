"""Conversation repair against a plain dynamic programme and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import queries, repair
from tests import oracle

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, conv string, part string, first int, copies string"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
NAME = {2: "user", 3: "assistant"}


def plain_edits(rows):
    """``(cost, audit, lines)`` of ``(role, text, gone, cut)`` rows: costs of all states from the end, row by row."""
    best = {0: (0, "", ()), 1: (4, "II", ("user:", "assistant:")), 2: (2, "I", ("assistant:",)), 3: (0, "", ())}
    for role, text, gone, cut in reversed(rows):
        found = {}
        for s in range(4):
            ways = [(3 + best[s][0], "D" + best[s][1], best[s][2])]
            if not gone:
                t = NEXT[s]
                ways.append((2 + cut + best[t][0], "R" + best[t][1], (f"{NAME[t]}:{text}", *best[t][2])))
                t = 1 if role[:1] == "s" and s == 0 else NEXT[s] if role[:1] == NAME[NEXT[s]][0] else None
                if t is not None:
                    ways.append((cut + best[t][0], "K" + best[t][1], (f"{role}:{text}", *best[t][2])))
            found[s] = min(ways)
        for _ in range(2):
            for s in range(4):
                c, a, r = found[NEXT[s]]
                found[s] = min(found[s], (c + 2, "I" + a, (f"{NAME[NEXT[s]]}:", *r)))
        best = found
    return best[0]


def plain_audit(rows):
    """What ``audit`` returns, by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        now = []
        for c, turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if c != conv or fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            now += [(turn is not None, turn or 0, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
        now.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns, seen, faults, marked, illegal = [t for there, t, *_ in now if there], set(), [0, 0, 0], [], 0
        for i, (_, _, role, text) in enumerate(now):
            body = text.encode().rstrip(b" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1:] not in (b".", b"!", b"?") else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            illegal += i > 0 and now[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
            marked.append((role, text, fault in (0, 1), fault == 2))
        cost, edits, lines = plain_edits(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def audits(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, repair.N_SYMBOLS - 1), max_size=15), st.integers(0, 15))
def test_blocks_are_the_plain_programme(symbols, cut):
    roles = ["system", "user", "assistant", "tool"]
    rows = [(roles[(c - 1) // 2] if c else "", "x", c == 0, c > 0 and (c - 1) % 2) for c in symbols]
    marks, end = np.array(symbols, np.uint8), repair.tables().end
    edits, state = repair.trace(marks, end, repair.START)
    _, v, cost = repair.sweep(marks, end)
    lines = [*repair.lines_of(edits, repair.START, iter([(r[0], r[1]) for r in rows if not r[2]]), symbols), *repair.closing_lines(state)]
    assert (cost + repair.tables().vectors[v][0], "".join(edits) + repair.CLOSING[state], tuple(lines)) == plain_edits(rows)
    assert (repair.min_plus(repair.matrix(marks[:cut]), repair.matrix(marks[cut:])) == repair.matrix(marks)).all()


def test_vectors_are_few():
    t = repair.tables()
    assert len(t.vectors) < 100 and len(t.block_step[0]) == repair.N_SYMBOLS**repair.BLOCK


def odd_rows():
    rng, rows = random.Random(5), []
    texts = ["A text.", "Another!", "Cut off", " \t", "", None, "Ends so?\n", "é…", "x" * 50_000 + "."]
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            for _ in range(rng.choice((1, 1, 1, 2))):
                rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice((1, 1, 3)), rng.choice(["user", "assistant", "system", "tool", None, "", "User", "u"]), rng.choice(texts)))
    return rows + [(None, t, r, f"no id {t % 4}.") for t, r in zip(range(12), ["user", "assistant"] * 6)] + [(61, t, "user", "same.") for t in (-1, -1, 4)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in rows], KIND)


def test_odd_tables(spark):
    rows = odd_rows()
    assert audits(repair.audit(frame(spark, rows))) == plain_audit(rows)
    assert audits(repair.audit(frame(spark, rows).repartition(7))) == plain_audit(rows)
    assert repair.audit(frame(spark, rows).limit(0)).count() == 0


def test_conversation_that_lost_all_rows(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = audits(repair.audit(frame(spark, [(7, turn, "user", "gone.")])))
    assert got == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_spans_tasks_and_pieces(spark, many_tasks):
    rng = random.Random(8)
    rows = [(1, t if t % 50 else None, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), f"turn {rng.randrange(6000)}" + rng.choice([".", "", "!"])) for t in range(12_000)]
    rows += [(0, 3, "user", "the same row.")] * 5000 + [(2, t, "user", "a text.") for t in range(5)]
    ordered = repair.ordered_rows(repair.damaged(frame(spark, rows).drop("conv", "part", "first", "copies")))
    parts = repair._first_pass(ordered).where("kind = 1 and conv = 1").select("part", "piece").distinct().collect()
    assert len({r.part for r in parts}) > 1 and max(r.piece for r in parts) > 0
    assert audits(repair.audit(frame(spark, rows))) == plain_audit(rows)


def test_query_agrees_with_the_loop_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert audits(queries.op11_structure_repair(spark, SF)) == plain_audit(rows)
    assert oracle.compare(queries.op11_structure_repair(spark, SF), oracle.connect(SF), queries.oracle_sql()["op11_structure_repair"]) is None
