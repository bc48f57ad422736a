"""Conversation repair against a recursion over (cost, audit), with chunks of few rows; null, empty, repeated and odd rows."""

import functools
import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reciprospark.llm import conversations as cv

SPACE = " \t\n\x0b\x0c\r"


def broken(rows):
    """Rows (conv, turn, role, text) after damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def by_recursion(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        kept = text.strip(SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(at, state, inserts=0):
        """Least (cost, audit) from here; state is the role initial before, or ''."""
        follows = "a" if state == "u" else "u"
        found = [] if inserts > 2 else [(2 + c, "I" + a) for c, a in [best(at, follows, inserts + 1)]]
        if at == len(rows):
            return min(found + ([(0, "")] if state in ("", "a") else []), default=(10**9, ""))
        extra, must = faults[at] == "truncated", faults[at] in ("blank", "duplicate")
        options = [("D", 3, state)]
        if not must:
            own = rows[at][1][:1]
            if own == follows or (state == "" and own == "s"):
                options.append(("K", extra, own))
            options.append(("R", 2 + extra, follows))
        for edit, cost, to in options:
            c, a = best(at + 1, to)
            found.append((cost + c, edit + a))
        return min(found)

    for at in range(len(rows), -1, -1):  # short recursions
        for state in ("", "s", "u", "a"):
            best(at, state)
    cost, audit = best(0, "")
    lines, at, state = [], 0, ""
    for edit in audit:
        if edit != "D":
            state = rows[at][1][:1] if edit == "K" else "a" if state == "u" else "u"
            role = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
        at += edit != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def reported(spark, rows, bits=2, kind="long"):
    table = spark.createDataFrame(rows, f"conv_id {kind}, turn long, role string, text string")
    found = cv.report(cv.repair(cv.damaged(table), bits), table.selectExpr("conv_id AS conv"))
    return {r.conv: tuple(r[1:]) for r in found.collect()}


def test_query_on_the_smallest_tables(spark):
    from reciprospark.llm import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert found == {c: by_recursion(r) for c, r in broken(rows).items()}
    assert sum(r[6] > "" for r in found.values()) > 50


@pytest.mark.parametrize("bits", [1, 4, 12])
def test_long_conversations_in_chunks(spark, bits):
    import random

    rng = random.Random(bits)
    texts = ["yes.", "no", " ", "", "why?", "so.", "é…", "go! \n", "then"]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "s", "User"]), rng.choice(texts) + (str(t) if rng.random() < 0.9 else "") + rng.choice(["", "."])) for c in (1, 2) for t in range(300)]
    rows += [(3, t, "system", f"{t}.") for t in range(60)] + [(4, t, "assistant", f"{t}.") for t in range(40)]
    assert reported(spark, rows, bits) == {c: by_recursion(r) for c, r in broken(rows).items()}


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a."), (None, 2, None, "b."), (None, None, "assistant", None), (7, None, "user", "x."), (7, None, "user", "x."), (8, 5, "assistant", "\x85 ok."), (9, -3, "user", "　"), (9, 9, "assistant", "z.")]
    rows += [(10, t, "user", "same.") for t in range(30)] + [(11, 0, "user", "word. " * 60_000), (11, 1, "assistant", "k.")]
    assert reported(spark, rows) == {c: by_recursion(r) for c, r in broken(rows).items()}


def test_empty_tables_and_dropped_conversations(spark):
    assert reported(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert reported(spark, [(gone, 0, "user", "x.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_text_ids_other_columns_and_repaired_turns(spark):
    table = spark.createDataFrame([("a", 0, "assistant", "One."), ("a", 1, "user", "Two."), ("b", 0, "user", "")], "conv string, turn long, role string, text string")
    table = table.selectExpr("*", *[f"1 AS `{c}`" for c in ("pos", "block", "kind", "codes", "end", "last", "copy", "digest")])
    fixed = cv.repair(table)
    turns = [(r.conv, r.edit, r.role, r.text) for r in fixed.turns().orderBy("conv", "pos", "sub").collect()]
    assert turns == [("a", "I", "user", ""), ("a", "K", "assistant", "One."), ("a", "K", "user", "Two."), ("a", "I", "assistant", "")]
    assert {r.conv: (r.cost, r.n_edits) for r in fixed.audits().collect()} == {"a": (4, 4), "b": (3, 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=24), st.lists(st.integers(0, 24), max_size=4))
def test_stitched_chunks_equal_one_chunk(codes, cuts):
    costs = cv.Costs()
    whole, _, _ = cv.trace(codes, cv.AT_END, cv.START, costs)
    cuts = sorted({0, len(codes), *[c for c in cuts if c <= len(codes)]})
    chunks = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
    ends = [cv.AT_END] * len(chunks)
    starts = [cv.backwards(c, cv.AT_END, costs)[-1] for c in chunks]
    for _ in chunks:
        new = [*starts[1:], cv.AT_END]
        starts = [cv.fixed_up(c, e, n, s, costs) for c, e, n, s in zip(chunks, ends, new, starts)]
        ends = new
    pieces, state = [], cv.START
    for c, e in zip(chunks, ends):
        p, state, _ = cv.trace(c, e, state, costs)
        pieces += p
    assert pieces == whole
