"""Operator 12 against all edit scripts, against plain loops over tables, and cut into pieces of any size."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from civicspark.llm import repair
from civicspark.llm.repair import Repair, Turn, damaged, op12_repair, repaired, summed_up

NEXT = {("S", "s"): "P", ("S", "u"): "U", ("P", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
SPACE = " \t\n\x0b\x0c\r"


def all_scripts(turns, i=0, state="S", inserts=0):
    """Every (cost, audit) with at most three insertions in a row."""
    if i == len(turns):
        if state in "SA":
            yield 0, ""
    else:
        t = turns[i]
        for c, a in all_scripts(turns, i + 1, state):
            yield 3 + c, "D" + a
        if t.fault not in ("b", "d"):
            extra = t.fault == "t"
            if (state, t.initial) in NEXT:
                for c, a in all_scripts(turns, i + 1, NEXT[state, t.initial]):
                    yield extra + c, "K" + a
            for role in "ua":
                if (state, role) in NEXT:
                    for c, a in all_scripts(turns, i + 1, NEXT[state, role]):
                        yield 2 + extra + c, "R" + a
    if inserts < 3:
        for role in "ua":
            if (state, role) in NEXT:
                for c, a in all_scripts(turns, i, NEXT[state, role], inserts + 1):
                    yield 2 + c, "I" + a


def by_states(turns):
    """The best (cost, audit) turn by turn, over the grammar's states."""
    best = {"S": (0, "")}

    def inserted(table):
        for _ in range(3):
            for s, (c, a) in list(table.items()):
                for role in "ua":
                    if (s, role) in NEXT:
                        end = NEXT[s, role]
                        table[end] = min(table.get(end, (1 << 60, "")), (c + 2, a + "I"))
        return table

    for t in turns:
        after = {}
        for s, (c, a) in inserted(best).items():
            steps = [(s, 3, "D")]
            if t.fault not in ("b", "d"):
                steps += [(NEXT[s, t.initial], t.fault == "t", "K")] if (s, t.initial) in NEXT else []
                steps += [(NEXT[s, role], 2 + (t.fault == "t"), "R") for role in "ua" if (s, role) in NEXT]
            for end, cost, letter in steps:
                after[end] = min(after.get(end, (1 << 60, "")), (c + cost, a + letter))
        best = after
    best = inserted(best)
    return min(v for s, v in best.items() if s in "SA")


TURNS = st.lists(st.builds(Turn, st.sampled_from("suauax"), st.sampled_from(["", "", "", "b", "d", "t"])))


def whole(turns, size):
    rows = [(i, {"u": "user", "a": "assistant", "s": "system"}.get(t.initial, t.initial), f"w{i}", t.fault) for i, t in enumerate(turns)]
    out = Repair()
    for at in range(0, len(rows), size):
        out.add(summed_up(rows[at : at + size], size >= len(rows)))
    return out.result(), rows


def repaired_lines(rows, audit):
    lines, state, at = [], "S", 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][1:3]
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "RI":
            role = next(r for r in ("user", "assistant") if (state, r[0]) in NEXT)
        state = NEXT[state, role[:1]]
        lines.append(f"{role}:{text}")
    assert state in "SA"
    return lines


@settings(max_examples=250, deadline=None)
@given(TURNS.filter(lambda t: 0 < len(t) <= 5))
def test_least_cost_and_audit_of_all_scripts(turns):
    (*_, cost, audit, digest), rows = whole(turns, 99)
    assert (cost, audit) == min(all_scripts(turns)) == by_states(turns)
    assert digest == hashlib.sha256("\n".join(repaired_lines(rows, audit)).encode()).hexdigest()


@settings(max_examples=250, deadline=None)
@given(TURNS.filter(len), st.integers(1, 9))
def test_any_pieces_give_the_same(turns, size):
    (*counts, cost, audit, digest), rows = whole(turns, size)
    assert (cost, audit) == by_states(turns)
    assert digest == hashlib.sha256("\n".join(repaired_lines(rows, audit)).encode()).hexdigest()
    assert counts == list(whole(turns, 1000)[0][:5])


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(case, text)
        out += [(conv, turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def plain(rows):
    """{conversation: result} by loops."""
    out = {}
    given, left = {r[0] for r in rows}, plain_damage(rows)
    for conv in given:
        mine = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns, kept = set(), [], []
        for turn, role, text in mine:
            bare = text.rstrip(SPACE)
            fault = "b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            turns.append(Turn(role[:1], fault))
            kept.append((turn, role, text))
        numbers = [t for t, *_ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = by_states(turns)
        digest = hashlib.sha256("\n".join(repaired_lines(kept, audit)).encode()).hexdigest()
        out[conv] = (gaps, *(sum(t.fault == k for t in turns) for k in "bdt"), illegal, cost, audit, digest)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    got = op12_repair(spark, str(folder)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_whole_table_against_loops(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_repair(spark, small).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(rows)
    assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_odd_rows_and_one_conversation_over_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 5)
    r = random.Random(3)
    texts = ["Yes.", "No", "Why? ", "  ", "", None, "So it is!\n", "\x85", "ab. 　"]
    roles = ["user", "assistant", "system", "tool", None, "", "ugly"]
    rows = [(7, k if k % 11 else None, ("user", "assistant")[k % 2] if r.random() < 0.8 else r.choice(roles), f"Turn {k}." if r.random() < 0.7 else r.choice(texts)) for k in range(700)]
    rows += [(r.choice([1, 2, 3, None, 9]), r.choice([None, 0, 1, 2, 5, 8]), r.choice(roles), r.choice(texts)) for _ in range(150)]
    rows += [(20, 0, "user", "Same.")] * 40 + [(21 + k, t, "user", "Hi.") for k in range(40) for t in range(2)]
    assert run(spark, rows, tmp_path) == plain(rows)


def test_rows_that_all_go_and_empty_tables(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")], tmp_path / "a") == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, [], tmp_path / "b") == {}


def test_clashing_and_extra_columns(spark):
    rows = [(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Ho.", "y", 2)]
    given = spark.createDataFrame(rows, f"{SCHEMA}, same string, copies int")
    [got] = repaired(damaged(given)).collect()
    assert tuple(got)[1:] == plain([r[:4] for r in rows])[1]


@pytest.mark.parametrize("n", [300, 2000])
def test_long_conversations(n):
    r = random.Random(n)
    turns = [Turn(r.choice("uaxs") if r.random() < 0.3 else "ua"[i % 2], r.choice("bdt") if r.random() < 0.2 else "") for i in range(n)]
    (*_, cost, audit, _), _ = whole(turns, repair.PIECE)
    assert (cost, audit) == by_states(turns)
