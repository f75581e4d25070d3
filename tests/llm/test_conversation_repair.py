import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from stayloom.llm import conversation_repair as C
from stayloom.llm import turn_grammar as G

SCHEMA = "conv_id bigint, turn bigint, role string, text string, open int, part string, symbols string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, marks):
    """(cost, audit, lines) by a walk that keeps the best of every state, turn by turn."""
    def inserted(state, entry):
        found = {state: entry}
        cost, audit, lines = entry
        for _ in range(3):
            role = "assistant" if state == "u" else "user"
            state, cost, audit, lines = role[0], cost + 5, audit + "I", [*lines, f"{role}:"]
            found[state] = min(found.get(state, (10**9,)), (cost, audit, lines))
        return found

    states = inserted("", (0, "", [])) if turns else {"": (0, "", [])}
    for (_, role, text), mark in zip(turns, marks):
        after = {}
        for state, (cost, audit, lines) in states.items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                if (state, role[:1]) in STEP:
                    ways.append((role[0], (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
                ways += [(r[0], (cost + more + 1, audit + "R", [*lines, f"{r}:{text}"])) for r in ("user", "assistant") if (state, r[0]) in STEP]
            for s, entry in ways:
                for q, e in inserted(s, entry).items():
                    after[q] = min(after.get(q, (10**9,)), e)
        states = after
    return min(states[s] for s in ("", "a") if s in states)


def plain(rows):
    turns = damaged(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted([r[1:] for r in turns if r[0] == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults(own)
        numbers = [t for t, *_ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = cheapest(own, marks)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def got(df, **kwargs):
    rows = C.repair_conversations(C.damage(df), **kwargs).conversations().select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turns = rng.sample(range(longest * 2), rng.randint(1, longest))
        for turn in turns:
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "uncle"]),
                         rng.choice(["Yes.", "No!", "cut", "Why?\n", "", " \t", "a.b", f"own {turn}."])))
    return rows


ODD = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (70, None, "user", "Same."), (71, 4, None, "No role."),
       (72, 5, "assistant", None), (73, 1, "user", "Long." * 30_000), (73, 2, "assistant", "x" * 100_000)]


@pytest.mark.parametrize("part_turns, part_bytes, rounds", [(4096, 1 << 20, 6), (3, 1 << 20, 6), (1, 40, 0), (7, 25, 3)])
def test_equals_plain_walk(make, part_turns, part_bytes, rounds):
    rows = conversations(part_turns, 60, 30) + ODD
    df = make([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert got(df, part_turns=part_turns, part_bytes=part_bytes, rounds=rounds) == plain(rows)


def test_one_conversation_over_many_tasks(make, spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", f"{t}.", f"{t}", ""])) for t in range(1500)]
    rows += conversations(8, 20, 4)
    rows = [(r[0] + 5 if r[0] != 1 else 1, *r[1:]) for r in rows]
    assert got(make([(*r, None, None, None) for r in rows], SCHEMA), part_turns=64) == plain(rows)


def test_repeated_rows_and_no_rows(make):
    rows = [(1, 1, "user", "Hi.")] * 50 + [(1, 2, "assistant", "Ho.")] * 3
    df = make([(*r, None, None, None) for r in rows], SCHEMA)
    assert got(df) == plain(rows) and got(df, part_turns=4) == plain(rows)
    assert got(make([], SCHEMA)) == []


def test_messages_are_the_repaired_turns(make):
    rows = [(1, 0, "assistant", "First."), (1, 1, "user", "Then."), (1, 2, "user", "cut"), (2, 0, "user", "Alone.")]
    df = make(rows, "conv_id bigint, turn bigint, role string, text string")
    repair = C.repair_conversations(df)
    lines = [(r.conv_id, r.edit, r.role, r.text) for r in repair.messages().orderBy("conv_id", "part", "seq", "place").collect()]
    audits = {r.conv_id: r.audit for r in repair.conversations().collect()}
    for conv in (1, 2):
        own = [r[1:] for r in rows if r[0] == conv]
        _, audit, want = cheapest(own, faults(own))
        assert audits[conv] == audit and [f"{r}:{t}" for c, _, r, t in lines if c == conv] == want


def test_sql_equals_plain_walk():
    rows = conversations(11, 40, 12) + ODD
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [list(r) for r in rows])
    found = con.execute(C.SQL).fetchall()
    assert sorted(found, key=lambda r: (r[0] is not None, r[0] or 0)) == plain(rows)


def test_matrices_over_the_grammar_equal_those_over_turns():
    rng = np.random.default_rng(4)
    parts = [bytes(rng.choice([0, 1, 2, 5, 8, 3], size=n).astype(np.uint8)) for n in (0, 1, 2, 9, 40, 200)] + [bytes([1, 2] * 60), bytes([8] * 33)]
    rules = []
    for _ in range(5):
        pair, n = G.pair_counts(G.replace(G.joined(parts), rules))
        rules += [(int(p) >> 16, int(p) & 65535) for p in pair[np.argsort(-n, kind="stable")][:6]]
    grammar, bare = G.Grammar(rules), G.Grammar([])
    for short, long in zip(grammar.sequences(parts), bare.sequences(parts)):
        assert len(short) < len(long) or len(long) < 3
        assert grammar.whole(short) == bare.whole(long)
        show = lambda m: [[None if e is None else (e[0], str(e[1])) for e in row] for row in m]
        assert show(grammar.part(short)) == show(bare.part(long))


def test_order_of_ropes():
    rng = random.Random(1)
    ropes = [G.Rope("".join(rng.choice("DIK") for _ in range(rng.randint(0, 4)))) for _ in range(30)]
    for _ in range(300):
        ropes.append(rng.choice(ropes) + rng.choice(ropes))
    for _ in range(2000):
        a, b = rng.choice(ropes), rng.choice(ropes)
        assert (a < b) == (str(a) < str(b))
