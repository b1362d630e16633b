"""Repair of conversations against a search over all edits, plain Python and SQL, and hot ones against whole ones."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from platelens.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"
FAULTS = {C.CLEAN: 0, C.TRUNCATED: 5, C.BROKEN: 0}


def right(initials):
    body = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (len(body) > 0 and body == "ua" * (len(body) // 2))


def cheapest(symbols, inserts=3):
    """Every sequence of edits with a few inserts: the least (cost, audit)."""
    best = (10**9, "")

    def go(k, out, cost, audit, left):
        nonlocal best
        if k == len(symbols) and right(out):
            best = min(best, (cost, audit))
        if left:
            for r in "ua":
                go(k, out + r, cost + 5, audit + "I", left - 1)
        if k < len(symbols):
            initial, fault = symbols[k]
            go(k + 1, out, cost + 2, audit + "D", left)
            if fault != C.BROKEN:
                go(k + 1, out + initial, cost + FAULTS[fault], audit + "K", left)
                for r in "ua":
                    go(k + 1, out + r, cost + 1 + FAULTS[fault], audit + "R", left)

    go(0, "", 0, "", inserts)
    return best


def test_audits_equal_all_edits():
    rng = random.Random(5)
    for _ in range(250):
        symbols = [(rng.choice("suax"), rng.choice(["", "", "t", "d"])) for _ in range(rng.randrange(5))]
        runs = C.run_lengths((C.symbol_of(i, f), 1) for i, f in symbols)
        assert C.solved(tuple(runs)) == cheapest(symbols), symbols


def test_runs_of_powers_equal_single_rows():
    """Long runs, cut anywhere: costs through powers, through single rows, and over stretches agree."""
    rng = random.Random(6)
    for _ in range(40):
        runs = C.run_lengths((C.symbol_of(rng.choice("suax"), rng.choice(["", "t", "d"])), rng.randrange(1, 70)) for _ in range(6))
        rows = [(s, 1) for s, n in runs for _ in range(n)]
        after, behind = C.END, [C.END]
        for s, _ in reversed(rows):
            after = C.through(C.power(s, 0), after)
            behind.append(after)
        behind.reverse()
        audit, state = C.unroll(runs)
        cost, own = 0, C.START
        assert C.through(C.transition(runs), C.END) == behind[0]
        assert len(audit) - audit.count("I") == len(rows) and state in (C.START, C.AFTER_A)
        cut = rng.randrange(len(rows) + 1)
        left, middle = C.unroll(C.run_lengths(rows[:cut]), C.START, behind[cut], last=False)
        right_, own = C.unroll(C.run_lengths(rows[cut:]), middle, C.END)
        assert left + right_ == audit and own == state


def plain(rows):
    """Damage and faults as the contract says, one conversation at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            word = lambda x: " " if x is None else str(x)
            kind, role, text = zlib.crc32(f"{word(c)}:{word(turn)}".encode()) % 20, word(role), word(text)
            if kind == 1:
                text = ""
            if kind == 2:
                text = text.translate({ord(x): None for x in ".!?"})
            if kind == 4:
                role = "user"
            own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\r\x0b\x0c")
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = C.solved(tuple(C.run_lengths((C.symbol_of(r[1], {"b": "d"}.get(f, f)), 1) for r, f in zip(own, faults, strict=True))))
        lines, at, roles = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else own[at][1:]
            at += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if roles.endswith("u") else "user"
            roles += role[:1]
            lines.append(f"{role}:{text}")
        assert right(roles)
        turns = [r[0] for r in own if r[0] is not None]
        first = [r[1][:1] for r in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    rng = random.Random(8)
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "User"], ["", " \n", None, "one.", "two", "three! ", "x" * 30_000, "дом.", "a\u2028", "end?\n"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(30) for t in range(rng.randrange(12))]
    rows += [(c, None, "user", "hello.") for c in (3, 4, None)] + [(None, 2, "assistant", "well"), (5, 4, "user", "tie."), (5, 4, "assistant", "tie.")]
    return rows + [(40, t % 7, roles[t % 5], f"text {t % 11}.") for t in range(120)] + [(41, 1, "user", "same.")] * 50 + rows[:20]


@pytest.mark.parametrize("hot", [(10**6, 10**9), (10, 10**9), (2, 100)])
def test_conversations_on_odd_rows(spark, hot):
    rows = odd_rows()
    table = spark.createDataFrame(rows, ROWS).select("*", *(F.lit("clash").alias(c) for c in ("gone", "blank", "part", "_d", "n"))).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_conversations(C.damaged(table), *hot).collect()}
    assert got == plain(rows)


def test_conversations_equal_sql_on_odd_rows(spark):
    conversations = spark.createDataFrame([r for r in odd_rows() if r[2] != ""], ROWS)
    con = duckdb.connect()
    con.register("conversations", conversations.toArrow())
    rel = con.execute(C.SQL)
    names = [d[0] for d in rel.description]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r[n] for n in names) for r in C.digest(conversations).collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_conversations_of_an_empty_table(spark):
    assert C.digest(spark.createDataFrame([], ROWS)).count() == 0
