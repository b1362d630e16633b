"""Repair of conversation structure by a run-length dynamic program over (min, +) transitions.

A conversation is right when the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional system turn and whole
user/assistant exchanges. Four states follow that pattern (nothing yet, after ``s``, after ``u``, after ``a``). A row is
one of a few symbols, the initial of its role with its fault; each symbol has a 4 x 4 matrix of the least cost from state
to state over one row (inserts before it included). Equal consecutive symbols are one run; a run of n rows is passed
through the binary powers of its matrix, which are made once and kept. Costs to the end are known at the borders of runs
this way, and the audit is unrolled from the left: halves of a power first, single rows last, the ASCII-least of the
cheapest edits each time. An audit fixes the states it passes, so the choice at each place gives the least string.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for a blank or duplicate row), Insert an empty user
or assistant turn 5; a truncated row that stays adds 5. Faults, the first counts: blank (no character but ASCII white
space), duplicate (role and text seen earlier in the conversation), truncated (the last such character is none of
``.!?``).

On Spark a conversation is gathered in order in one task only up to ``HOT_ROWS`` rows and ``HOT_BYTES`` bytes. Beyond, its
rows are dealt by range over tasks, in order. Equal rows of a turn are one row with a count, and first places of texts
come from an aggregate. Every stretch gives its matrix; the matrices of a conversation (one per stretch) give costs to the
end for each stretch, then the state in which it begins; the stretches are then unrolled side by side. Only the digest
of the repaired text is sequential by its nature: one task per hot conversation reads its pieces in order, one at a time.

Nulls count as one space (``conv_id`` stays null in the result; null is a conversation like any other, and a null turn
comes first). Rows of one turn are taken by role, then text. Empty and long texts are rows like any other. Rows that
repeat are duplicates. A conversation without rows left has zeros, an empty audit and the digest of nothing. An empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platelens.functions.sizing import join_bounded
from platelens.llm.common import stored

#: A conversation above either is dealt over tasks.
HOT_ROWS, HOT_BYTES = 20_000, 32 << 20
#: Bytes of repaired text of a hot conversation handed on at once.
PIECE = 1 << 20
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
INF = 1 << 60
#: What a state wants next: the role, and the state it leads to.
WANTED = {START: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
CLEAN, TRUNCATED, BROKEN = "", "t", "d"  # faults of a symbol; broken rows have to go
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
NOTHING = hashlib.sha256(b"").hexdigest()
FILLED = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


# --- the dynamic program


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(INF, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


def through(m: Matrix, after: Sequence[int]) -> Vector:
    """Least cost to the end from every state in front of ``m``, given those behind it."""
    return tuple(min(INF, *(m[i][k] + after[k] for k in STATES)) for i in STATES)


def keeps(state: int, initial: str) -> int | None:
    """The state after a kept row, None where its role doesn't fit."""
    if initial == "s":
        return AFTER_S if state == START else None
    return WANTED[state][1] if initial == WANTED[state][0][0] else None


def _inserts() -> Matrix:
    one = tuple(tuple(0 if i == j else INSERT if WANTED[i][1] == j else INF for j in STATES) for i in STATES)
    return product(product(one, one), product(one, one))


ANY_INSERTS = _inserts()
END = through(ANY_INSERTS, (0, INF, INF, 0))


@lru_cache(maxsize=None)  # symbols x 64 at most
def power(symbol: str, k: int) -> Matrix:
    """Least costs over 2^k rows of a symbol."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    initial, fault = symbol[0], symbol[1:]
    row = [[INF] * 4 for _ in STATES]
    for s in STATES:
        row[s][s] = DELETE
        if fault != BROKEN:
            more = CUT_OFF if fault == TRUNCATED else 0
            row[s][WANTED[s][1]] = REROLE + more
            if (t := keeps(s, initial)) is not None:
                row[s][t] = more
    return product(ANY_INSERTS, tuple(map(tuple, row)))


def symbol_of(role: str, fault: str) -> str:
    """The initial (``-`` for one that never fits, and for rows that have to go) and the fault."""
    initial = role[:1]
    return (initial if initial in ("s", "u", "a") and fault != BROKEN else "-") + fault


Runs = list[tuple[str, int]]


def run_lengths(symbols: Iterable[tuple[str, int]]) -> Runs:
    return [(s, sum(n for _, n in g)) for s, g in groupby(symbols, key=lambda x: x[0])]


def run_powers(runs: Runs) -> list[tuple[str, int]]:
    """The runs as powers of two, in order."""
    return [(s, k) for s, n in runs for k in reversed(range(n.bit_length())) if n >> k & 1]


def transition(runs: Runs) -> Matrix:
    out = tuple(tuple(0 if i == j else INF for j in STATES) for i in STATES)
    for s, k in run_powers(runs):
        out = product(out, power(s, k))
    return out


def unroll_power(symbol: str, k: int, state: int, after: Sequence[int], out: list[str]) -> int:
    """Edits of 2^k rows of a symbol appended to ``out``; the state behind them."""
    if k:
        middle = through(power(symbol, k - 1), after)
        return unroll_power(symbol, k - 1, unroll_power(symbol, k - 1, state, middle, out), after, out)
    here = through(power(symbol, 0), after)
    more = CUT_OFF if symbol[1:] == TRUNCATED else 0
    while True:
        if DELETE + after[state] == here[state]:
            out.append("D")
            return state
        follows = WANTED[state][1]
        if INSERT + here[follows] == here[state]:
            out.append("I")
            state = follows
            continue
        kept = keeps(state, symbol[0])
        if kept is not None and more + after[kept] == here[state]:
            out.append("K")
            return kept
        out.append("R")
        return follows


def unroll(runs: Runs, state: int = START, after: Sequence[int] = END, last: bool = True) -> tuple[str, int]:
    """The least of the cheapest audits from ``state``, with the costs ``after`` the rows; and the state behind them.
    ``last``: the conversation ends here, so inserts may follow."""
    parts = run_powers(runs)
    behind = [tuple(after)]
    for s, k in reversed(parts):
        behind.append(through(power(s, k), behind[-1]))
    behind.reverse()
    out: list[str] = []
    for (s, k), costs in zip(parts, behind[1:], strict=True):
        state = unroll_power(s, k, state, costs, out)
    while last and state not in (START, AFTER_A):
        out.append("I")
        state = WANTED[state][1]
    return "".join(out), state


@lru_cache(maxsize=1 << 14)
def solved(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return through(transition(list(runs)), END)[START], unroll(list(runs))[0]


def repaired(audit: str, rows: Iterable[tuple[str, str, int]], state: int = START) -> Iterator[str]:
    """The lines that stay: ``audit`` over rows of (role, text, copies)."""
    copies = ((role, text) for role, text, n in rows for _ in range(n))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(copies)
        if edit == "D":
            continue
        wanted, follows = WANTED[state]
        if edit == "K":
            state = keeps(state, role[:1])
        else:
            role, state = wanted, follows
        yield f"{role}:{text}"


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repair(rows: list[tuple[int | None, str, str, bool, bool]]) -> tuple:
    """``COUNTS``, audit and digest of one conversation: (turn, role, text, blank, ended) in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text, blank, ended in rows:
        key = (role, text)
        faults.append("blank" if blank else "duplicate" if key in seen else "" if ended else "truncated")
        seen.add(key)
    kinds = {"blank": BROKEN, "duplicate": BROKEN, "truncated": TRUNCATED, "": CLEAN}
    runs = run_lengths((symbol_of(r[1], kinds[f]), 1) for r, f in zip(rows, faults, strict=True))
    cost, audit = solved(tuple(runs))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(repaired(audit, ((r[1], r[2], 1) for r in rows))).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal_pairs([r[1][:1] for r in rows]), cost, audit, digest)


# --- on Spark


def damaged(table: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` after the damage, rows that it drops as ``gone`` (without text)."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = table.select("conv_id", F.col("turn").cast("long").alias("turn"), words("role").alias("role"), words("text").alias("text"),
                        (F.crc32(F.concat(words("conv_id"), F.lit(":"), words("turn")).cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d").isin(0, 1), "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("_d") == 0).alias("gone"), copies.alias("_n")).drop("_n")


def with_marks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("blank", ~F.col("text").rlike(FILLED)).withColumn("ended", F.col("text").rlike(ENDED))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair_conversations(rows: DataFrame, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``conv_id``, ``COUNTS``, ``audit`` and ``repaired_sha256`` for every conversation of ``rows`` (``conv_id``, ``turn``
    long, ``role`` and ``text`` not null, ``gone``: the row only names its conversation)."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    hot = stored(sizes.filter((F.col("n") > hot_rows) | (F.col("b") > hot_bytes)).withColumnRenamed("conv_id", "_hot"))
    if hot.isEmpty():
        return _whole(rows)
    size = hot.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    parts = 2 + size["n"] // hot_rows + (size["b"] or 0) // hot_bytes
    hot = hot.select("_hot")
    of_hot = lambda how: join_bounded(rows, hot, _same("conv_id", "_hot"), how)
    return _whole(of_hot("left_anti")).unionByName(_split(of_hot("left_semi"), hot, parts))


def _schema(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit in a task, each gathered in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, out = [], []
        own: list[tuple] = []
        current: list = []  # the conversation being read

        def done() -> None:
            ids.append(current[0])
            out.append(repair(own))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        id_type = None
        for batch in batches:
            id_type = batch.column("conv_id").type
            for conv, gone, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "blank", "ended")), strict=True):
                if not current or conv != current[0]:
                    if current:
                        done()
                    current, own = [conv], []
                if not gone:
                    own.append(tuple(row))
            if len(out) > 1000:
                yield batch_of()
                ids, out = [], []
        if current:
            done()
        if out:
            yield batch_of()

    order = ["conv_id", "turn", "role", "text"]
    return with_marks(rows).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, _schema(rows))


def _split(rows: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Hot conversations, dealt by range over so many tasks."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    left = with_marks(rows.filter("not gone").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    left = left.withColumn("_h", F.sha2("text", 256))
    first = left.filter("not blank").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_h").alias("_t")).agg(F.min(place).alias("_first"))
    marked = left.join(first, _same("conv_id", "_c") & (F.col("role") == F.col("_r")) & (F.col("_h") == F.col("_t")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "copies", "blank", "ended", F.coalesce(F.col("_first") == place, F.lit(False)).alias("fresh"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = stored(marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())

    summary = stored(dealt.drop("text").mapInArrow(_stretches(_summary), f"part int, conv_id {id_type}, matrix array<long>, first string, last string, {', '.join(f'{c} long' for c in COUNTS[1:5])}"))
    ends = summary.groupBy("conv_id").applyInPandas(_costs_behind, f"part int, conv_id {id_type}, after array<long>, last boolean")
    known = stored(ends)
    follow = dealt.drop("text").join(F.broadcast(known.withColumnsRenamed({"part": "_p", "conv_id": "_c"})), (F.col("part") == F.col("_p")) & _same("conv_id", "_c")).drop("_p", "_c")
    exits = follow.mapInArrow(_stretches(_exits), f"part int, conv_id {id_type}, exits array<long>")  # as many rows as stretches
    begins = stored(exits.groupBy("conv_id").applyInPandas(_states_before, f"part int, conv_id {id_type}, state long"))
    both = known.join(begins.withColumnsRenamed({"part": "_p", "conv_id": "_c"}), (F.col("part") == F.col("_p")) & _same("conv_id", "_c")).drop("_p", "_c")
    told = dealt.join(F.broadcast(both.withColumnsRenamed({"part": "_p", "conv_id": "_c"})), (F.col("part") == F.col("_p")) & _same("conv_id", "_c")).drop("_p", "_c")
    pieces = stored(told.mapInArrow(_stretches(_pieces), f"part int, conv_id {id_type}, n long, audit string, lines binary"))

    audit = pieces.filter("audit is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    digest = pieces.filter("lines is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "n").mapInArrow(_digests, f"conv_id {id_type}, repaired_sha256 string")
    turns = left.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("_")).groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    totals = summary.groupBy("conv_id").applyInPandas(_totals, f"conv_id {id_type}, {', '.join(f'{c} long' for c in COUNTS[1:])}")
    out = hot.withColumnRenamed("_hot", "conv_id")
    for table in (gaps, totals, audit, digest):
        out = out.join(table.withColumnRenamed("conv_id", "_c"), _same("conv_id", "_c"), "left").drop("_c")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


def _stretches(give):
    """Calls ``give`` with (part, conv_id, rows as dictionaries one by one) for each stretch of a conversation in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda r: (r["part"], r["conv_id"])
        types = {}

        def rows() -> Iterator[dict]:
            for batch in batches:
                types["conv_id"] = batch.column("conv_id").type
                for lo in range(0, batch.num_rows, 256):
                    yield from batch.slice(lo, 256).to_pylist()

        for (part, conv), own in groupby(rows(), key=key):
            for record in give(own):
                table = pa.RecordBatch.from_pylist([{"part": part, "conv_id": conv} | record])
                at = {f.name: f.type for f in table.schema} | {"part": pa.int32(), "conv_id": types["conv_id"], "audit": pa.string(), "lines": pa.binary()}
                yield pa.RecordBatch.from_pylist([{"part": part, "conv_id": conv} | record], pa.schema([(n, at[n]) for n in table.schema.names]))

    return run


def _symbols(row: dict) -> list[tuple[str, int]]:
    """The symbols of a row and its copies: the first copy of a text's first row may stay, all others have to go."""
    if row["blank"] or not row["fresh"]:
        return [(symbol_of(row["role"], BROKEN), row["copies"])]
    own = (symbol_of(row["role"], CLEAN if row["ended"] else TRUNCATED), 1)
    return [own, (symbol_of(row["role"], BROKEN), row["copies"] - 1)][: 1 + (row["copies"] > 1)]


def _joined(runs: Runs, more: Iterable[tuple[str, int]]) -> None:
    for s, n in more:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + n)
        else:
            runs.append((s, n))


def _summary(rows: Iterator[dict]) -> Iterator[dict]:
    runs: Runs = []
    counts = dict.fromkeys(COUNTS[1:5], 0)
    first = before = None
    for r in rows:
        n, initial = r["copies"], r["role"][:1]
        fresh = 0 if r["blank"] or not r["fresh"] else 1
        counts["blank"] += n if r["blank"] else 0
        counts["duplicate"] += 0 if r["blank"] else n - fresh
        counts["truncated"] += 0 if r["ended"] else fresh
        counts["illegal"] += n - 1 + (before is not None and before + initial not in ("su", "ua", "au"))
        first, before = initial if first is None else first, initial
        _joined(runs, _symbols(r))
    yield {"matrix": [x for row in transition(runs) for x in row], "first": first, "last": before} | counts


def _matrix(flat: Sequence[int]) -> Matrix:
    return tuple(tuple(int(x) for x in flat[4 * i : 4 * i + 4]) for i in STATES)


def _costs_behind(stretches: pd.DataFrame) -> pd.DataFrame:
    own = stretches.sort_values("part")
    after, costs = [], END
    for m in reversed(own["matrix"].tolist()):
        after.append(list(costs))
        costs = through(_matrix(m), costs)
    return pd.DataFrame({"part": own["part"], "conv_id": own["conv_id"], "after": after[::-1], "last": [False] * (len(own) - 1) + [True]})


def _totals(stretches: pd.DataFrame) -> pd.DataFrame:
    own = stretches.sort_values("part")
    whole = tuple(tuple(0 if i == j else INF for j in STATES) for i in STATES)
    for m in own["matrix"]:
        whole = product(whole, _matrix(m))
    borders = sum(a + b not in ("su", "ua", "au") for a, b in zip(own["last"].iloc[:-1], own["first"].iloc[1:], strict=True))
    out = own[COUNTS[1:5]].sum().to_dict()
    return pd.DataFrame([{"conv_id": own["conv_id"].iloc[0]} | out | {"illegal": out["illegal"] + borders, "cost": through(whole, END)[START]}])


def _exits(rows: Iterator[dict]) -> Iterator[dict]:
    runs: Runs = []
    after = None
    for r in rows:
        after = r["after"]
        _joined(runs, _symbols(r))
    reach = transition(runs)
    yield {"exits": [unroll(runs, s, after, last=False)[1] if min(a + b for a, b in zip(reach[s], after, strict=True)) < INF else s for s in STATES]}


def _states_before(stretches: pd.DataFrame) -> pd.DataFrame:
    own = stretches.sort_values("part")
    states, state = [], START
    for exits in own["exits"]:
        states.append(state)
        state = int(exits[state])
    return pd.DataFrame({"part": own["part"], "conv_id": own["conv_id"], "state": states})


def _pieces(rows: Iterator[dict]) -> Iterator[dict]:
    """The audit of a stretch, and its repaired lines in pieces, each line with its newline.

    The edits need the costs behind the rows, so texts wait in order while the runs are read."""
    runs: Runs = []
    held = []
    r = None
    for r in rows:
        _joined(runs, _symbols(r))
        held.append((r["role"], r["text"], r["copies"]))
    audit, _ = unroll(runs, r["state"], r["after"], r["last"])
    yield {"n": 0, "audit": audit, "lines": None}
    n, size, lines = 1, 0, []
    for line in repaired(audit, held, r["state"]):
        lines.append(line + "\n")
        size += len(line)
        if size > PIECE:
            yield {"n": n, "audit": None, "lines": "".join(lines).encode()}
            n, size, lines = n + 1, 0, []
    if lines:
        yield {"n": n, "audit": None, "lines": "".join(lines).encode()}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the pieces of each conversation, without the last newline; one piece is held."""
    current: list = []
    state, tail = None, b""

    def result(ids: pa.DataType) -> pa.RecordBatch:
        state.update(tail[:-1])
        return pa.RecordBatch.from_arrays([pa.array(current, ids), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    for batch in batches:
        ids = batch.column("conv_id").type
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines"), strict=True):
            if not current or conv != current[0]:
                if current:
                    yield result(ids)
                current, state, tail = [conv], hashlib.sha256(), b""
            state.update(tail)
            tail = lines.as_py()
    if current:
        yield result(ids)


def digest(table: DataFrame) -> DataFrame:
    """Columns of the registered query: the damaged conversations and their repair."""
    return repair_conversations(damaged(table))


def _sql() -> str:
    """The same in one recursive query: the cheapest (cost, audit) of each state as a text that sorts by both."""
    wanted = {s: t for s, (_, t) in WANTED.items()}
    add = lambda x, cost, edits: f"lpad(((substr({x}, 1, 12))::BIGINT + {cost})::VARCHAR, 12, '0') || substr({x}, 13) || '{edits}'"
    # states after any inserts: one or two are enough
    ready = {s: [f"q{s}"] for s in STATES}
    for s in STATES:
        t = wanted[s]
        ready[t].append(add(f"q{s}", INSERT, "I"))
        ready[wanted[t]].append(add(f"q{s}", 2 * INSERT, "II"))
    least = lambda options: f"least({', '.join(options)})"
    inserted = ", ".join(f"{least(ready[s])} AS p{s}" for s in STATES)
    into: dict[int, list[str]] = {s: [add(f"p{s}", DELETE, "D")] for s in STATES}
    for s in STATES:
        into[wanted[s]].append(f"CASE WHEN NOT broken THEN {add(f'p{s}', '1 + extra', 'R')} END")
        into[wanted[s]].append(f"CASE WHEN NOT broken AND i = '{WANTED[s][0][0]}' THEN {add(f'p{s}', 'extra', 'K')} END")
    into[AFTER_S].append(f"CASE WHEN NOT broken AND i = 's' THEN {add('p0', 'extra', 'K')} END")
    stepped = ", ".join(f"{least(into[s])} AS q{s}" for s in STATES)
    ends = least(["q0", "q3", add("q2", INSERT, "I"), add("q1", 2 * INSERT, "II")])
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT FOR b IN range(8)]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (
  SELECT conv_id, turn, role, text,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(key, '')]), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 AS kind
  FROM k, crc),
a AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, range(2) AS copies(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM a),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS ended
  FROM p),
f AS (SELECT *, left(role, 1) AS i, blank OR again AS broken, CASE WHEN ended THEN 0 ELSE {CUT_OFF} END AS extra, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000000' AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3 FROM f
  UNION ALL
  SELECT conv_id, n, {stepped} FROM (SELECT f.*, {inserted} FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = r.n + 1)),
e AS (SELECT conv_id, arg_max({ends}, n) AS q FROM r GROUP BY conv_id),
u AS (SELECT conv_id, p, substr(q, 12 + p::INT, 1) AS edit, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS place
  FROM (SELECT conv_id, q, unnest(range(1, length(q) - 11)) AS p FROM e) WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
l AS (SELECT u.*, f.role, f.text, max(CASE WHEN place = 1 AND edit = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id) AS system
  FROM u LEFT JOIN f ON u.conv_id IS NOT DISTINCT FROM f.conv_id AND u.n = f.n AND u.edit <> 'I'),
s AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS digest
  FROM l WHERE edit <> 'D' GROUP BY conv_id),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (NOT broken AND NOT ended) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(substr(q, 1, 12)::BIGINT, 0)::BIGINT AS cost, coalesce(substr(q, 13), '') AS audit, coalesce(digest, '{NOTHING}') AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) b LEFT JOIN c ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN e ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN s ON b.conv_id IS NOT DISTINCT FROM s.conv_id
"""


SQL = _sql()
