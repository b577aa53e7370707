"""Repair of the turn structure of conversations, by alignment with target strings.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Turns may be kept (cost 0), given another of
the roles user and assistant (R, 2), deleted (D, 3; blank turns and repeated ones must be) and inserted without text (I, 2); a
turn that stays and whose text breaks off adds 1. The cheapest edits are found by Wagner and Fischer's table of turns
against target symbols. The targets of all feasible lengths end alike and alternate, so they are suffixes of one string
and share one table, built from the last turn on: its cell (i, r) is the least cost of aligning the turns from i on with the
last r symbols. Ukkonen's band keeps the cells that can still be as cheap as the incumbent, a simple left-to-right repair. Every
feasible length of the least cost is traced back from the first turn, by the least letter that is optimal, and of
these audits the least in ASCII order counts.

How it is spread: faults and order come from column expressions on rows without text. These are sorted by ranges of (conv_id,
turn), so that one conversation may lie in many tasks, and written as runs of at most ``SEGMENT`` turns, a letter for each.
A conversation of one run is aligned at once. For longer ones each run gives the least costs between the grammar's four
states (nothing, after s, u, a), these are chained by a stream that holds four numbers, and each run is traced from each
state, both in parallel. Inserts stand before a turn of the same run, or after the last turn, so audits of runs add up. Repaired
turns are streamed by conversation, batch by batch; only the audit, a letter a turn, is held as a whole, as it is one cell
of the result.

Defined results: a null role or text is one space; a null conv_id is a conversation of its own; turns are ordered by number
(nulls first), then role, then MD5 of the text, by which texts are told apart; equal rows are repeated turns; roles
other than those with the initials s, u, a never fit; other columns are ignored; a conversation none of whose turns is
given has no row; empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarflow.llm.common import materialise

SEGMENT = 512
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1
INITIALS, FAULTS = "sua", ("", "blank", "duplicate", "truncated")
VISIBLE = "[^\\x20\\x09-\\x0D]"
#: What is still to be inserted in each state behind the last turn, and its cost.
ENDS = ("", "II", "I", "")
AFTER = tuple(INSERT * len(x) for x in ENDS)
NEVER = float("inf")
#: State reached by a symbol.
REACHED = {"s": 1, "u": 2, "a": 3}
ROLE = {"u": "user", "a": "assistant"}


def letter(initial: Column, fault: Column) -> Column:
    """One letter, A to P, for the role's initial (s, u, a, other) and the fault (see FAULTS)."""
    i = F.coalesce(F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2), F.lit(3))
    return F.char(i * 4 + fault + ord("A"))


def read(run: str) -> list[tuple[str, bool, int]]:
    """Of each turn of a run of letters: its initial, whether it must go, and what it costs if it stays."""
    numbers = [ord(c) - ord("A") for c in run]
    return [("suao"[n // 4], n % 4 in (1, 2), BROKEN * (n % 4 == 3)) for n in numbers]


def expected(state: int) -> str:
    return "a" if state == 2 else "u"


def incumbent(turns: list[tuple[str, bool, int]], state: int, after: tuple) -> float:
    """The cost of a repair from left to right, which inserts what a turn waits for."""
    cost = 0.0
    for initial, gone, extra in turns:
        if gone:
            cost += DELETE
        elif initial == "s" and state == 0:
            cost, state = cost + extra, 1
        elif initial == expected(state):
            cost, state = cost + extra, REACHED[initial]
        elif initial in ROLE:
            cost, state = cost + extra + INSERT, REACHED[initial]
        else:
            cost, state = cost + extra + REROLE, REACHED[expected(state)]
    return cost + after[state]


class Alignment:
    """Tables of a run of turns for targets that end in ``state``; ``after`` is the cost behind it, ``limit`` the incumbent's."""

    def __init__(self, turns: list[tuple[str, bool, int]], state: int, after: float, limit: float):
        self.turns, self.state, n = turns, state, len(turns)
        slack = limit - after - DELETE * sum(gone for _, gone, _ in turns)
        self.cells: list[dict[int, float]] = [{} for _ in range(n)] + [{0: after}]
        self.fronted: list[dict[int, float]] = [{} for _ in range(n + 1)]  # the same behind a kept s
        if slack < 0:
            self.cells[n] = {}
            return
        more, less, free = int(slack // INSERT), int(slack // DELETE), 0
        for i in range(n - 1, -1, -1):
            initial, gone, extra = turns[i]
            free += not gone
            below, here = self.cells[i + 1], self.cells[i]
            left = NEVER
            for r in range(max(0, free - less), (free + more if state > 1 else 0) + 1):
                cost = below.get(r, NEVER) + DELETE
                if r:
                    cost = min(cost, left + INSERT)
                    if not gone:
                        cost = min(cost, below.get(r - 1, NEVER) + extra + REROLE * (initial != self.symbol(r)))
                left = cost
                if cost <= limit:
                    here[r] = cost
            front = {r: c + DELETE for r, c in self.fronted[i + 1].items() if c + DELETE <= limit}
            if initial == "s" and not gone:
                for r, c in below.items():
                    front[r] = min(front.get(r, NEVER), c + extra)
            self.fronted[i] = front

    def symbol(self, r: int) -> str:
        """The symbol that ``r`` symbols before the end begin with."""
        return "au"[(r + self.state) % 2]

    def feasible(self, entry: int) -> Iterator[tuple[bool, int, float]]:
        """(behind an s, number of further symbols, cost) of the targets that lead from ``entry`` to the table's state."""
        for front, cells in ((False, self.cells[0]), (True, self.fronted[0])):
            begin = 1 if front else entry
            if front and entry != 0:
                continue
            for r, cost in cells.items():
                if self.state == begin if r == 0 else self.symbol(r) == expected(begin):
                    yield front, r, cost

    def trace(self, front: bool, r: int) -> str:
        """The least audit of the least cost."""
        out, i, n = [], 0, len(self.turns)
        while i < n:
            initial, gone, extra = self.turns[i]
            cells, below = (self.fronted[i], self.fronted[i + 1]) if front else (self.cells[i], self.cells[i + 1])
            cost = cells[r]
            if below.get(r) == cost - DELETE:
                out.append("D")
                i += 1
            elif front:
                out.append("K")
                front, i = False, i + 1
            elif r and cells.get(r - 1) == cost - INSERT:
                out.append("I")
                r -= 1
            else:
                out.append("K" if initial == self.symbol(r) else "R")
                r, i = r - 1, i + 1
        return "".join(out)


def _best(run: str, entry: int, after: tuple) -> tuple[float, str, int]:
    turns = read(run)
    limit = incumbent(turns, entry, after)
    tables = [Alignment(turns, state, after[state], limit) for state in range(4)]
    found = [(cost, front, r, t) for t in tables for front, r, cost in t.feasible(entry)]
    least = min(cost for cost, *_ in found)
    return min((cost, t.trace(front, r), t.state) for cost, front, r, t in found if cost == least)


@lru_cache(100_000)
def _remembered(run: str, entry: int, after: tuple) -> tuple[float, str, int]:
    return _best(run, entry, after)


def best(run: str, entry: int = 0, after: tuple = AFTER) -> tuple[float, str, int]:
    """(cost, audit, last state) of the cheapest edits of a run from a state; ``after`` has the cost behind each last state."""
    return (_remembered if len(run) <= 16 else _best)(run, entry, tuple(after))


def costs(run: str) -> list[float]:
    """The least costs of a run between the four states, row by row; the band is widened until it holds them."""
    turns, out = read(run), []
    table = {}
    for entry in range(4):
        for state in range(4):
            limit = DELETE * len(turns) + 8 if state < 2 else DELETE * sum(gone for _, gone, _ in turns) + 8
            while True:
                if (state, limit) not in table:
                    table[state, limit] = Alignment(turns, state, 0, limit)
                least = min((cost for *_, cost in table[state, limit].feasible(entry)), default=NEVER)
                if least <= limit or limit > (DELETE + REROLE) * len(turns) + 8:
                    break
                limit *= 2
            out.append(least)
    return out


def ordered(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, _md5) with nulls replaced, of the turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.md5(text.cast("binary")).alias("_md5"))


ORDER = ["turn", "role", "_md5"]


def faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, _md5, n, _first, _other): each different turn of a conversation once, how often it comes,
    and the letters of the first of them and of the others."""
    last = F.regexp_extract("text", "(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    rows = turns.select("conv_id", *ORDER, F.when(~F.col("text").rlike(VISIBLE), 1).when(~last.isin(".", "!", "?"), 3).otherwise(0).alias("_own"))
    rows = materialise(rows.groupBy("conv_id", *ORDER, "_own").agg(F.count("*").alias("n")), "turns")
    first = rows.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_md5").alias("_m")).agg(F.min(F.struct("turn")).alias("_least"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_md5") == F.col("_m"))
    new, blank = F.struct("turn") == F.col("_least"), F.col("_own") == 1
    initial = F.substring("role", 1, 1)
    return rows.join(first, same).select(
        "conv_id", *ORDER, "n", letter(initial, F.when(blank | new, F.col("_own")).otherwise(2)).alias("_first"),
        letter(initial, F.when(blank, 1).otherwise(2)).alias("_other"))


def _pieces(rows: Iterator[tuple]) -> Iterator[str]:
    """Runs of at most SEGMENT letters."""
    held, size = [], 0
    for n, first, other in rows:
        more = n - 1
        held.append(first)
        size += 1
        while more or size >= SEGMENT:
            take = min(more, SEGMENT - size)
            held.append(other * take)
            size, more = size + take, more - take
            if size >= SEGMENT:
                yield "".join(held)
                held, size = [], 0
    if size:
        yield "".join(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def streamed(df: DataFrame, columns: list[tuple[str, str]], make) -> DataFrame:
    """``make`` turns an iterator of rows into one of rows (conv_id, *columns)."""
    schema = T.StructType([df.schema["conv_id"], *[T.StructField(n, T._parse_datatype_string(t)) for n, t in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        return _batches(make(_rows(batches)), arrow)

    return df.mapInArrow(run, schema)


def by_conversation(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def segments(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, part, seq, run) of the letters of each conversation in order."""
    rows = materialise(faults(turns), "faults")
    ranged = rows.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER).select("conv_id", "n", "_first", "_other")

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for conv, turns_of in groupby(rows, key=lambda r: r[0]):
            for seq, run in enumerate(_pieces(r[1:] for r in turns_of)):
                yield conv, part, seq, run

    return materialise(streamed(ranged, [("part", "int"), ("seq", "long"), ("run", "string")], make), "segments")


COUNTS = [("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string")]


def counted(runs: Iterator[str]) -> list[int]:
    """Blank, duplicate and truncated turns and illegal neighbours in the runs of a conversation."""
    out, last = [0, 0, 0, 0], ""
    for run in runs:
        for fault in (1, 2, 3):
            out[fault - 1] += sum(run.count(chr(ord("A") + 4 * i + fault)) for i in range(4))
        initials = last + "".join("suao"[(ord(c) - ord("A")) // 4] for c in run)
        out[3] += sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
        last = initials[-1:]
    return out


def _single(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, run in rows:
        cost, audit, state = best(run)
        yield conv, *counted(iter([run])), int(cost), audit + ENDS[state]


def _costs(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, part, seq, run in rows:
        yield conv, part, seq, run, [None if c == NEVER else int(c) for c in costs(run)]


def _backwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From the last run of a conversation to the first: the costs behind each run."""
    for conv, runs in groupby(rows, key=lambda r: r[0]):
        after = list(AFTER)
        for _, part, seq, run, between in runs:
            yield conv, part, seq, run, after
            cells = [NEVER if c is None else c for c in between]
            after = [int(min(cells[4 * e + x] + after[x] for x in range(4))) for e in range(4)]


def _traced(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, part, seq, run, after in rows:
        found = [best(run, entry, tuple(after)) for entry in range(4)]
        yield conv, part, seq, run, [int(f[0]) for f in found], [f[1] for f in found], [f[2] for f in found]


def _forwards(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, runs in groupby(rows, key=lambda r: r[0]):
        state, audit, cost = 0, [], None

        def letters() -> Iterator[str]:
            nonlocal state, cost
            for _, _, _, run, totals, audits, states in runs:  # noqa: B023
                cost = totals[0] if cost is None else cost
                audit.append(audits[state])  # noqa: B023
                state = states[state]
                yield run

        counts = counted(letters())
        yield conv, *counts, cost, "".join(audit) + ENDS[state]


def report(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations that have turns."""
    turns = ordered(turns)
    runs = segments(turns)
    many = runs.groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_runs")).where("_runs > 1")
    long = runs.join(many, F.col("conv_id").eqNullSafe(F.col("_c"))).select(*runs.columns)
    short = runs.join(many, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    step = [("part", "int"), ("seq", "long"), ("run", "string")]
    between = streamed(long, [*step, ("between", "array<long>")], _costs)
    after = streamed(by_conversation(between, F.desc("part"), F.desc("seq")), [*step, ("after", "array<long>")], _backwards)
    traced = streamed(after.repartition("conv_id", "part", "seq"),
                      [*step, ("totals", "array<long>"), ("audits", "array<string>"), ("states", "array<int>")], _traced)
    found = streamed(short.select("conv_id", "run"), COUNTS, _single) \
        .unionByName(streamed(by_conversation(traced, "part", "seq"), COUNTS, _forwards))
    gaps = turns.groupBy(F.col("conv_id").alias("_c")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "gaps", *[n for n, _ in COUNTS])


def _applied(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired turns of conversations that come as their audit, then their turns in order."""
    for conv, items in groupby(rows, key=lambda r: r[0]):
        edits = iter(next(items)[1] or "")
        state = place = 0
        for _, _, turn, role, text in chain(items, [(conv, None, None, None, None)]):
            for edit in edits:
                if edit == "D":
                    break
                symbol = role[:1] if edit == "K" else expected(state)
                made = edit != "K"
                yield conv, place, None if edit == "I" else turn, edit, ROLE[symbol] if made else role, "" if edit == "I" else text
                state, place = REACHED[symbol], place + 1
                if edit != "I":
                    break


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows (conv_id, place, turn, edit, role, text) of the repaired conversations, from their audits (conv_id, audit). The turns of a
    conversation stand in one partition, together and in order; an inserted turn has no number."""
    kind = turns.schema["turn"].dataType
    first = audits.select("conv_id", "audit", F.lit(None).cast(kind).alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "_md5")])
    rows = ordered(turns).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "_md5")
    together = by_conversation(first.unionByName(rows), F.col("audit").isNull(), *ORDER).drop("_md5")
    return streamed(together, [("place", "long"), ("turn", kind.simpleString()), ("edit", "string"), ("role", "string"), ("text", "string")], _applied)


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, turns in groupby(rows, key=lambda r: r[0]):
        digest, between = hashlib.sha256(), ""
        for _, role, text in turns:
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        yield conv, digest.hexdigest()


def digests(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256) of repaired turns: the SHA-256 of their ``role:text``, joined by newlines, turn by turn."""
    return streamed(rows.select("conv_id", "role", "text"), [("repaired_sha256", "string")], _hashed)
