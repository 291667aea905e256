"""Repair of conversations: the cheapest edits after which roles alternate, by a run-length DP.

A repaired conversation has role initials ``(s?(ua)+)?``.  A row is kept (free),
given the role that is due (1) or deleted (2, the only way for a blank or repeated
row); turns without text may be put in anywhere (5); a truncated row that stays
costs 5 more.  Edits are named by their initials, K, R, D, I; what an edit does
follows from its place, as only one role is due there, so the letters are the
whole repair.  Among the cheapest repairs the one of least letters (ASCII) is
taken.

Rows become symbols of role and fault, and equal consecutive symbols one run.  A
symbol is a 4 x 4 transition over (min, +) between the grammar's states; a run of
n is its n-th power, put together from powers of two that the worker keeps.  Costs
to go are advanced over runs from the end of the conversation to its front.  Then
choices are unrolled front to back: a run falls into blocks of powers of two, a
block into halves, with the costs to go between them; equal blocks (symbol, size,
costs, state) are unrolled once.

Spark deals rows out by conversation and sorts them; a task holds one conversation
at a time.  A conversation is one value of the result, so its rows meet in one
task; its length is the only bound on that.

Defined results: rows go by turn, nulls first, then role, then text; a null role
or text is one blank; a null conv_id is a conversation; roles count by their first
character, in its own case, and any other than s, u, a (or none) is never kept; a
row has the first of the faults blank, duplicate (role and text seen earlier in
the conversation), truncated (its last character that is no blank is none of
``.!?``); null turns leave no gaps; a conversation of which no row is present has
zeros, no letters and no turns; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, internal, partitions

RETYPE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's; the state that a turn put in leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Turns that must be put in after the last row, by state.
MISSING = (0, 2, 1, 0)
NEVER = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
OUT = "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<role:string,text:string>>"

Symbol = tuple[str, str]  # first character of the role; fault: "" or "cut" or "gone"
Vector = tuple[int, ...]


@lru_cache(None)
def steps(symbol: Symbol) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """By state: (letter, next state, cost) of what may become of a row, in ASCII order of letters."""
    initial, fault = symbol
    more = CUT if fault == "cut" else 0

    def of(state: int) -> Iterator[tuple[str, int, int]]:
        yield "D", state, DELETE
        if fault != "gone":
            if (state, initial) in KEPT:
                yield "K", KEPT[state, initial], more
            yield "R", DUE[state], RETYPE + more

    return tuple(tuple(of(s)) for s in range(4))


@lru_cache(4096)
def power(symbol: Symbol, k: int) -> tuple[Vector, ...]:
    """The least costs from state to state over 2^k rows of a symbol, turns put in before each of them."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[i][m] + half[m][j] for m in range(4)) for j in range(4)) for i in range(4))
    out = [[NEVER] * 4 for _ in range(4)]
    for i in range(4):
        at, spent = i, 0
        for _ in range(3):  # two turns put in reach all states that can be reached
            for _, j, cost in steps(symbol)[at]:
                out[i][j] = min(out[i][j], spent + cost)
            at, spent = DUE[at], spent + INSERT
    return tuple(map(tuple, out))


def before(matrix: tuple[Vector, ...], after: Vector) -> Vector:
    return tuple(min(c + a for c, a in zip(row, after)) for row in matrix)


def advanced(symbol: Symbol, n: int, after: Vector) -> Vector:
    """Costs to go before ``n`` rows of a symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = before(power(symbol, k), after)
    return after


def _one(symbol: Symbol, after: Vector, state: int) -> tuple[str, int]:
    """Letters up to and with one row, and the state they lead to."""
    now, out = before(power(symbol, 0), after), ""
    while True:
        for letter, following, cost in steps(symbol)[state]:
            if letter > "I" and INSERT + now[DUE[state]] == now[state]:
                break
            if cost + after[following] == now[state]:
                return out + letter, following
        out, state = out + "I", DUE[state]


#: Blocks of up to 2^10 rows are remembered.
REMEMBERED = 10


def _block(symbol: Symbol, k: int, after: Vector, state: int) -> tuple[str, int]:
    low = min(after)
    after = tuple(a - low for a in after)  # choices depend on differences alone
    return (_known if k <= REMEMBERED else _halves)(symbol, k, after, state)


def _halves(symbol: Symbol, k: int, after: Vector, state: int) -> tuple[str, int]:
    if not k:
        return _one(symbol, after, state)
    first, state = _block(symbol, k - 1, before(power(symbol, k - 1), after), state)
    second, state = _block(symbol, k - 1, after, state)
    return first + second, state


_known = lru_cache(1 << 14)(_halves)


def cheapest(symbols: list[Symbol]) -> tuple[int, str]:
    """Cost and letters of the repair of a conversation of these symbols."""
    runs = [(s, sum(1 for _ in own)) for s, own in groupby(symbols)]
    after = [tuple(INSERT * m for m in MISSING)]
    for symbol, n in reversed(runs):
        after.append(advanced(symbol, n, after[-1]))
    out, state, cost = [], START, after[-1][START]
    for (symbol, n), end in zip(runs, reversed(after[:-1])):
        blocks = [k for k in range(n.bit_length()) if n >> k & 1]
        ends = [end]
        for k in blocks[:-1]:  # the smallest block comes last
            ends.append(before(power(symbol, k), ends[-1]))
        for k, then in zip(reversed(blocks), reversed(ends)):
            letters, state = _block(symbol, k, then, state)
            out.append(letters)
    return cost, "".join(out) + "I" * MISSING[state]


def edited(rows: list[tuple[str, str]], letters: str) -> list[dict[str, str]]:
    """The turns (role, text) that letters make of rows."""
    out, state, at = [], START, iter(rows)
    for letter in letters:
        role, text = next(at) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, role[:1]]
        else:
            state = DUE[state]
            role = ROLE[state]
        out.append({"role": role, "text": text})
    return out


def _repaired(turns: list[int | None], rows: list[tuple[str, str]]) -> list:
    """One conversation's columns of ``OUT``."""
    seen: set[tuple[str, str]] = set()
    counts, symbols = {"blank": 0, "duplicate": 0, "cut": 0, "": 0}, []
    for row in rows:
        last = row[1].rstrip(BLANKS)[-1:]
        fault = "blank" if not last else "duplicate" if row in seen else "" if last in ".!?" else "cut"
        seen.add(row)
        counts[fault] += 1
        symbols.append(("", "gone") if fault in ("blank", "duplicate") else (row[0][:1], fault))
    cost, letters = cheapest(symbols)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [len(rows), gaps, counts["blank"], counts["duplicate"], counts["cut"], illegal, cost, letters, edited(rows, letters)]


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """A row for each conv_id of ``turns`` (conv_id, turn, role, text).

    n_rows, gaps (turns missing between first and last), blank, duplicate,
    truncated (rows by first fault), illegal (neighbours whose initials are none of
    su, ua, au), cost, audit (letters), turns (the repaired role and text).  Rows
    where ``present`` does not hold name their conversation only.
    """
    known, gone = (internal(["conv_id", "turn", "role", "text"], n) for n in ("known", "gone"))
    kind = turns.schema["conv_id"].dataType
    absent = F.lit(False) if present is None else ~F.coalesce(present, F.lit(False))
    text = lambda c: F.when(~absent, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", F.col("conv_id").isNotNull().alias(known), absent.alias(gone), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # a null id is grouped by the flag beside it, as a missing value equals nothing
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    rows = rows.repartition(partitions(turns.sparkSession), known, "key").sortWithinPartitions(known, "key", gone, F.col("turn").asc_nulls_first(), "role", "text")
    schema = pa.schema([("n_rows", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in groups(batches, [known, "key"]):
            there = own.filter(pa.compute.invert(own.column(2)))
            made = _repaired(there.column(3).to_pylist(), list(zip(there.column(4).to_pylist(), there.column(5).to_pylist())))
            yield pa.RecordBatch.from_arrays([own.column(0).slice(0, 1), *[pa.array([v], f.type) for v, f in zip(made, schema)]], names=["conv_id", *schema.names])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, {OUT}")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults set by crc32(conv_id:turn) % 20, and ``present``.

    0 drops a row (it stays, not present), 1 empties its text, 2 takes ``.!?`` out of
    it, 3 repeats it, 4 makes it the user's; nulls count as one blank, in the key too.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), copies.alias("copy")).drop("copy")
