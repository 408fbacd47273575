"""Conversation structure repair: the cheapest edits that make the roles alternate.

Rows are first damaged by a fixed rule (`damage`); `repair` takes any table of
conv_id, turn, role, text. A conversation's role initials must become
`(s?(ua)+)?`. Edits and audit letters, with their costs: Keep 0, Rerole to user or
assistant 2, Delete 3 (the only choice for blank and duplicate rows), Insert an
empty user or assistant row 2; a truncated row that is not deleted adds 1. Among
the cheapest edits the ASCII-least audit wins.

The choice is one integer-minimum dynamic program over a DAG whose nodes are
(row, state of the pattern). An edge is a row's edit with at most one insertion
before it, and weighs a single integer: the cost in the high digits, and in the low
digits a fixed-width slot of two base-8 digits per row, holding the audit letters
(D 1, I 2, K 3, R 4, in ASCII order) with zeros at the end of the slot. Letters
before a difference are equal, a slot starts with its insertion, and only I starts
a slot of two letters; so slots compare as the joined letters do, and the plain
minimum gives the least cost first and the least audit next. (Two insertions in a
row are never cheapest: without them the pattern still holds, or deleting a lone
system row costs less.) The integer holds the whole audit, so nothing is traced back.

Scale: rows are range-partitioned by conversation and place, so one conversation of
any size spreads over many tasks. A conversation that lies inside one task is
finished there. Those at the borders of tasks, at most two a task, take another way:
first occurrences by aggregation, and one 4 x 4 table of integers per run of rows (from each
state to each state), which min-plus products join in order; then one pass over the
sorted rows applies the audit and hashes, holding one row and the audit at a time.

Defined results: null role or text count as one space; a row with an empty role has
no initial and cannot be kept; turns come nulls first; rows
of one conversation and turn are ordered by role, then text, which is where a repeated row lands beside itself. A null conv_id is a
conversation of its own. Equal rows are duplicates after the first. A conversation
without rows after damage has zeros, an empty audit and the digest of the empty
string. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from . import common

# States of the pattern: nothing yet, after s, after u, after a. Each lets in one role by insertion.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENTERS = ("u", "u", "a", "u")
DONE = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
SLOT_BITS = 6
# Rows joined one by one before tables of the dynamic program are joined as products.
RUN_ROWS = 64

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
_ORDER = ["turn", "role", "text"]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows by crc32(`conv_id:turn`) % 20: 0 dropped, 1 emptied, 2 without `[.!?]`,
    3 twice, 4 given to the user."""
    own = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    shown = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = own.withColumn("kind", F.crc32(shown.cast("binary")) % 20).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def fault(text: str, seen: bool) -> int:
    """The first fault of a row."""
    last = text.rstrip(common.SPACES)[-1:]
    if not last:
        return BLANK
    if seen:
        return DUPLICATE
    return OK if last in ".!?" else TRUNCATED


# A path is (cost << SLOT_BITS * rows) | slots; a table holds one per entry and exit state, None where there is none.
Table = list[list[int | None]]


def _choices(state: int, initial: str, kind: int) -> Iterator[tuple[int, int, int]]:
    """(cost, slot, next state) of one row, with and without an insertion before it."""
    for inserted in (False, True):
        at = NEXT[state][ENTERS[state]] if inserted else state
        high = 2 * inserted

        def slot(letter: str) -> int:
            return DIGIT["I"] << 3 | DIGIT[letter] if inserted else DIGIT[letter] << 3

        yield high + 3, slot("D"), at
        if kind in (BLANK, DUPLICATE):
            continue
        high += kind == TRUNCATED
        if initial in NEXT[at]:
            yield high, slot("K"), NEXT[at][initial]
        yield high + 2, slot("R"), NEXT[at][ENTERS[at]]


_EDGES: dict[tuple[int, str, int], list[tuple[int, int, int]]] = {}


def _edges(state: int, initial: str, kind: int) -> list[tuple[int, int, int]]:
    key = (state, initial if initial in ("s", "u", "a") else "", kind)
    if key not in _EDGES:
        _EDGES[key] = list(_choices(*key))
    return _EDGES[key]


def solve(rows: list[tuple[str, int]], entries: tuple[int, ...] = (START,)) -> Table:
    """The table of a run of rows (role initial, fault), for the given entry states."""
    width = SLOT_BITS * len(rows)
    out: Table = [[None] * 4 for _ in range(4)]
    for entry in entries:
        now: list[int | None] = [None] * 4
        now[entry] = 0
        at = width
        for initial, kind in rows:
            at -= SLOT_BITS
            then: list[int | None] = [None] * 4
            for state, path in enumerate(now):
                if path is None:
                    continue
                for cost, slot, to in _edges(state, initial, kind):
                    weight = path + (cost << width) + (slot << at)
                    if then[to] is None or weight < then[to]:
                        then[to] = weight
            now = then
        out[entry] = now
    return out


def join(left: Table, left_rows: int, right: Table, right_rows: int) -> Table:
    """The table of two runs in a row: the right slots come after the left ones, costs add."""
    a, b = SLOT_BITS * left_rows, SLOT_BITS * right_rows

    def after(x: int, y: int) -> int:
        return (x << b) + (y >> b << a + b) + (y & (1 << b) - 1)

    out: Table = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            ways = [after(left[i][k], right[k][j]) for k in range(4) if left[i][k] is not None and right[k][j] is not None]
            out[i][j] = min(ways, default=None)
    return out


def solve_long(rows: list[tuple[str, int]], entries: tuple[int, ...]) -> Table:
    """`solve` for many rows: short runs joined pairwise, so that long integers are rarely added."""
    if len(rows) <= RUN_ROWS:
        return solve(rows, entries)
    tables = [(solve(rows[i : i + RUN_ROWS], (0, 1, 2, 3)), len(rows[i : i + RUN_ROWS])) for i in range(0, len(rows), RUN_ROWS)]
    return join_all(tables)[0]


def join_all(tables: list[tuple[Table, int]]) -> tuple[Table, int]:
    while len(tables) > 1:
        pairs = [(join(a, m, b, n), m + n) for (a, m), (b, n) in zip(tables[::2], tables[1::2])]
        tables = pairs + tables[len(pairs) * 2 :]
    return tables[0]


def finish(table: Table, rows: int) -> tuple[int, list[str]]:
    """Cost, and the letters of each slot, the last one after all rows."""
    ends = []
    for state, path in enumerate(table[START]):
        if path is None:
            continue
        if state in DONE:
            ends.append(path << SLOT_BITS)
        elif state == USER:  # insert the assistant
            ends.append((path << SLOT_BITS) + (2 << SLOT_BITS * (rows + 1)) + (DIGIT["I"] << 3))
        else:  # insert user and assistant
            ends.append((path << SLOT_BITS) + (4 << SLOT_BITS * (rows + 1)) + (DIGIT["I"] << 3) + DIGIT["I"])
    best = min(ends)
    octal = f"{best & (1 << SLOT_BITS * (rows + 1)) - 1:0{2 * (rows + 1)}o}"
    letters = octal.translate({48 + v: k for v, k in LETTER.items()})
    return best >> SLOT_BITS * (rows + 1), [letters[i : i + 2].rstrip("0") for i in range(0, len(letters), 2)]


class Writer:
    """Applies slots to rows in order and hashes the repaired `role:text` lines."""

    def __init__(self) -> None:
        self.state, self.sha, self.any = START, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.sha.update(b"\n" * self.any + f"{role}:{text}".encode())
        self.any = True

    def _insert(self) -> None:
        enters = ENTERS[self.state]
        self._line(ROLES[enters], "")
        self.state = NEXT[self.state][enters]

    def row(self, slot: str, role: str, text: str) -> None:
        if slot[0] == "I":
            self._insert()
        if slot[-1] == "K":
            self._line(role, text)
            self.state = NEXT[self.state][role[:1]]
        elif slot[-1] == "R":
            enters = ENTERS[self.state]
            self._line(ROLES[enters], text)
            self.state = NEXT[self.state][enters]

    def end(self, slot: str) -> str:
        for _ in slot:
            self._insert()
        return self.sha.hexdigest()


def _illegal(before: str, after: str) -> int:
    return before + after not in ("su", "ua", "au")


class Conversation:
    """One conversation that lies inside a task, row by row."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.held: list[tuple[str, str]] = []
        self.seen: set[bytes] = set()
        self.turns = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        initial = role[:1]
        self.illegal += bool(self.rows) and _illegal(self.rows[-1][0], initial)
        self.rows.append((initial, fault(text, key in self.seen)))
        self.held.append((role, text))
        self.seen.add(key)
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def result(self) -> tuple:
        cost, slots = finish(solve_long(self.rows, (START,)), len(self.rows))
        writer = Writer()
        for (role, text), slot in zip(self.held, slots):
            writer.row(slot, role, text)
        kinds = [k for _, k in self.rows]
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        counts = [kinds.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)]
        return gaps, *counts, self.illegal, cost, "".join(slots), writer.end(slots[-1])


_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", *_NAMES])


def _inner(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations between the first and the last of a task; those two by their key alone."""
    now, held, first, out = None, None, True, []
    for f in frames:
        for key, turn, role, text in zip(*(f.column(c).to_pylist() for c in ("key", *_ORDER))):
            if key != now:
                if now is not None:
                    out.append((now, *held.result()) if not first else (now, *[None] * 8))
                    first = False
                now, held = key, Conversation()
            # The first conversation goes the other way, as does the last one, whose rows end with the task.
            if not first:
                held.add(turn, role, text)
        if len(out) >= 5000:
            yield _batch(out)
            out = []
    if now is not None:
        out.append((now, *[None] * 8))
    if out:
        yield _batch(out)


def conversation_key(conv_id: Column) -> Column:
    """The id as text that sorts nulls apart from all ids."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _pack(table: Table) -> list[str | None]:
    return [None if x is None else f"{x:x}" for line in table for x in line]


def _unpack(cells) -> Table:
    flat = [None if x is None else int(x, 16) for x in cells]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and conversation, in order: the table of its rows, their number, first and last initial, illegal pairs."""
    done, now = [], None

    def close():
        table, n = join_all(tables + ([(solve(rows, (0, 1, 2, 3)), len(rows))] if rows else []))
        return now, at, n, _pack(table), ends[0], ends[1], illegal

    columns = ["key", "at", "n", "cells", "head", "tail", "illegal"]
    for f in frames:
        for key, place, initial, kind in zip(f["key"], f["place"], f["initial"], f["kind"]):
            if key != now:
                if now is not None:
                    done.append(close())
                now, at, tables, rows, ends, illegal = key, place, [], [], [initial, initial], 0
            else:
                illegal += _illegal(ends[1], initial)
                ends[1] = initial
            rows.append((initial, kind))
            if len(rows) == RUN_ROWS:
                tables.append((solve(rows, (0, 1, 2, 3)), RUN_ROWS))
                rows = []
                # Equal sizes are joined at once, so that few tables are held.
                while len(tables) > 1 and tables[-2][1] <= tables[-1][1]:
                    (a, m), (b, n) = tables[-2:]
                    tables[-2:] = [(join(a, m, b, n), m + n)]
        if done:
            yield pd.DataFrame(done, columns=columns)
            done = []
    if now is not None:
        yield pd.DataFrame([close()], columns=columns)


def _chosen(runs: pd.DataFrame) -> pd.DataFrame:
    """Join a conversation's runs, one per task that held it."""
    runs = runs.sort_values("at")
    table, n = join_all([(_unpack(c), int(m)) for c, m in zip(runs["cells"], runs["n"])])
    cost, slots = finish(table, n)
    illegal = int(runs["illegal"].sum()) + sum(map(_illegal, runs["tail"].iloc[:-1], runs["head"].iloc[1:]))
    return pd.DataFrame({"key": [runs["key"].iloc[0]], "illegal": [illegal], "cost": [cost], "slots": [",".join(slots)]})


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply each conversation's slots, which come as its first row, to its rows in order."""
    now, out = None, []
    for f in frames:
        for key, slots, role, text in zip(f["key"], f["slots"], f["role"], f["text"]):
            if key != now:
                if now is not None:
                    out.append((now, writer.end(next(left))))
                now, writer, left = key, Writer(), iter(slots.split(","))
            else:
                writer.row(next(left), role, text)
        if out:
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])
            out = []
    if now is not None:
        yield pd.DataFrame([(now, writer.end(next(left)))], columns=["key", "repaired_sha256"])


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of conversations that may span tasks, with their faults; equal rows are counted first and numbered."""
    counted = rows.groupBy("key", *_ORDER).agg(F.count("*").alias("times"))
    # Nulls sort first inside a struct, as they do among turns.
    firsts = counted.groupBy("key", F.md5(_told_apart()).alias("digest")).agg(F.min(F.struct("turn")).alias("first"))
    each = counted.withColumn("digest", F.md5(_told_apart())).join(firsts, ["key", "digest"])
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("again"))
    last = F.right(F.rtrim("text", F.lit(common.SPACES)), F.lit(1))
    later = (F.col("again") > 1) | ~F.struct("turn").eqNullSafe(F.col("first"))
    kind = F.when(last == "", BLANK).when(later, DUPLICATE).when(last.isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    return each.select("key", *_ORDER, "again", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"))


def _told_apart() -> Column:
    return F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")


def repair(damaged: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `original` (default: of `damaged`) with its faults and cheapest repair.

    `damaged` has conv_id, turn, role and text without nulls in the last two (see `damage`).
    """
    spark = damaged.sparkSession
    original = damaged if original is None else original
    rows = damaged.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), "role", "text")
    sorted_rows = rows.repartitionByRange("key", *_ORDER).sortWithinPartitions("key", *_ORDER)
    inner = stored(sorted_rows.mapInArrow(_inner, f"key string, {_FIELDS}"), "repairs")

    border = inner.where("audit IS NULL").select("key").distinct()
    wide = stored(_spread(rows.join(border, "key")), "border-rows")
    dealt = wide.repartitionByRange("key", *_ORDER, "again").sortWithinPartitions("key", *_ORDER, "again")
    placed = dealt.select("key", F.monotonically_increasing_id().alias("place"), "initial", "kind")
    runs = placed.mapInPandas(_runs, "key string, at long, n long, cells array<string>, head string, tail string, illegal long")
    chosen = stored(runs.groupBy("key").applyInPandas(_chosen, "key string, illegal long, cost long, slots string"), "chosen-edits")

    heads = chosen.select("key", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("again"), "slots")
    body = wide.select("key", F.lit(1).alias("part"), "turn", "role", "text", "again", F.lit(None).cast("string").alias("slots"))
    stream = heads.union(body).repartition("key").sortWithinPartitions("key", "part", *_ORDER, "again")
    hashed = stream.select("key", "slots", "role", "text").mapInPandas(_hashed, "key string, repaired_sha256 string")
    count = lambda k: F.count_if(F.col("kind") == k)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counted = wide.groupBy("key").agg(
        F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated")
    )
    audit = F.regexp_replace("slots", ",", "").alias("audit")
    border_results = counted.join(chosen, "key").join(hashed, "key").select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit, "repaired_sha256")

    found = inner.where("audit IS NOT NULL").union(border_results)
    every = original.select("conv_id").distinct().withColumn("key", conversation_key(F.col("conv_id")))
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    filled = [F.coalesce(F.col(n), F.lit(nothing.get(n, 0))).alias(n) for n in _NAMES]
    return every.join(found, "key", "left").select("conv_id", *filled)


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations), conversations)
