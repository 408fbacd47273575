"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only.

Distinct lines are cut into threshold + 1 segments. Two lines within the
threshold share a segment at nearly the same place, so a line looks up its own
substrings, at the starts that its length difference and the segment's number
allow, in an index keyed by (length, segment number, segment). Segments that
many lines share are cut finer before anything is paired: the part that holds
the edit is cut into cells, level by level, and lines meet when they agree outside one
small cell (threshold 1; larger thresholds pair all lines of a segment).
Candidate pairs are verified by a bit-parallel automaton over the band of 2 * threshold + 1
diagonals, whose states are the bits of one integer per number of errors.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import SPACES

THRESHOLD, MIN_CHARS = 1, 10
# Probes of one key that are paired at once, and how crowded keys are cut: cells per level, levels.
CROWD, CELLS, LEVELS = 8, 16, 3
# Bits of the filter of wanted lines: 16 MB.
FILTER_BITS = 1 << 27
_SHIFT = "4611686018427387904BD"


def occurrences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, tie, line_no, line, pos) of every line with a word; pos orders lines by id, row and place."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    d = d.withColumn("tie", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))
    each = d.select("id", "tie", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    each = each.where(F.translate("line", SPACES, "") != "")
    at = F.expr(f"cast(coalesce(id, -4611686018427387904) as decimal(20,0)) * {_SHIFT} + cast(tie * 2147483648 + line_no as decimal(19,0))")
    return each.withColumn("pos", at.cast("decimal(38,0)"))


def _cuts(length: Column, k: int, i: int) -> tuple[Column, Column]:
    """Start (from 1) and size of the i-th of k even segments (i from 1); later ones are longer by one."""
    size, longer = F.floor(length / k), length % k
    extra = F.greatest(F.lit(0), longer - (k - i))
    before = F.greatest(F.lit(0), longer - (k - i) - 1)
    return (size * (i - 1) + before + 1).cast("int"), (size + F.when(extra > 0, 1).otherwise(0)).cast("int")


def _key(length: Column, i: int, part: Column) -> Column:
    return F.xxhash64(length, F.lit(i), part)


def keys(line: Column, n: Column, threshold: int) -> Column:
    """(key, seg, less) under which lines of this length or `less` shorter may be found.

    A line's own segments at their own places are what it is found under; these
    keys, which it probes too, have `less` -1.
    """
    k, out = threshold + 1, []
    for less in range(threshold + 1):
        for i in range(1, k + 1):
            start, size = _cuts(n - less, k, i)
            for shift in range(-(i - 1), i):
                if abs(shift - less) <= k - i:
                    key = _key(n - less, i, F.substring(line, start + shift, size))
                    out.append(F.struct(key.alias("key"), F.lit(i).alias("seg"), F.lit(less if less or shift else -1).alias("less")))
    return F.array_distinct(F.array(*out))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings is at most `threshold`, by the banded bit-parallel automaton.

    After j characters of b, bit t of state d says that j - threshold + t
    characters of a are matched with d errors.
    """
    t, full = threshold, (1 << (2 * threshold + 1)) - 1
    start = [1 << t]
    for d in range(1, t + 1):
        start.append((start[d - 1] | start[d - 1] << 1) & full)

    def run(x: Column, y: Column) -> Column:
        def step(s: Column, c: Column, j: Column) -> Column:
            same = F.lit(0)
            for bit in range(2 * t + 1):
                same = same + F.when(F.coalesce(F.get(x, j - t + bit) == c, F.lit(False)), 1 << bit).otherwise(0)
            return F.transform(F.array(same), lambda m: _next(s, m))[0]

        def _next(s: Column, m: Column) -> Column:
            new: list[Column] = []
            for d in range(t + 1):
                r = s[d].bitwiseAND(m)
                if d:
                    r = r.bitwiseOR(s[d - 1]).bitwiseOR(F.shiftright(s[d - 1], 1)).bitwiseOR(F.shiftleft(new[d - 1], 1))
                new.append(r.bitwiseAND(F.lit(full)))
            return F.array(*new)

        numbered = F.transform(y, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        end = F.aggregate(numbered, F.array(*[F.lit(v) for v in start]), lambda s, v: step(s, v["c"], v["j"]))
        at = F.size(x) - F.size(y) + t
        return F.when(F.abs(F.size(x) - F.size(y)) > t, F.lit(False)).otherwise(F.exists(end, lambda s: F.call_function("shiftright", s, at) % 2 == 1))

    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_remove(F.split(s, ""), ""))
    return F.transform(F.array(F.struct(chars(a).alias("x"), chars(b).alias("y"))), lambda p: run(p["x"], p["y"]))[0]


def _may_be_one_edit(a: Column, b: Column) -> Column:
    """Needed for a distance of one: at any cut the parts before it or the parts after it (but one) are equal."""
    n = F.least(F.char_length(a), F.char_length(b))
    out = F.abs(F.char_length(a) - F.char_length(b)) <= 1
    for q in (1, 2, 3):
        c = F.floor(n * q / 4).cast("int")
        out = out & ((F.left(a, c) == F.left(b, c)) | (F.right(a, n - c - 1) == F.right(b, n - c - 1)))
    return out


def _cells(line: Column, less: Column, start: Column, end: Column) -> Column:
    """(key, start, end) of the cells of [start, end), a range of the shorter line, where a
    key holds all characters outside its cell. A line's own rows have `less` -1."""
    wider = F.greatest(less, F.lit(0))
    size = end - start
    many = F.least(F.lit(CELLS), size)

    def cell(i: Column) -> Column:
        a = (start + F.floor(size * i / many)).cast("int")
        b = (start + F.floor(size * (i + 1) / many)).cast("int")
        rest = F.substring(line, b + wider + 1, F.char_length(line))
        key = F.xxhash64(F.char_length(line) - wider, a, b, F.left(line, a), rest)
        return F.struct(key.alias("key"), a.alias("start"), b.alias("end"))

    return F.transform(F.sequence(F.lit(0), many - 1), cell)


def _pairs(rows: DataFrame) -> DataFrame:
    """(pos, less, key) -> pairs of a line found under a key and one that probes it; two found under it meet once."""
    index = rows.where("less < 0").select("key", "pos")
    probe = rows.select("key", F.col("pos").alias("by"), "less")
    met = index.join(probe, "key").where(F.when(F.col("less") < 0, F.col("pos") < F.col("by")).otherwise(F.col("pos") != F.col("by")))
    return met.select(F.least("pos", "by").alias("a"), F.greatest("pos", "by").alias("b"))


def _texts(lines: DataFrame, need: DataFrame) -> DataFrame:
    """(pos, line) of the wanted lines.

    A bitmap of the wanted places, never above FILTER_BITS / 8 bytes and so
    broadcast, drops most other lines before their texts are shuffled; where it
    is full, more texts move and the join decides all the same.
    """
    need = stored(need.distinct(), "need")
    bit = F.pmod(F.xxhash64("pos"), F.lit(FILTER_BITS))
    maps = need.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    at = (F.col("bit") % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    some = lines.select("pos", "line", bit.alias("bit")).withColumn("part", F.shiftright("bit", 15)).join(F.broadcast(maps), "part")
    some = some.where(F.call_function("shiftright", byte, at % 8) % 2 == 1).select("pos", "line")
    return some.join(need, "pos", "left_semi")


def _crowded_pairs(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of crowded segments (threshold 1): (pos, less, seg) rows are cut into finer
    cells, level by level, until few lines share one or the cell is one character.

    Distinct lines that agree outside one character are at most as many as there
    are characters, so the last level pairs what is left.
    """
    texts = stored(_texts(lines, rows.select("pos")), "crowded-texts")
    n = F.char_length("line") - F.greatest(F.col("less"), F.lit(0))
    half = F.floor(n / 2).cast("int")
    # The edit lies in the half that is not shared.
    cell = [F.when(F.col("seg") == 1, half).otherwise(0).alias("start"), F.when(F.col("seg") == 1, n).otherwise(half).alias("end")]
    rows, out = rows.join(texts, "pos").select("pos", "less", *cell), []
    for level in range(LEVELS):
        cut = F.inline(_cells(F.col("line"), F.col("less"), F.col("start"), F.col("end")))
        fine = stored(rows.join(texts, "pos").select("pos", "less", cut), "cells")
        met = fine.groupBy("key").agg(
            F.count(F.lit(1)).alias("probes"), F.count_if(F.col("less") < 0).alias("found"), F.max(F.col("end") - F.col("start")).alias("size")
        )
        met = stored(met.where("found > 0 and probes > 1").select("key", ((F.col("probes") > CROWD) & (F.col("size") > 1)).alias("more")), "met")
        last = level == LEVELS - 1
        out.append(_pairs(fine.join(met if last else met.where("not more"), "key", "left_semi")))
        rows = fine.join(met.where("more"), "key", "left_semi").select("pos", "less", "start", "end")
    return functools.reduce(DataFrame.union, out)


def links(lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """(pos, line) of distinct lines -> pairs (a, b) with a < b whose edit distance is at most `threshold`.

    Lines of fewer than `min_chars` characters have no near lines.
    """
    n = F.char_length("line")
    fit = lines.where(n >= max(min_chars, threshold + 1))
    probe = fit.select("pos", F.inline(keys(F.col("line"), n, threshold)))
    # A key of one row, or one under which no line is found, joins nothing.
    shared = probe.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("less").alias("least")).where("n > 1 and least < 0")
    rows = stored(probe.join(stored(shared.select("key", "n"), "shared"), "key").select("pos", "less", "seg", "key", "n"), "keys")
    if threshold == 1:
        met = _pairs(rows.where(F.col("n") <= CROWD)).union(_crowded_pairs(fit, rows.where(F.col("n") > CROWD)))
    else:
        met = _pairs(rows)
    pairs = stored(met.distinct(), "pairs")
    texts = stored(_texts(fit, pairs.select(F.col("a").alias("pos")).union(pairs.select("b"))), "texts")
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    if threshold == 1:
        both = both.where(_may_be_one_edit(F.col("x"), F.col("y")))
    return both.where(within(F.col("x"), F.col("y"), threshold)).select("a", "b")


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id") -> DataFrame:
    """One row per (id, text): id, n_lines, n_removed, n_near, removed (line numbers, ascending).

    A line (one with a word) goes if an equal line, or one within `threshold`
    edits, stands earlier: in a smaller id, or before it in the same text.
    n_near counts the near lines of the document's distinct lines. Null ids come
    first; rows that repeat an id are ordered by a hash of their text, and a row
    repeated with its text is one document. Documents without lines have zeros
    and an empty list. An empty table gives no rows; further columns are left out.
    """
    occ = occurrences(docs, id_col)
    lines = stored(occ.groupBy("line").agg(F.min("pos").alias("pos")), "lines")
    near = stored(links(lines, threshold, min_chars), "near")
    ends = near.select(F.col("b").alias("pos"), F.lit(1).alias("late")).union(near.select("a", F.lit(0)))
    per = ends.groupBy("pos").agg(F.count(F.lit(1)).alias("near"), F.max("late").alias("late"))
    digest = [F.xxhash64("line").alias("k"), F.md5("line").alias("m")]
    # Digests first: the join then moves no texts.
    first = lines.select(*digest, "pos").join(per, "pos", "left").select("k", "m", F.col("pos").alias("first"), F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("late", F.lit(0)).alias("late"))
    rows = occ.select("id", "tie", "line_no", "pos", *digest).distinct()
    gone = (F.col("pos") != F.col("first")) | (F.col("late") == 1)
    found = rows.join(first, ["k", "m"]).groupBy("id", "tie").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(gone.cast("long")).alias("n_removed"),
        F.sum("near").alias("n_near"),
        F.sort_array(F.collect_list(F.when(gone, F.col("line_no")))).alias("removed"),
    )
    text = F.coalesce(F.col("`text`"), F.lit(""))
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).alias("_tie")).distinct()
    out = every.join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tie") == F.col("tie")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("_id").alias(id_col), zero("n_lines"), zero("n_removed"), zero("n_near"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
