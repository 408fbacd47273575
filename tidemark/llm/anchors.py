"""Repeated windows through content-defined anchors: the common part of the
substring and phrase operators.

A window of L units is anchored at the least-hashed gram of k units that lies
in it (the leftmost of equal ones), so equal windows have equal anchors at equal
places. All windows with one anchor make a segment; no two of them are equal.
Segments whose anchor gram occurs once in the corpus cannot repeat and are left
out. The others travel as 128-bit digests: equal segments are aggregated to
their first occurrence, the rest of them repeat as a whole. Only where segments
of one anchor differ are their first occurrences cut from the texts and handed,
in bounded batches of whole anchors, to the operator's own method, which finds
equal windows exactly. Anchors never depend on how the table is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import buffered_groups, in_batches

# Bits of the filter of recurring anchors (16 MB), and of those of rows (8 MB each).
FILTER_BITS, ROW_BITS = 1 << 27, 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Units:
    """What the units are: `parse` gives the units of a text, `grams` one hash per
    k-gram start beside them; `content` gives the bytes of units [a, b)."""

    window: int
    gram: int
    parse: Callable[[bytes], object]
    grams: Callable[[bytes], tuple[np.ndarray, object]]
    content: Callable[[object, int, int], bytes]

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each full run of w values, the place of its least value, the leftmost of equal ones."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    val, at, size = h, np.arange(len(h)), 1
    while 2 * size <= w:
        left = val[:-size] <= val[size:]
        val, at = np.where(left, val[:-size], val[size:]), np.where(left, at[:-size], at[size:])
        size *= 2
    if size < w:
        d = w - size
        at = np.where(val[:-d] <= val[d:], at[:-d], at[d:])
    return at


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def segments(units: Units, text: bytes) -> tuple[np.ndarray, ...] | None:
    """(hash, anchor, first start, last start, parsed) of a text's segments; None without a full window."""
    h, parsed = units.grams(text)
    at = sliding_argmin(h, units.span)
    if not len(at):
        return None
    lo = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
    hi = np.r_[lo[1:], len(at)] - 1
    return h[at[lo]], at[lo], lo, hi, parsed


def _count(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches):
            got = [s[0] for s in (segments(units, t) for t in raw_texts(b)) if s]
            h, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def position(ids: np.ndarray, tie: np.ndarray, at: np.ndarray) -> pa.Array:
    """id, tie (31 bits) and place (31 bits) as one exact number that sorts in this order."""
    low = (ids.astype(np.int64) << 62).view(np.uint64) | (tie.astype(np.uint64) << np.uint64(31)) | at.astype(np.uint64)
    both = np.empty((len(ids), 2), np.uint64)
    both[:, 0], both[:, 1] = low, (ids.astype(np.int64) >> 2).view(np.uint64)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(ids), [None, pa.py_buffer(both.tobytes())])


OCC = "h long, d binary, starts int, id long, tie int, at int, pos decimal(38,0)"


def _occurrences(units: Units, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = np.frombuffer(held.value, np.uint8)
        for b in in_batches(batches):
            cols: list[list] = [[] for _ in range(6)]
            for i, tie, t in zip(b.column("id").to_pylist(), b.column("tie").to_pylist(), raw_texts(b)):
                s = segments(units, t)
                if not s:
                    continue
                h, at, lo, hi, parsed = s
                slot = (h % np.uint64(len(bits) * 8)).astype(np.int64)
                some = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                if not len(some):
                    continue
                lo, hi = lo[some], hi[some]
                n, lead = len(some), (at[some] - lo).tolist()
                # The place of the anchor belongs to a segment; its length follows from the content.
                cols[1] += [
                    xxhash.xxh3_128_digest(units.content(parsed, x, y + units.window), seed=k)
                    for x, y, k in zip(lo.tolist(), hi.tolist(), lead)
                ]
                for c, v in zip([cols[0], *cols[2:]], (h[some].view(np.int64), hi - lo + 1, np.full(n, i), np.full(n, tie), lo)):
                    c.append(v)
            if not cols[0]:
                continue
            flat = [c if k == 1 else np.concatenate(c) for k, c in enumerate(cols)]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            arrays = [pa.array(v, k) for v, k in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, position(*flat[3:])], names=[c.split()[0] for c in OCC.split(", ")])

    return run


def placed(pos: Column) -> dict[str, Column]:
    """The id, tie and place that `position` holds."""
    rest = F.pmod(pos, F.lit(2**62).cast("decimal(19,0)"))
    low = rest.cast("long")
    # Without the rest the division has no fraction to round.
    whole = (pos - rest) / F.lit(2**62).cast("decimal(19,0)")
    return {"id": F.floor(whole).cast("long"), "tie": F.shiftright(low, 31).cast("int"), "at": low.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")}


def raw_texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts as UTF-8, null as empty, one at a time."""
    return (t.as_py() or b"" for t in batch.column("text").cast(pa.binary()))


def row_filter(rows: DataFrame, bits: int = ROW_BITS):
    """A broadcast bitmap of (id, tie): a row whose bit is not set is not among `rows`.

    Its size is fixed; where it is full, more rows pass, and a join decides all the same.
    """
    bit = rows.select(F.pmod(F.xxhash64("id", "tie"), F.lit(bits)).alias("s"))
    return rows.sparkSession.sparkContext.broadcast(_bitmap(bit, bits))


def _bitmap(places: DataFrame, bits: int) -> bytes:
    """The bits `s` that are set, gathered piece by piece."""
    maps = places.groupBy(F.shiftright("s", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    packed = bytearray(bits // 8)
    for r in maps.toLocalIterator():
        packed[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = r["bits"]
    return bytes(packed)


def _passes(batch: pa.RecordBatch, held, negate: bool = False) -> pa.RecordBatch:
    """Rows whose bit (column s) is set in the bitmap, or is not."""
    s = batch.column("s").to_numpy()
    on = (np.frombuffer(held.value, np.uint8)[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
    return batch.filter(pa.array(~on if negate else on)).drop_columns(["s"])


def compressed(docs: DataFrame, held, bits: int = ROW_BITS) -> DataFrame:
    """The rows that pass the filter, with `text` as `z`, packed better than the shuffle does."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in in_batches(batches):
            b = _passes(b, held)
            z = pa.array([pack(t) for t in raw_texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], z], names=[*others, "z"])

    rows = docs.withColumn("s", F.pmod(F.xxhash64("id", "tie"), F.lit(bits)))
    return rows.mapInArrow(run, docs.drop("text").schema.add("z", "binary"))


def restored(column: pa.Array) -> Iterator[bytes]:
    """The texts, one at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(z.as_py()) for z in column)


CUT = "h long, content binary, starts int, id long, tie int, at int"


def _cut(units: Units):
    """Texts and the places wanted of them -> the content of these segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches, 1 << 18, "z"):
            cols: list[list] = [[] for _ in range(6)]
            ids, ties, places_of = (b.column(c).to_pylist() for c in ("id", "tie", "places"))
            for i, tie, t, places in zip(ids, ties, restored(b.column("z")), places_of):
                parsed = units.parse(t)
                for p in places:
                    content = units.content(parsed, p["at"], p["at"] + p["starts"] - 1 + units.window)
                    for c, v in zip(cols, (p["h"], content, p["starts"], i, tie, p["at"])):
                        c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=[c.split()[0] for c in CUT.split(", ")])

    return run


def _resolve(method: Callable[[pd.DataFrame], np.ndarray], window: int, size: int):
    """Batches of whole anchors -> covered ranges of first occurrences."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ranges(f: pd.DataFrame) -> pd.DataFrame:
            f = f.reset_index(drop=True)
            starts = f["starts"].to_numpy()
            row = np.repeat(np.arange(len(f)), starts)
            s = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            hit = method(f, row, s)
            row, s = row[hit], s[hit]
            new = np.r_[True, (np.diff(row) != 0) | (np.diff(s) != 1)] if len(row) else np.zeros(0, bool)
            last = np.r_[new[1:], True] if len(row) else new
            at = f["at"].to_numpy()[row] + s
            pick = lambda c: f[c].to_numpy()[row[new]]
            return pd.DataFrame({"id": pick("id"), "tie": pick("tie"), "start": at[new], "end": at[last] + window})

        for whole in buffered_groups(frames, "h"):
            n = whole.groupby("h")["starts"].transform("size").to_numpy()
            f = whole[n > 1]
            if f.empty:
                continue
            # About `size` bytes at a time, whole anchors.
            group = np.cumsum(np.r_[0, np.diff(f["h"].to_numpy()) != 0])
            total = np.cumsum(f["content"].str.len().to_numpy())
            first_of = total[np.searchsorted(group, group)] // size
            for _, part in f.groupby(first_of, sort=False):
                yield ranges(part)

    return run


def covered(docs: DataFrame, units: Units, method: Callable, filter_bits: int = FILTER_BITS, batch: int = 1 << 20) -> DataFrame:
    """(id, tie, text) -> (id, tie, ranges): the unit ranges of windows that also start earlier.

    Earlier is a smaller (id, tie), or the same with a smaller place. The filter
    of recurring anchors has a fixed size; where it is full, more segments are
    compared, with the same result.
    """
    spark = docs.sparkSession
    seen = docs.select("text").mapInArrow(_count(units), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    # filter_bits is a power of two, so signed and unsigned remainders agree.
    bit = seen.select(F.pmod(F.col("h"), F.lit(filter_bits)).alias("s"))
    held = spark.sparkContext.broadcast(_bitmap(bit, filter_bits))
    occ = docs.select("id", "tie", "text").mapInArrow(_occurrences(units, held), OCC)
    occ = stored(occ, "segments")
    first = stored(occ.groupBy("h", "d", "starts").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")), "first")
    differ = first.groupBy("h").count().where("count > 1").select("h")
    place = placed(F.col("pos"))
    need = first.join(differ, "h", "left_semi").select("h", "starts", *[v.alias(k) for k, v in place.items()])
    need = stored(need.groupBy("id", "tie").agg(F.collect_list(F.struct("h", "at", "starts")).alias("places")), "places")
    cut = compressed(docs.select("id", "tie", "text"), row_filter(need)).join(need, ["id", "tie"]).mapInArrow(_cut(units), CUT)
    dealt = cut.repartition("h").sortWithinPartitions("h")
    fresh = dealt.mapInPandas(_resolve(method, units.window, batch), "id long, tie int, start int, end int")
    lead = first.where("n > 1").select("d", *[v.alias(f"_{k}") for k, v in place.items()])
    again = occ.select("d", "id", "tie", "at", "starts").join(lead, "d").where("id != _id or tie != _tie or at != _at")
    again = again.select("id", "tie", F.col("at").alias("start"), (F.col("at") + F.col("starts") - 1 + units.window).alias("end"))
    # Rows that repeat an id and a text share their ranges, so equal ones are one.
    return fresh.union(again).groupBy("id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def rows_of(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, tie, text): null text is empty; rows that repeat an id are told apart by their text."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id0"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    tie = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return d.select("id0", F.coalesce("id0", F.lit(-(2**62))).alias("id"), tie.alias("tie"), "text")


def finish(rows: DataFrame, marks: DataFrame, work: Callable, schema: str, id_col: str) -> DataFrame:
    """Bring each row its ranges and let `work` make the result columns from (text, ranges)."""
    marks = stored(marks, "ranges")
    held = row_filter(marks)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]

    def result(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id0", *names])

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in in_batches(batches):
            b = _passes(b, held, negate=True)
            yield result(b.column("id0"), [work(t, none, none) for t in raw_texts(b)])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches, 1 << 20, "z"):
            col = b.column("ranges")
            at, flat = col.offsets.to_numpy(), col.flatten()
            base = at[0] if len(at) else 0
            starts, ends = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            yield result(b.column("id0"), [work(t, starts[x - base : y - base], ends[x - base : y - base]) for t, x, y in zip(restored(b.column("z")), at, at[1:])])

    # Texts without a range are finished where they are read; only the others meet their ranges in a shuffle.
    bit = F.pmod(F.xxhash64("id", "tie"), F.lit(ROW_BITS)).alias("s")
    here = rows.select("id0", "text", bit).mapInArrow(unmarked, "id0 long, " + schema)
    joined = compressed(rows, held).join(marks, ["id", "tie"], "left").select("id0", "z", "ranges")
    return here.union(joined.mapInArrow(marked, "id0 long, " + schema)).withColumnRenamed("id0", id_col)


def mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in a range."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def not_first(cls: np.ndarray, ids: np.ndarray, tie: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows are not the earliest of their class."""
    order = np.lexsort((at, tie, ids, cls))
    first = np.r_[True, np.diff(cls[order]) != 0] if len(order) else np.zeros(0, bool)
    lead = order[first][np.cumsum(first) - 1]
    same = (ids[order] == ids[lead]) & (tie[order] == tie[lead]) & (at[order] == at[lead])
    out = np.zeros(len(cls), bool)
    out[order] = ~same
    return out
