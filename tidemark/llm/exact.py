"""Exact dedup through a sharded minimal perfect hash over distinct digests.

A history is a table of distinct digests with the document that won each. Its
shards (cut by digest, about `per_shard` each) hold a minimal perfect hash:
levels of bit arrays in which each digest owns one bit, whose rank is its slot.
A slot holds the whole digest, the winner's id and the number of copies, so a
lookup compares all digest bytes and non-members are recognised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import SPACE_RUN, matching_rows, one_of_each

PER_SHARD = 1 << 17
SLOT = np.dtype([("digest", "S32"), ("winner", "<i8"), ("has_winner", "?"), ("copies", "<i8")])
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    """The bit of each key (rows of two 64-bit words) in a level of m bits."""
    with np.errstate(over="ignore"):
        h = (keys[:, 0] + np.uint64(level) * _C1) ^ (keys[:, 1] * _C2)
        h = (h ^ (h >> np.uint64(31))) * _C2
        return ((h ^ (h >> np.uint64(29))) % np.uint64(m)).astype(np.int64)


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.frombuffer(digests.tobytes(), "<u8").reshape(-1, 4)[:, :2]


def build_table(slots: np.ndarray) -> bytes:
    """The minimal perfect hash of one shard's slots, whose digests are distinct."""
    keys, rest, sizes, bits, order = _keys(slots["digest"].astype("S32")), np.arange(len(slots)), [], [], []
    while len(rest):
        m = max(64, 2 * len(rest))
        at = _place(keys[rest], len(sizes), m)
        alone = np.bincount(at, minlength=m) == 1
        own = alone[at]
        order.append(rest[own][np.argsort(at[own])])
        bits.append(np.packbits(alone, bitorder="little"))
        sizes.append(m)
        rest = rest[~own]
    head = np.array([len(slots), len(sizes), *sizes], "<i8").tobytes()
    ordered = slots[np.concatenate(order)] if order else slots
    return head + b"".join(b.tobytes() for b in bits) + ordered.tobytes()


class Table:
    """A shard's hash, loaded for lookups."""

    def __init__(self, blob: bytes):
        n, levels = np.frombuffer(blob, "<i8", 2)
        self.sizes = np.frombuffer(blob, "<i8", levels, 16)
        at, self.bits, self.ranks, before = 16 + 8 * int(levels), [], [], 0
        for m in self.sizes:
            take = (int(m) + 7) // 8
            b = np.unpackbits(np.frombuffer(blob, np.uint8, take, at), count=int(m), bitorder="little")
            r = np.cumsum(b, dtype=np.int64) - b + before
            before, at = before + int(b.sum()), at + take
            self.bits.append(b.view(bool))
            self.ranks.append(r)
        self.slots = np.frombuffer(blob, SLOT, int(n), at)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, or -1 where the slot's bytes are not the digest."""
        keys, slot, rest = _keys(digests), np.full(len(digests), -1), np.arange(len(digests))
        for level, m in enumerate(self.sizes):
            at = _place(keys[rest], level, int(m))
            hit = self.bits[level][at]
            slot[rest[hit]] = self.ranks[level][at[hit]]
            rest = rest[~hit]
        found = np.flatnonzero(slot >= 0)
        wrong = found[self.slots["digest"][slot[found]] != digests[found]]
        slot[wrong] = -1
        return slot


def _digests(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "S32")


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    yield from zip(cuts, cuts[1:])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, digest, winner, copies) sorted by shard -> one blob per shard."""
    held: list[np.ndarray] = []
    now, total = None, 0

    def done() -> pa.RecordBatch:
        blob = build_table(np.concatenate(held))
        return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "blob": pa.array([blob], pa.binary()), "rows": pa.array([total], pa.int64())})

    for b in batches:
        shard = b.column("shard").to_numpy()
        for lo, hi in _runs(shard) if b.num_rows else ():
            if held and now != shard[lo]:
                yield done()
                held, total = [], 0
            now, part = shard[lo], b.slice(lo, hi - lo)
            s = np.zeros(hi - lo, SLOT)
            s["digest"] = _digests(part.column("digest"))
            s["has_winner"] = part.column("winner").is_valid().to_numpy(zero_copy_only=False)
            s["winner"] = part.column("winner").fill_null(0).to_numpy()
            s["copies"] = part.column("copies").to_numpy()
            held.append(s)
            total += int(s["copies"].sum())
    if held:
        yield done()


def build_index(distinct: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """(digest, winner, copies) with distinct digests -> (shard, blob, rows, shards)."""
    shards = -(-distinct.count() // per_shard) or 1
    d = distinct.withColumn("shard", _shard(F.col("digest"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    index = d.select("shard", "digest", "winner", "copies").mapInArrow(_build, "shard long, blob binary, rows long")
    return index.withColumn("shards", F.lit(shards))


def _shard(digest: Column, shards: Column) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 17, 7)), 16, 10).cast("long"), shards.cast("long"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard with its blob first -> id, digest, winner, copies, member."""
    table, now = None, None
    for b in batches:
        if not b.num_rows:
            continue
        shard, blobs = b.column("shard").to_numpy(), b.column("blob")
        is_blob = blobs.is_valid().to_numpy(zero_copy_only=False)
        for lo, hi in _runs(shard):
            if now != shard[lo]:
                table, now = None, shard[lo]
            for i in lo + np.flatnonzero(is_blob[lo:hi]):
                table = Table(blobs[int(i)].as_py())
            rows = b.take(pa.array(lo + np.flatnonzero(~is_blob[lo:hi])))
            if not rows.num_rows:
                continue
            d = _digests(rows.column("digest"))
            slot = table.find(d) if table else np.full(len(d), -1)
            ok = slot >= 0
            got = table.slots[np.where(ok, slot, 0)] if table and len(table.slots) else np.zeros(len(d), SLOT)
            yield pa.RecordBatch.from_pydict({
                "id": rows.column("id"),
                "digest": rows.column("digest"),
                "winner": pa.array(got["winner"], pa.int64(), mask=~(ok & got["has_winner"])),
                "copies": pa.array(got["copies"], pa.int64(), mask=~ok),
                "member": pa.array(ok),
            })


def lookup(rows: DataFrame, index: DataFrame, per_task: int = 4 * PER_SHARD) -> DataFrame:
    """Find (id, digest) rows in an index: id, digest, winner, copies, member.

    Rows meet their shard's blob in a stream: the blob comes first, then the
    rows, so a task holds one shard. A shard that much is looked up in (by its
    number of copies) is dealt over several tasks, each with the blob.
    """
    index = index.withColumn("salts", F.ceil(F.col("rows") / per_task))
    shards = index.agg(F.coalesce(F.max("shards"), F.lit(1)).alias("n"))
    rows = rows.select(F.col("id").cast("long").alias("id"), "digest")
    rows = rows.withColumn("shard", _shard(F.col("digest"), shards.select("n").scalar()))
    rows = rows.join(index.select("shard", "salts"), "shard", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))))
    blobs = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    both = blobs.select("shard", "salt", "blob", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("digest")).union(
        rows.select("shard", "salt", F.lit(None).cast("binary"), "id", "digest")
    )
    both = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())
    # The salt must part runs as well: two salts of a shard may share a task, each with its blob.
    return both.select("shard", "blob", "id", "digest").mapInArrow(_probe, "id long, digest binary, winner long, copies long, member boolean")


def dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of spaces is one space; null
    counts as empty. `history` has (digest, winner, copies); by default it is
    made from the documents themselves: the smallest id of each text wins.
    Documents that the history does not know form groups of their own. Rows
    that repeat the winner's id with the same text are all marked kept; a null
    id never wins over another. An empty table gives no rows; further columns
    are left out.
    """
    digest = F.unhex(F.sha2(normalised(F.col("`text`")), 256))
    rows = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), digest.alias("digest")), "digests")
    if history is None:
        history = stored(_groups(rows), "history")
    index = stored(build_index(history), "index")
    found = stored(lookup(rows, index), "found")
    new = found.where(~F.col("member")).select("id", "digest")
    groups = _groups(new)
    strangers = new.join(groups, "digest").select("id", "digest", "winner", "copies")
    out = found.where("member").select("id", "digest", "winner", "copies").union(strangers)
    return out.select(
        F.col("id").alias(id_col),
        F.col("winner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows that dedup() marks kept, with all their columns of any names, one for each text.

    Rows are told apart by id and text: a dropped copy takes no other text of
    its id (or of a null id) with it. Of rows equal in id and text (up to spaces)
    one stays, whichever; null text counts as empty, a null id loses to others.
    An empty table stays empty.
    """
    found = stored(dedup(docs).select("doc_id", F.unhex("text_sha256").alias("digest"), "kept"), "verdicts")
    keys = [F.col("doc_id"), F.unhex(F.sha2(normalised(F.col("`text`")), 256))]
    left = matching_rows(docs, keys, found.where("not kept").drop("kept").distinct(), "left_anti")
    repeated = stored(found.where("kept").groupBy("doc_id", "digest").count().where("count > 1").drop("count"), "repeated")
    return one_of_each(left, keys, repeated)
