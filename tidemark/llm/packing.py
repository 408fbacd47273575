"""Best-fit packing with a bounded number of open sequences.

Documents are cut only where they exceed a sequence. Pieces are dealt to
packers by a hash and come in hash order, so that long and short ones mix and a
lost task packs the same way again. The packers' unfilled sequences are packed
again by fewer packers, down to one. A packer keeps at most `open_bins` open
sequences, keyed by free space in one bitset; a piece goes to the fullest that
it fits, and when too many are open the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .common import cached_tokenizer, in_batches

CAPACITY, OPEN_BINS = 4096, 1024
# Tokens of a packer, how many packers' leavings one packer takes, and the free part (1 in SLACK) that counts as full.
PACKER_TOKENS, FAN, SLACK = 1 << 24, 16, 64
PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = cached_tokenizer(path), np.array([end_id], "<u4").tobytes()
        for b in in_batches(batches):
            out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            for i, ids in zip(b.column("id").to_pylist(), tok.encode(b.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for name, v in zip(out, (i, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        out[name].append(v)
            if not with_ids:
                del out["ids"]
            kinds = {"piece": pa.int32(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, packed 32-bit) of each document's pieces."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("`text`").alias("text"))
    return d.mapInArrow(_cut(path, end_id, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


class Packer:
    """Open sequences by free space: bit f of `mask` is set while one with f free exists."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.mask, self.open, self.count, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and offset of a piece of `length` tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.open[left].append(bin_)
            self.mask |= 1 << left
            self.count += 1
            if self.count > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        got = self.open[free].pop()
        if not self.open[free]:
            self.mask &= ~(1 << free)
        self.count -= 1
        return got


def _pack(capacity: int, open_bins: int, numbered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(capacity, open_bins), TaskContext.get().partitionId()
        for b in batches:
            placed = np.array([packer.place(n) for n in b.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array((np.int64(numbered) << 56) + (np.int64(task) << 32) + placed[:, 0]), pa.array(placed[:, 1])],
                names=[*b.schema.names, "sequence_id", "offset"],
            )

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces of at most `capacity` tokens.

    The number of packers follows from the total of tokens, `packer_tokens` for
    each, and not from any setting of the session. A packer leaves at most
    `open_bins` sequences open, and some that had to close early; the pieces of
    all that are not full to 1 in SLACK are packed again by a FAN-th as many packers,
    round by round, until one packer is left. So only the last round leaves open
    sequences. Sequence ids name the round and the packer in their upper bits.
    """
    parts = stored(parts, "pieces")
    rows = parts.withColumn("_h", F.xxhash64("id", "piece", "start", "ids_crc32"))
    kinds = rows.schema.simpleString()[7:-1].replace(":", " ") + ", sequence_id long, offset long"
    tokens = parts.agg(F.sum("length")).first()[0] or 0
    packers, done, numbered = max(1, -(-tokens // packer_tokens)), None, 0
    while True:
        # One partition per packer, which a run-time change of the plan would not keep for a hashed column.
        dealt = rows.repartitionById(packers, F.pmod("_h", F.lit(packers)).cast("int")).sortWithinPartitions("_h", "id", "piece")
        packed = dealt.mapInArrow(_pack(capacity, open_bins, numbered), kinds)
        if packers == 1:
            out = packed if done is None else done.unionByName(packed)
            return out.drop("_h")
        packed = stored(packed, "packed")
        fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("_fill"))
        loose = fill.where(F.col("_fill") < capacity - capacity // SLACK).select("sequence_id")
        full = packed.join(loose, "sequence_id", "left_anti").select(*rows.columns, "sequence_id", "offset")
        done = full if done is None else done.unionByName(full)
        rows = packed.join(loose, "sequence_id", "left_semi").select(*rows.columns)
        packers, numbered = -(-packers // FAN), numbered + 1


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the packed ids of each sequence, from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    bound = F.sum("length").alias("n_tokens")
    return packed.groupBy("sequence_id").agg(bound, parts.alias("parts")).select(
        "sequence_id", "n_tokens", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is one piece, its end id. Repeated and null ids are
    packed row by row; an empty table gives no rows; further columns are left out.
    """
    return pack(pieces(docs, path)).withColumnRenamed("id", "doc_id")
