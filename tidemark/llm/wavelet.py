"""Token ids as one wavelet matrix per shard.

A shard is a run of whole documents in id order. Its matrix has one bit-plane
per bit of the ids, from the highest down; each plane stores the bits of the
tokens in the order the planes above left them (zeros before ones) and a rank
directory of ones before each block of 512 bits. From it alone come a token
(access), the count of an id before a place (rank) and the place of its k-th
occurrence (select). Shards are rows of a Parquet table, so writing is atomic
per task and any store that Spark reads will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_dir
from .common import cached_tokenizer, in_batches

SHARD_TOKENS, BLOCK = 1 << 20, 512
SCHEMA = "part int, seq int, n_docs long, n_tokens long, ids binary, no_id binary, ends binary, width int, zeros binary, planes binary, ranks binary"


def build(ids: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(width, zeros per plane, planes, rank directories) of a sequence of ids."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype("<u2" if width <= 16 else "<u4")
    planes, zeros, ranks = [], [], []
    for b in range(width - 1, -1, -1):
        bit = (cur & cur.dtype.type(1 << b)) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        per = np.add.reduceat(bit, np.arange(0, max(1, len(bit)), BLOCK), dtype="<u4") if len(bit) else np.zeros(1, "<u4")
        ranks.append((np.cumsum(per) - per).astype("<u4"))
        # By place: masks of random bits cost several times as much.
        cur = np.concatenate([cur[np.flatnonzero(~bit)], cur[np.flatnonzero(bit)]])
        zeros.append(len(bit) - int(bit.sum()))
    join = lambda xs: b"".join(x.tobytes() for x in xs)
    return width, np.array(zeros, "<i8").tobytes(), join(planes), join(ranks)


class Matrix:
    """One shard's matrix, read from its row; nothing is expanded until asked for."""

    def __init__(self, n: int, width: int, zeros: bytes, planes: bytes, ranks: bytes):
        self.n, self.width, self.zeros = n, width, np.frombuffer(zeros, "<i8")
        self.planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(width, -1)

    def _ones(self, level: int, at: int) -> int:
        """Ones before place `at` of a plane."""
        block = min(at // BLOCK, self.ranks.shape[1] - 1)
        lo = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level, lo : (at + 7) // 8], bitorder="little")[: at - 8 * lo]
        return int(self.ranks[level, block]) + int(bits.sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit, ones = self.planes[level, i >> 3] >> (i & 7) & 1, self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.width - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at places lo to hi (exclusive)."""
        if token < 0 or token >> self.width:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id, or -1."""
        if token < 0 or token >> self.width:
            return -1
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - level) & 1
            at = self._nth(level, one, at - int(self.zeros[level]) if one else at)
        return at

    def _nth(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of a kind in a plane."""
        r = self.ranks[level].astype(np.int64)
        before = r if bit else np.arange(len(r)) * BLOCK - r
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before[block]])

    def all(self) -> np.ndarray:
        """Every id, in order: undo the planes from the lowest up."""
        cur = np.zeros(self.n, "<u4" if self.width > 16 else "<u2")
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up, z = np.empty_like(cur), int(self.zeros[level])
            up[np.flatnonzero(~bit)], up[np.flatnonzero(bit)] = cur[:z], cur[z:] | cur.dtype.type(1 << (self.width - 1 - level))
            cur = up
        return cur.astype("<u4")


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, part, seq = cached_tokenizer(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids, encoded, size = [], [], 0

        def done() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(encoded), "<u4")
            ends = np.cumsum([len(e) // 4 for e in encoded], dtype="<i8")
            width, zeros, planes, ranks = build(flat)
            no_id = np.packbits([i is None for i in ids], bitorder="little").tobytes()
            key = np.array([i or 0 for i in ids], "<i8").tobytes()
            row = [part, seq, len(ids), len(flat), key, no_id, ends.tobytes(), width, zeros, planes, ranks]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in in_batches(batches):
            for i, e in zip(b.column("id").to_pylist(), tok.encode(b.column("text").to_pylist())):
                e += end
                if encoded and size + len(e) // 4 > shard_tokens:
                    yield done()
                    ids, encoded, size, seq = [], [], 0, seq + 1
                ids.append(i)
                encoded.append(e)
                size += len(e) // 4
        if encoded:
            yield done()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the documents' ids, each document followed by `end_id`, in ascending id order.

    A shard holds whole documents of up to `shard_tokens` ids, or one longer
    document. Null text counts as empty; null ids come first; rows of equal id
    are ordered by their text's hash.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("`text`").alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    dealt = d.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    dealt.mapInArrow(_shards(tokenizer_path, end_id, shard_tokens), SCHEMA).write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            flat = Matrix(r["n_tokens"], r["width"], r["zeros"], r["planes"], r["ranks"]).all()
            ends = np.frombuffer(r["ends"], "<i8")
            starts = np.r_[0, ends[:-1]]
            no_id = np.unpackbits(np.frombuffer(r["no_id"], np.uint8), count=r["n_docs"], bitorder="little").view(bool)
            n = len(ends)
            raw = flat.tobytes()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([r["part"]] * n, pa.int32()),
                "seq": pa.array([r["seq"]] * n, pa.int32()),
                "id": pa.array(np.frombuffer(r["ids"], "<i8"), pa.int64(), mask=no_id),
                "at": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)], pa.int64()),
            })


def read(df_path: str, spark, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files alone: id, start (ids of all documents before), n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(df_path)
    docs = files.mapInArrow(_documents, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    # One row per writing task.
    before = parts.selectExpr("part", "sum(t) OVER (ORDER BY part) - t AS before")
    own = sizes.selectExpr("part", "seq", "sum(n_tokens) OVER (PARTITION BY part ORDER BY seq) - n_tokens AS own")
    base = own.join(before, "part").select("part", "seq", (F.col("own") + F.col("before")).alias("base"))
    out = docs.join(base, ["part", "seq"])
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write to a fresh scratch folder and read back. An empty table gives no rows; further columns are left out."""
    path = scratch_dir(docs.sparkSession, "wavelet")
    write(docs, path, tokenizer_path)
    return read(path, docs.sparkSession)
