"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text is the bag of its words `[^\\x20\\x09-\\x0D]+`, its pairs of neighbouring words,
and the same over word shapes (runs of letters as A, T or a for upper, title and
other case, digits as 0, further characters as they are; a word equal to the one
before it has a shape of its own), all hashed into 2**BITS places. A place weighs 1 + log(times), and the vector is scaled to length
1, so that long and short texts are scored alike. Whole texts are read.

Training: at most `max_rows` labelled documents (those of least hash of their id),
dealt to SHARDS tasks by hash. In every round each task runs one pass of
FTRL-proximal updates over its rows, starting from the common state; the states
are averaged in Spark, place by place. The state has 2**BITS places, whatever the
input, which bounds what is collected and broadcast (4 MB).

Defined results: a null or empty text has no features and scores the intercept
alone; a null doc_id counts as held out and meets no label; labels other than 0 and
1 (null too) are ignored; several labels of one doc_id all count, as does the least
text of repeated doc_ids; without any usable label every score is 0.5. One row per
input row, further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from . import common

BITS = 18
MAX_ROWS = 20_000
SHARDS = 8
ROUNDS = 4
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.002, 0.02
CUT = 0.3
# Words kept by a worker with their two hashes; the table is emptied when it is full.
WORD_CACHE = 500_000

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FEATURES = pa.schema([("label", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])


def shape(word: str) -> str:
    """Letters by their case, digits as 0, further characters as they are."""

    def case(m: re.Match) -> str:
        s = m.group()
        return "A" if s.isupper() and len(s) > 1 else "T" if s[0].isupper() else "a"

    return _DIGITS.sub("0", _LETTERS.sub(case, word))


class _Hashes(dict):
    """Word bytes to (hash of the word, hash of its shape), filled as words are met."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        seen = shape(word.decode("utf-8", "replace")).encode()
        self[word] = out = (xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(seen, 2))
        return out


@functools.lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _places(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M1
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def vector(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one text, places ascending."""
    words = (text or b"").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    h = np.array(list(map(_hashes().__getitem__, words)), np.uint64)
    parts = [h[:, 0], h[:, 1]]
    if len(words) > 1:
        h[1:, 1][h[1:, 0] == h[:-1, 0]] = _M2
        parts += [h[:-1, k] * _M2 + (h[1:, k] ^ _M1) for k in (0, 1)]
    at, times = np.unique(_places(np.concatenate(parts)), return_counts=True)
    value = 1 + np.log(times)
    return at, (value / np.sqrt(value @ value)).astype(np.float32)


def _text_bytes(col: pa.Array) -> Iterator[bytes | None]:
    for v in col.cast(pa.binary()):
        yield v.as_py()


def _featurise(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        for part in common.in_batches(iter([b])):
            at, value = zip(*map(vector, _text_bytes(part.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], schema=_FEATURES
            )


class Leader:
    """The state of follow-the-regularised-leader: z and n per place, the intercept last."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    @classmethod
    def fresh(cls) -> Leader:
        return cls(np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        value = np.append(value.astype(np.float64), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def label_sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """At most `max_rows` training labels: ids outside the held-out fold, least hash first."""
    one = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    usable = one.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    return usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Leader:
    """Train on a bounded sample of labelled documents; see the module's docstring."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").alias("id"), F.col("text"))
    # The sample has at most max_rows rows of two numbers.
    chosen = rows.join(F.broadcast(label_sample(labels, max_rows)), "id")
    chosen = chosen.groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text", F.xxhash64("id", F.lit(7)).alias("turn"))
    dealt = chosen.repartition(SHARDS, F.pmod("turn", F.lit(SHARDS))).sortWithinPartitions("turn", "label")
    table = stored(
        dealt.mapInArrow(_featurise, "label int, at array<int>, value array<float>").select("*", F.monotonically_increasing_id().alias("turn")),
        "hashed-grams",
    )
    state = Leader.fresh()
    for _ in range(ROUNDS):
        common_state = spark.sparkContext.broadcast((state.z, state.n))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z, n = common_state.value
            mine, touched, seen = Leader(z.copy(), n.copy()), np.zeros(len(z), bool), 0
            for f in frames:
                for at, value, label in zip(f["at"], f["value"], f["label"]):
                    mine.update(at, value, label)
                    touched[at] = touched[-1] = True
                    seen += 1
            if seen:
                at = np.flatnonzero(touched)
                yield pd.DataFrame({"place": at.astype(np.int32), "z": mine.z[at] - z[at], "n": mine.n[at] - n[at]})

        shards = table.repartition(SHARDS, F.pmod(F.shiftright("turn", 33), F.lit(SHARDS))).sortWithinPartitions("turn")
        moved = shards.mapInPandas(run, "place int, z double, n double").groupBy("place").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("k"))
        got = moved.toPandas()  # at most 2**BITS + 1 rows
        at = got["place"].to_numpy()
        # A place moves by the mean over the tasks that met it.
        state.z[at] += got["z"].to_numpy() / got["k"].to_numpy()
        state.n[at] += got["n"].to_numpy() / got["k"].to_numpy()
        common_state.unpersist()
    return state


def score(documents: DataFrame, state: Leader) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 is likelier) and predicted."""
    weights = documents.sparkSession.sparkContext.broadcast(state.weights().astype(np.float32))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in common.in_batches(frames):
            dots = np.array([float(w[at] @ value) if len(at) else 0.0 for at, value in map(vector, _text_bytes(b.column("text")))])
            p = 1 / (1 + np.exp(-np.clip(dots + float(w[-1]), -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on the labelled rows outside the held-out fold, score every row of `documents`."""
    return score(documents, fit(documents, labels, max_rows))
