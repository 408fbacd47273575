"""SimHash near-dedup by anchor points of a covering code.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of their upper or lower half. The anchors of a half are the words of a
Hamming code on 31 bits times both values of the last bit: every half lies
within one bit of exactly one anchor, its home. A fingerprint is copied to all
anchors within covering radius plus threshold (two bits) of each half, so a
fingerprint one bit away is always met at the other's home; full distances are
compared per anchor. Anchors hold distinct fingerprints only and give each
member a link to one representative, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .common import buffered_groups, let, matching_rows, one_of_each, text_digest, words

SHINGLE, THRESHOLD = 3, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = 1024


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each word shingle; of all words where these are fewer; none for no words."""

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, each).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.translate(text, UPPER, LOWER)), hashes)


def majority(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of 64-bit values, the bits set in over half of them, as signed 64-bit integers."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    at = 0
    while at < len(full):
        # About half a million values at a time, whole runs.
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 19), side="left")))
        lo, hi = int(starts[at]), int(starts[to]) if to < len(full) else len(values)
        bits = np.unpackbits(values[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[at:to] - lo, axis=0, dtype=np.int32)
        won = 2 * ones > sizes[full[at:to], None]
        out[full[at:to]] = np.packbits(won, axis=1, bitorder="little").view("<u8")[:, 0]
        at = to
    return out.view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column("h")
        values = np.ascontiguousarray(h.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
        fp = majority(values, np.diff(h.offsets.to_numpy()))
        keep = [n for n in b.schema.names if n != "h"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], pa.array(fp)], names=[*keep, "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", with_key: bool = False) -> DataFrame:
    """(id, fp) of each document, or (id, key, fp) with the text's digest; a text without words, or null, has fingerprint zero."""
    key = [text_digest(F.col("`text`")).alias("key")] if with_key else []
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), *key, shingle_hashes(F.col("`text`")).alias("h"))
    return d.mapInArrow(_fingerprints, "id long, key binary, fp long" if with_key else "id long, fp long")


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 32-bit half, its anchors within two bits (unused places are -1) and which column is home.

    Column 0 is the home. Bits 0-30 belong to the Hamming code with parity
    checks 1..31, bit 31 is free.
    """
    body, free = half & np.int64(0x7FFFFFFF), half & np.int64(0x80000000)
    syndrome = np.zeros(len(half), np.int64)
    for i in range(31):
        syndrome ^= ((body >> i) & 1) * (i + 1)
    flip = lambda s: np.where(s > 0, np.int64(1) << np.maximum(s - 1, 0), 0)
    home = body ^ flip(syndrome)
    cols = [home | free, home | (free ^ np.int64(0x80000000))]
    for i in range(1, 32):
        j = syndrome ^ i
        cols.append(np.where((syndrome > 0) & (i < j), (body ^ (np.int64(1) << (i - 1)) ^ flip(j)) | free, -1))
    return np.stack(cols, axis=1)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = b.column("fp").to_numpy()
        for at in range(0, len(whole), 50_000):
            fp = whole[at : at + 50_000]
            for block, half in enumerate((fp & np.int64(0xFFFFFFFF), (fp >> 32) & np.int64(0xFFFFFFFF))):
                a = anchors(half)
                row, col = np.nonzero(a >= 0)
                key = a[row, col] | (np.int64(block) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(col == 0)], names=["anchor", "fp", "home"])


def _labels(fp: np.ndarray, home: np.ndarray, threshold: int) -> np.ndarray:
    """Smallest position linked to each member of one anchor, through any chain of links."""
    label = np.arange(len(fp))
    rows = np.flatnonzero(home)
    changed = True
    while changed:
        changed = False
        for at in range(0, len(rows), _BLOCK):
            mine = rows[at : at + _BLOCK]
            near = np.bitwise_count(fp[mine, None] ^ fp[None, :]) <= threshold
            low = np.where(near, label[None, :], len(fp)).min(axis=1)
            low = np.minimum(low, label[mine])
            after = np.where(near, low[:, None], len(fp)).min(axis=0)
            after = np.minimum(label, after)
            after[mine] = np.minimum(after[mine], low)
            changed |= bool((after != label).any())
            label = after
    return label


def _compare(threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in buffered_groups(frames, "anchor"):
            key, fp, home = f["anchor"].to_numpy(), f["fp"].to_numpy().view(np.uint64), f["home"].to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            lo, hi = np.r_[0, cuts], np.r_[cuts, len(key)]
            a, b = [], []
            # Groups of two, the most usual, at once.
            two = lo[hi - lo == 2]
            ok = two[(home[two] | home[two + 1]) & (np.bitwise_count(fp[two] ^ fp[two + 1]) <= threshold)]
            a.append(fp[ok + 1]), b.append(fp[ok])
            for s, e in zip(lo[hi - lo > 2], hi[hi - lo > 2]):
                label = _labels(fp[s:e], home[s:e], threshold)
                moved = np.flatnonzero(label != np.arange(e - s))
                a.append(fp[s:e][moved]), b.append(fp[s:e][label[moved]])
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) whose chains connect exactly the fingerprints within `threshold` bits (at most three)."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves prove distances up to three")
    copies = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    dealt = copies.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInPandas(_compare(threshold), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of (a, b) links; root is the least node reachable.

    Minimum labels spread along links and then jump to their label's label; each
    round is a written table.
    """
    both = stored(edges.union(edges.select("b", "a")).distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "label")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = stored(step, "label")
        of = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        label_new = stored(step.join(of, "root").select("node", F.least("root", "further").alias("root"), "old"), "label")
        moved = label_new.where(F.col("root") != F.col("old")).limit(1).count()
        label = label_new.select("node", "root")
        if not moved:
            return label


def _in_components(fps: DataFrame, threshold: int) -> DataFrame:
    """Fingerprints with their component_id and root, the least fingerprint of the component."""
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = components(stored(links(distinct, threshold), "links"))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (least id reachable).

    Null and wordless texts share fingerprint zero and are linked like others.
    Repeated rows share a component; null ids never name one unless all are
    null. An empty table gives no rows; further columns are left out.
    """
    found = _in_components(stored(fingerprints(docs, id_col), "fingerprints"), threshold)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns of any names: the least id, of its texts the least digest.

    Rows are told apart by id and text, so a row of one component takes no row
    of the same (or a null) id in another with it. Of rows equal in id and text
    one stays, whichever; a null id loses to others. An empty table stays empty.
    """
    found = _in_components(stored(fingerprints(docs, with_key=True), "fingerprints"), THRESHOLD)
    found = stored(found.select("id", "key", "root"), "members")
    # A null id comes after all others.
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("c"), F.count("*").alias("n"))
    keys = [F.col("doc_id").cast("long"), text_digest(F.col("`text`"))]
    groups = stored(chosen.where("n > 1").select("root", "c.id", "c.key"), "chosen")
    of = found.join(groups.toDF("root", "_id", "_key"), "root")
    best = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    left = matching_rows(docs, keys, of.where(~best).select("id", "key").distinct(), "left_anti")
    repeated = of.where(best).groupBy("id", "key").count().where("count > 1").drop("count")
    return one_of_each(left, keys, stored(repeated, "repeated"))
