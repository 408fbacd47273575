"""Substring dedup: backward extension of intervals from the anchors, bounded by the minimum length.

Segments that may share a passage meet by anchor (anchors.py). The rows of a
batch are the suffixes that begin at the anchors, sorted, with the common
prefixes of neighbours. All intervals are then extended backwards together,
breadth-first, one character at a time: a row moves behind all rows with a
smaller character before it and behind those above it with the same one, as in
a search over a Burrows-Wheeler transform. Rows whose characters differ are
parted, so are neighbours whose common prefix is too short for what the window
still needs to the right of the anchor. The search stops at the minimum length;
rows that no other shares its characters with are left out on the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import anchors

MIN_BYTES, GRAM = 100, 32
_BASE = 0x2545F4914F6CDD1D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _grams(k: int):
    def run(raw: bytes) -> tuple[np.ndarray, bytes]:
        global _UP, _DOWN
        b = np.frombuffer(raw, np.uint8)
        if len(b) < k:
            return np.zeros(0, np.uint64), raw
        if len(b) > len(_UP):
            _UP, _DOWN = _powers(_BASE, 2 * len(b)), _powers(_INVERSE, 2 * len(b))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], out=sums[1:])
            h = (sums[k:] - sums[:-k]) * _DOWN[: len(b) - k + 1]
        return anchors.mixed(h), raw

    return run


def units(window: int = MIN_BYTES, gram: int = GRAM) -> anchors.Units:
    return anchors.Units(window, gram, bytes, _grams(gram), lambda raw, a, b: raw[a:b])


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by doubling; symbols are 0 to 256."""
    n, step = len(s), 7
    padded = np.concatenate([s.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(step):
        key = key << 9 | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = np.cumsum(np.r_[1, np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = ranked
        if step >= depth or ranked[-1] == n:
            return order
        key = rank << 32 | np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        step *= 2


def classes(s: np.ndarray, least: int) -> np.ndarray:
    """For each place of a text without anchors, a number shared exactly by the places whose next `least` symbols are equal."""
    n = len(s)
    order = suffix_order(s, least)
    row = np.empty(n + 1, np.int64)
    row[order] = np.arange(n)
    row[n] = -1
    first, after = s[order], row[order + 1]
    # Depth 1: intervals of one first character. `open_` holds the rows not yet parted from the one before.
    cut = np.r_[True, first[1:] != first[:-1]]
    open_ = np.flatnonzero(~cut)
    for _ in range(2, least + 1):
        if not len(open_):
            break
        interval = np.r_[np.cumsum(cut), 0]
        parted = interval[after[open_]] != interval[after[open_ - 1]]
        cut[open_[parted]] = True
        open_ = open_[~parted]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(cut)
    return out


def anchor_places(content: list[bytes], starts: np.ndarray, h: np.ndarray, least: int, gram: int, size: int = 1 << 20) -> np.ndarray:
    """Where the anchor lies in each segment: the leftmost gram of hash `h` that all windows hold; -1 if there is none."""
    sizes, out = np.array([len(c) for c in content]), np.full(len(content), -1)
    whole, hashes = sizes == starts + least - 1, _grams(gram)
    run = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(content)]
    for a, b in zip(cuts, cuts[1:]):
        g = hashes(b"".join(content[a:b]))[0]
        row = np.repeat(np.arange(a, b), sizes[a:b])[: len(g)]
        at = np.flatnonzero(g == h[row])
        row = row[at]
        at -= (np.cumsum(sizes[a:b]) - sizes[a:b])[row - a]
        held = whole[row] & (at >= starts[row] - 1) & (at <= least - gram)
        rows, first = np.unique(row[held], return_index=True)
        out[rows] = at[held][first]
    return out


def intervals(content: list[bytes], lead: np.ndarray, starts: np.ndarray, h: np.ndarray, least: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, segments, begins) by distance from the anchor back: the segments with a window that
    begins there, those of equal windows side by side, and whether a segment is the first of its interval."""
    reach, width = least - gram, -(-least // 8) * 8
    sizes = np.array([len(c) for c in content])
    text = np.frombuffer(b"".join([bytes(reach), *content, bytes(width)]), np.uint8)
    some = np.flatnonzero(lead >= 0)
    at = (np.cumsum(sizes) - sizes + lead)[some]
    # The characters from the anchor on; a row has no window whose end lies behind its own.
    right = np.lib.stride_tricks.sliding_window_view(text, width)[at + reach]
    some_h = h[some]
    order = np.lexsort((*right.view(">u8").astype(np.uint64).T[::-1], some_h))
    right, at, some, some_h = right[order, :least], at[order], some[order], some_h[order]
    left = np.lib.stride_tricks.sliding_window_view(text, reach + 1)[at]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), least)
    other = np.diff(some_h) != 0
    common[other] = 0
    back_to, first = lead[some], lead[some] - starts[some] + 1
    # `live`: rows in the order of the strings reached; `same`: numbers of the intervals of one string before the anchor.
    live, same = np.arange(len(some)), np.r_[0, np.cumsum(other)][: len(some)]
    for back in range(reach + 1):
        if back:
            on = back_to[live] >= back
            live, same = live[on], same[on]
            char = left[live, reach - back]
            # Rows of smaller characters, then those above with the same one: the step of a backward search.
            step = np.argsort(char, kind="stable")
            live, same, char = live[step], same[step], char[step]
            new = np.r_[True, (np.diff(same) != 0) | (char[1:] != char[:-1])][: len(live)]
            shared = ~(new & np.r_[new[1:], True][: len(live)])
            live, same = live[shared], np.cumsum(new)[shared]
        if not len(live):
            return
        rows = first[live] <= back
        row = live[rows]
        deep = np.r_[0, np.cumsum(common < least - back)]
        yield back, some[row], np.r_[True, (np.diff(same[rows]) != 0) | (np.diff(deep[row]) != 0)][: len(row)]


def _method(least: int, gram: int):
    def run(f: pd.DataFrame, row: np.ndarray, s: np.ndarray) -> np.ndarray:
        content, starts, h = f["content"].tolist(), f["starts"].to_numpy(), f["h"].to_numpy().view(np.uint64)
        lead = anchor_places(content, starts, h, least, gram)
        # Windows at one distance from their anchors come in the order of the anchors.
        keys = [f["id"].to_numpy(), f["tie"].to_numpy(), f["at"].to_numpy() + lead]
        order = np.lexsort(keys[::-1])
        age = np.empty(len(f), np.int64)
        age[order] = np.cumsum(np.r_[False, np.any([np.diff(k[order]) != 0 for k in keys], axis=0)])
        hit, base = np.zeros(len(row), bool), np.cumsum(starts) - starts
        for back, rows, begins in intervals(content, lead, starts, h, least, gram):
            if not len(rows):
                continue
            earliest = np.minimum.reduceat(age[rows], np.flatnonzero(begins))
            later = rows[age[rows] > earliest[np.cumsum(begins) - 1]]
            hit[base[later] + lead[later] - back] = True
        return hit

    return run


def _work(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    if not len(starts):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
    hit = anchors.mask(len(raw), starts, ends)
    spans = int(hit[0]) + int(np.count_nonzero(hit[1:] & ~hit[:-1]))
    return len(raw), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~hit].tobytes()).hexdigest()


def repeated(docs: DataFrame, window: int = MIN_BYTES, gram: int = GRAM, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, tie, ranges) of the bytes covered by a string of `window` bytes that also starts earlier."""
    return anchors.covered(anchors.rows_of(docs, id_col), units(window, gram), _method(window, gram), **options)


def dedup(docs: DataFrame, window: int = MIN_BYTES, gram: int = GRAM, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty. Null ids come first. Rows that repeat an id are ordered
    by a hash of their text; if the text is the same too, they are one document
    and get the same result. An empty table gives no rows; further columns are
    left out.
    """
    rows = anchors.rows_of(docs, id_col)
    marks = repeated(docs, window, gram, id_col, **options)
    return anchors.finish(rows, marks, _work, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col)
