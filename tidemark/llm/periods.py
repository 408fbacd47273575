"""Periodic run detection in word sequences: a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q and at least max(`shortest`, 2 q)
words that cannot be extended. Words are appended one by one to a suffix automaton.
Every state keeps the end of its last occurrence as the colour of a preferred path
of a link-cut tree over the suffix links, so that all states of a path share one
colour. Appending word i accesses the path of the new prefix; each coloured segment
it crosses holds the suffixes last seen ending at some j < i, the longest of them
with L words. If i - j <= L, the last 2 (i - j) words are a square, and the most
recent earlier end makes its root primitive: i - j is the smallest period. A square
whose run is not yet known is extended to both sides.

A run's words all lie in 6-word windows that occur twice in the text (its last
length - q >= 6 words repeat its words q before). So only maximal stretches covered
by such windows pass the automaton; windows are compared by a 64-bit value, and a
chance agreement merely lengthens a stretch.

Scale: each document is a row of its own task; no shuffle. A document's automaton
holds at most two states per word of its longest repetitive stretch.

Defined results: a null or empty text has no words and no run; repeated doc_ids are
separate rows; a null doc_id counts as an empty decimal in the damage rule (crc32 0,
so it is damaged by a = 0). Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SHORTEST = 12
# Words of a window that must occur twice: least length - period over runs of at least SHORTEST words.
WINDOW = 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Squares:
    """A suffix automaton over integers whose last occurrences sit in a link-cut tree.

    Node 0 is no node, node 1 the empty word. Each splay tree is one preferred path,
    ordered by length; the colour of a path is kept at the root of its splay tree.
    """

    def __init__(self) -> None:
        self.length, self.link, self.go = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def _node(self, length: int, link: int, go: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        self.left.append(0)
        self.right.append(0)
        self.up.append(0)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if left[g] == p or right[g] == p:
                self._rotate(p if (left[p] == x) == (left[g] == p) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def _insert_above(self, q: int, clone: int) -> None:
        """The clone takes the place right above q on q's path, and so its colour."""
        left, up = self.left, self.up
        self._splay(q)
        b = left[clone] = left[q]
        if b:
            up[b] = clone
        left[q] = clone
        up[clone] = q

    def append(self, word: int) -> list[int]:
        """Append a word; the smallest periods of the squares that end with it."""
        length, link, go = self.length, self.link, self.go
        i, self.size = self.size, self.size + 1
        cur = self._node(i + 1, 1, {})
        p = self.last
        while p and word not in go[p]:
            go[p][word] = cur
            p = link[p]
        if p:
            q = go[p][word]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = self._node(length[p] + 1, link[q], dict(go[q]))
                self._insert_above(q, clone)
                while p and go[p].get(word) == q:
                    go[p][word] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur
        self.up[cur] = link[cur]
        return self._access(cur, i)

    def _access(self, x: int, i: int) -> list[int]:
        """Give the path from the root to x the colour i; where a segment's old end lies within
        the segment's length, the distance is a period."""
        right, up, colour = self.right, self.up, self.colour
        found, below, start = [], 0, x
        while x:
            self._splay(x)
            if x != start and 0 < i - colour[x] <= self.length[x]:
                found.append(i - colour[x])
            if right[x]:
                colour[right[x]] = colour[x]
            right[x] = below
            below = x
            x = up[x]
        colour[below] = i
        return found


def stretches(words: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return []
    value = np.zeros(n, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * _ODD
    for k in range(window):
        value = value * np.uint64(0xC2B2AE3D27D4EB4F) + mixed[k : k + n]
        value ^= value >> np.uint64(31)
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + window).tolist()))


def _agree(words: np.ndarray, a: int, b: int) -> int:
    """For how many words the sequence goes on alike from `a` and from `b` < a."""
    count, size = 0, 64
    while a + count < len(words):
        here = words[a + count : a + count + size]
        differ = np.flatnonzero(here != words[b + count : b + count + len(here)])
        if len(differ):
            return count + int(differ[0])
        count, size = count + len(here), size * 2
    return count


def runs(words: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an integer sequence, ascending."""
    out = []
    # A run of `shortest` words or more repeats shortest - period >= shortest / 2 of them.
    for lo, hi in stretches(words, (shortest + 1) // 2):
        part, squares, ends = words[lo:hi], Squares(), {}
        back = part[::-1]
        for i, word in enumerate(part.tolist()):
            for q in squares.append(word):
                if ends.get(q, -1) >= i:
                    continue
                end = i + 1 + _agree(part, i + 1, i + 1 - q)
                start = i - 2 * q + 1
                start -= _agree(back, len(part) - start, len(part) - start - q)
                ends[q] = end - 1
                if end - start >= max(shortest, 2 * q):
                    out.append((lo + start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, n: int) -> np.ndarray | None:
    """The damage rule: which original word stands at each place, or None for an unchanged text."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


_SCHEMA = [("doc_id", pa.int64()), ("n_runs", pa.int64())] + [(c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")]
_SCHEMA = pa.schema(_SCHEMA + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def measure(text: bytes | None, doc_id=None, damaged: bool = False) -> tuple:
    """One document's row without its id."""
    words = (text or b"").split()
    if damaged and (at := planted(doc_id, len(words))) is not None:
        words = [words[k] for k in at]
    found = []
    if len(words) >= SHORTEST:
        number: dict[bytes, int] = {}
        found = runs(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    if found:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, n, q in found:
            edge[s + q] += 1
            edge[s + n] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    shas = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    return len(found), s, n, q, None if q is None else 1000 * n // q, *shas


def detect(documents: DataFrame, damaged: bool = False) -> DataFrame:
    """One row per document with its runs; `damaged` first plants periods by the rule of `planted`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.in_batches(frames):
            ids = b.column("doc_id")
            texts = b.column("text").cast(pa.binary())
            rows = [measure(t.as_py(), d, damaged) for t, d in zip(texts, ids.to_pylist())]
            columns = [ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_SCHEMA)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, names=_SCHEMA.names)

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in list(_SCHEMA)[1:])
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, {fields}")
