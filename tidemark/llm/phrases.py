"""Repeated-phrase dedup with Aho-Corasick automata.

Word sequences that may share a passage meet by anchor (anchors.py), which also
shards the work. In a batch of whole anchors the windows that recur are
confirmed by counting, compiled into one automaton, and every segment of the
batch streams through it; each occurrence found takes its place in the order,
and all but the first are removed.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import anchors

WINDOW, GRAM = 20, 8
# Word hashes that a worker keeps; the table is emptied when it is full.
_LIMIT = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def split(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: bytes.split parts at exactly these characters."""
    return text.split()


def _grams(k: int):
    def run(text: bytes) -> tuple[np.ndarray, list[bytes]]:
        words = split(text)
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), words
        h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * np.uint64(0x2545F4914F6CDD1D) + h[j : j + n]
        return anchors.mixed(out), words

    return run


def units(window: int = WINDOW, gram: int = GRAM) -> anchors.Units:
    return anchors.Units(window, gram, split, _grams(gram), lambda words, a, b: b" ".join(words[a:b]))


def automaton(phrases: list[str]):
    """Aho-Corasick automaton of phrases with a space on either side; a match gives the phrase's number."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        a.add_word(f" {p} ", (i, len(p) + 2))
    a.make_automaton()
    return a


def _method(window: int, per_automaton: int = 20_000):
    def run(f: pd.DataFrame, row: np.ndarray, s: np.ndarray) -> np.ndarray:
        texts = [" " + c.decode() + " " for c in f["content"]]
        starts = f["starts"].to_numpy()
        base = np.cumsum(starts) - starts
        cls = np.arange(len(row)) + len(row)
        passages: Counter = Counter()
        for t, n in zip(texts, starts.tolist()):
            w = t[1:-1].split(" ")
            passages.update(" ".join(w[i : i + window]) for i in range(n))
        again = [p for p, n in passages.items() if n > 1]
        for at in range(0, len(again), per_automaton):
            machine = automaton(again[at : at + per_automaton])
            for k, t in enumerate(texts):
                done, seen = 0, 0
                for end, (i, size) in machine.iter(t):
                    begin = end - size + 1
                    # Words before the match: one space each.
                    done += t.count(" ", seen, begin)
                    seen = begin
                    cls[base[k] + done] = at + i
        pick = lambda c: f[c].to_numpy()[row]
        return anchors.not_first(cls, pick("id"), pick("tie"), pick("at") + s)

    return run


def _work(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
    words = split(text)
    if not len(starts):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    hit = anchors.mask(len(words), starts, ends).tolist()
    kept = [w for w, x in zip(words, hit) if not x]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, tie, ranges) of the words covered by a window of words that also starts earlier."""
    return anchors.covered(anchors.rows_of(docs, id_col), units(window, gram), _method(window), **options)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Null text has no words. Null ids come first. Rows that repeat an id are
    ordered by a hash of their text; if the text is the same too, they are one
    document and get the same result. An empty table gives no rows; further
    columns are left out.
    """
    rows = anchors.rows_of(docs, id_col)
    marks = repeated(docs, window, gram, id_col, **options)
    return anchors.finish(rows, marks, _work, "n_words long, n_removed long, kept_sha256 string", id_col)
