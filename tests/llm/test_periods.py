"""Runs of words against a check of every period, and the damage rule."""

import random
import zlib

import numpy as np
import pytest
import reference_rules as R

from tidemark.llm import periods


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def all_runs(w, shortest=12):
    number = {}
    x = np.array([number.setdefault(v, len(number)) for v in w])
    out = []
    for q in range(1, len(w) // 2 + 1):
        edges = np.diff(np.r_[0, (x[q:] == x[:-q]).astype(np.int8), 0])
        for j, k in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            start, length = j, k - j + q
            if length >= max(shortest, 2 * q) and smallest_period(w[start : start + length]) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, damaged=True):
    w = R.WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if damaged and h % 10 == 0 and n:
        g = h // 10
        a, old = g % n, list(w)
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            w[i] = old[a + (i - a) % p]
    found = all_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    milli = None if q is None else 1000 * m // q
    return (len(found), s, m, q, milli, R.sha(listed), R.sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def words_of(kind, rng):
    if kind == "few letters":
        return [rng.randrange(2) for _ in range(rng.randrange(0, 90))]
    if kind == "three letters":
        return [rng.randrange(3) for _ in range(rng.randrange(0, 120))]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < 200:
            a, b = b, b + a
        return b
    out = []
    while len(out) < 150:
        unit = [rng.randrange(40) for _ in range(rng.randrange(1, 14))]
        out += unit * rng.randrange(1, 5) + unit[: rng.randrange(len(unit))]
    return out


@pytest.mark.parametrize("kind", ["few letters", "three letters", "fibonacci", "repeats"])
@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_are_all_runs(kind, shortest):
    rng = random.Random(f"{kind}{shortest}")
    for _ in range(60):
        w = words_of(kind, rng)
        assert periods.runs(np.array(w, np.int64), shortest) == all_runs(w, shortest), w


def test_long_repetition():
    unit = list(range(997))
    assert periods.runs(np.array(unit * 30 + [5000] + [1] * 3000, np.int64)) == [(0, 997 * 30, 997), (997 * 30 + 1, 3000, 1)]


def test_every_square_end_is_found():
    """The automaton itself, without stretches: a period for each primitively rooted square."""
    rng = random.Random(4)
    for _ in range(80):
        w = [rng.randrange(2) for _ in range(60)]
        sq = periods.Squares()
        for i, x in enumerate(w):
            want = {q for q in range(1, (i + 1) // 2 + 1) if w[i - 2 * q + 1 : i - q + 1] == w[i - q + 1 : i + 1] and smallest_period(w[i - 2 * q + 1 : i + 1]) == q}
            assert set(sq.append(x)) == want


@pytest.mark.parametrize("source", ["odd", "corpus", "empty", "planted"])
def test_detect(source, spark, request):
    if source == "planted":
        rng = random.Random(9)
        texts = [(i, " ".join(str(rng.randrange(9)) for _ in range(rng.randrange(300)))) for i in range(300)]
        table = spark.createDataFrame([*texts, (None, "a b c d e f g"), (7, "x " * 50), (7, "x " * 50)], "doc_id long, text string")
    else:
        table = request.getfixturevalue("odd").where("doc_id < 0") if source == "empty" else request.getfixturevalue(source)
    have = [tuple(r) for r in table.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, *tuple(r)[1:]) for r in periods.detect(table, damaged=True).collect()), key=str)
    assert got == sorted(((d, *expected(d, t)) for d, t in have), key=str)
    plain = {r.doc_id: tuple(r)[1:] for r in periods.detect(table).collect()}
    if source == "planted":
        assert plain[7] == expected(7, "x " * 50, damaged=False)
