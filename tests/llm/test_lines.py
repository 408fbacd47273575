"""The line join against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs, threshold, min_chars):
    """docs: (id, text) in id order, ids distinct."""
    occ = [(d, k, s) for d, t in docs for k, s in enumerate((t or "").split("\n")) if s.strip(" \t\n\x0b\x0c\r")]
    first = {}
    for at, (_, _, s) in enumerate(occ):
        first.setdefault(s, at)
    near = {s: [u for u in first if u != s and min(len(u), len(s)) >= min_chars and abs(len(u) - len(s)) <= threshold and edits(u, s) <= threshold] for s in first}
    out = {d: [0, 0, 0, []] for d, _ in docs}
    for at, (d, k, s) in enumerate(occ):
        gone = first[s] != at or any(first[u] < first[s] for u in near[s])
        r = out[d]
        r[0], r[1], r[2] = r[0] + 1, r[1] + gone, r[2] + len(near[s])
        if gone:
            r[3].append(k)
    return {d: tuple(r) for d, r in out.items()}


@pytest.mark.parametrize("threshold", [1, 2])
def test_dense_lines(spark, threshold):
    rng = random.Random(threshold)
    seeds = ["".join(rng.choice("abcé \U0001f600") for _ in range(rng.randint(8, 16))) for _ in range(6)]

    def edit(s):
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(s))
            s = rng.choice([s[:i] + rng.choice("abé") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("ab") + s[i + 1 :]])
        return s

    docs = [(i, "\n".join(edit(rng.choice(seeds)) for _ in range(rng.randint(0, 5)))) for i in range(40)] + [(40, None), (41, " \n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pos", F.lit(1)).withColumn("line", F.lit("x"))
    got = {r.doc_id: tuple(r)[1:] for r in lines.dedup(df, threshold).collect()}
    assert got == brute(docs, threshold, lines.MIN_CHARS)


def test_tables(spark, odd, corpus):
    for df in (odd, corpus.where("length(text) < 900")):
        docs = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        assert {r.doc_id: tuple(r)[1:] for r in lines.dedup(df).collect()} == brute(docs, 1, lines.MIN_CHARS)
    assert lines.dedup(odd.where("doc_id < 0")).count() == 0


def test_within(spark):
    rng = random.Random(7)
    pairs = [("", ""), ("a", ""), ("abc", "abc"), ("abcd", "acbd")]
    pairs += [tuple("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        for r in df.select("a", "b", lines.within(F.col("a"), F.col("b"), t).alias("w")).collect():
            assert r.w == (edits(r.a, r.b) <= t), r


def test_crowded_segments(spark):
    """Many variants of one line: numbered templates, one-word changes, insertions at the cell ends."""
    rng = random.Random(3)
    base = "the quick brown fox jumps over the lazy dog and runs away from the river bank"
    words = base.split(" ")
    docs = [(i, f"order no {i % 60:04d} was shipped to the customer") for i in range(70)]
    for i in range(70, 150):
        k = rng.randrange(len(words))
        docs.append((i, " ".join([*words[:k], rng.choice(["aa", "ab", "abc", "b" + words[k], words[k][1:], "é"]), *words[k + 1 :]])))
    docs += [(150 + i, base[:i] + "x" + base[i:]) for i in range(len(base) + 1)]
    docs += [(300 + i, base[:i] + base[i + 1 :]) for i in range(len(base))]
    docs.append((400, base))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in lines.dedup(df).collect()}
    assert got == brute(docs, 1, lines.MIN_CHARS)
