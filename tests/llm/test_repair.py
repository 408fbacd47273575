"""Conversation repair against a search of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = r"[\x20\x09-\x0D]"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = re.sub(f"{SPACE}+\\Z", "", text)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif body[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def search(rows):
    """(cost, audit, repaired lines): every edit of every row, and up to two insertions at every place."""
    kinds = faults(rows)
    options = []
    for (role, text), kind in zip(rows, kinds):
        plus = kind == "truncated"
        way = [(3, "D", None)]
        if kind not in ("blank", "duplicate"):
            if role:  # an empty role has no initial to keep
                way.append((plus, "K", (role[:1], f"{role}:{text}")))
            way += [(2 + plus, "R", (r[0], f"{r}:{text}")) for r in ("user", "assistant")]
        options.append(way)
    inserts = [()] + [((r[0], f"{r}:"),) for r in ("user", "assistant")]
    inserts += [(a[0], b[0]) for a, b in itertools.product(inserts[1:], repeat=2)]
    # Prefixes that cannot begin the pattern are left out, all others are kept.
    ways = {("", ""): [(0, ())]}
    live = [(0, "", "", ())]
    for k in range(len(rows) + 1):
        nxt = []
        for cost, audit, shape, lines in live:
            for ins in inserts:
                a = (cost + 2 * len(ins), audit + "I" * len(ins), shape + "".join(x[0] for x in ins), lines + tuple(x[1] for x in ins))
                for c, letter, row in options[k] if k < len(rows) else [(0, "", None)]:
                    b = (a[0] + c, a[1] + letter, a[2] + (row[0] if row else ""), a[3] + ((row[1],) if row else ()))
                    if re.fullmatch(r"(s?(ua)*u?)?", b[2]):
                        nxt.append(b)
        best = {}
        for b in nxt:  # of equal role shapes only the best goes on
            if b[2] not in best or b[:2] < best[b[2]][:2]:
                best[b[2]] = b
        live = list(best.values())
    cost, audit, shape, lines = min(b for b in live if PATTERN.fullmatch(b[2]))
    return cost, audit, lines


def expected(conversation):
    """conversation: rows (conv_id, turn, role, text) of one conversation, before damage."""
    rows = []
    for c, turn, role, text in conversation:
        c, t = (" " if x is None else str(x) for x in (c, turn))
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = {r[0] for r in rows} - {None}
    pairs = [(r, t) for _, r, t in rows]
    kinds = faults(pairs)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, lines = search(pairs)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", "User", "", None, "user", "assistant"]
    texts = ["Yes.", "no", "What?", " \t\n", "", None, "é!", "end. ", "Yes."]
    turns = [None, *range(n)] if rng.random() < 0.5 else range(3 * n)
    return [(conv, rng.choice(list(turns)), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def compare(spark, rows, partitions):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("key", repair.F.lit("x")).withColumn("cost", repair.F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = repair.damage_and_repair(table).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    want = {c: expected([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_search(spark, partitions):
    rng = random.Random(partitions)
    rows = [r for c in [*range(150), None] for r in made(rng, c, rng.randrange(1, 9))]
    rng.shuffle(rows)
    compare(spark, rows, partitions)


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds nearly all rows, with repeated rows, beside small ones."""
    rng = random.Random(11)
    rows = made(rng, 5, 160) + [r for c in (1, 9) for r in made(rng, c, 4)]
    compare(spark, rows + rows[:40], 13)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()
    compare(spark, [tuple(r) for r in table], 8)


def test_empty(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_joined_tables_equal_one_pass():
    rng = random.Random(2)
    for _ in range(50):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(1, 300))]
        assert repair.finish(repair.solve_long(rows, (0,)), len(rows)) == repair.finish(repair.solve(rows), len(rows))
