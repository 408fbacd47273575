"""One-pass writers, footer counts, mergeable sets, block digests, contours, and folded batches."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.aggregates import distinct_bitmaps, distinct_in, distinct_in_spans
from tidemark.plans import models as md
from tidemark.session import scratch_dir
from tidemark.sources import sinks, tables
from tidemark.streaming import weekly


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df) -> list:
    return sorted(map(tuple, df.collect()), key=str)


# --- sections ----------------------------------------------------------------
VALUES = [("a", 2, 1.5, 7), ("a", 1, None, 8), ("a", 1, None, 8), (None, 1, 2.5, None), ("b", None, 3.5, 9)]


def test_tagged_lines_hold_every_row_once(spark, tmp_path):
    spark.createDataFrame(VALUES, "k string, o int, x double, y int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    heads = [("# rows", F.count(F.lit(1))), ("# least", F.min("o").cast("string"))]
    out = sinks.tagged_lines(df, ["k"], "o", [("# x", "x"), ("# y", "y")], heads)
    assert plan_of(out).count("FileScan") == 1
    want = []
    for k in ("a", None, "b"):
        mine = [v for v in VALUES if v[0] == k]
        orders = [o for _, o, _, _ in mine if o is not None]
        texts = ["# rows", str(len(mine)), "# least", str(min(orders)) if orders else None, "# x", None, "# y"]
        want += [(k, i, 0.0, t) for i, t in enumerate(texts) if i != 5]
        for _, o, x, y in mine:
            place = None if o is None else float(o)
            want += [(k, 5, place, None if x is None else str(x)), (k, 7, place, None if y is None else str(y))]
    assert rows_of(out) == sorted(want, key=str)


def test_tagged_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, o int, x double")
    assert sinks.tagged_lines(df, ["k"], "o", [("# x", "x")], [("# n", F.count(F.lit(1)))]).count() == 0


def test_vector_lines_wrap_and_open_once(spark):
    rows = [("a", 2000 + i, float(i)) for i in range(5)] + [(None, 1990, 9.0), ("c", None, 4.0)]
    df = spark.createDataFrame(rows, "k string, o int, x double")
    got = rows_of(sinks.vector_lines(df, ["k"], "o", [("YEAR", "years", "o"), ("X", "values", "x")], chunk=2))
    want = []
    for k, vectors in {
        "a": [["2000 2001", "2002 2003", "2004"], ["0.0 1.0", "2.0 3.0", "4.0"]],
        None: [["1990"], ["9.0"]],
    }.items():
        for i, head in enumerate(("#YEAR - years", "#X - values")):
            want.append((k, 2 * i, 0, head))
            want += [(k, 2 * i + 1, n, v) for n, v in enumerate(vectors[i])]
    want += [("c", 0, 0, "#YEAR - years"), ("c", 1, None, ""), ("c", 2, 0, "#X - values"), ("c", 3, None, "4.0")]
    assert got == sorted(want, key=str)


# --- catalog ---------------------------------------------------------------
def test_footer_search_reads_no_column(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1]), (None, "y", None), (3, None, [2])], "a_key long, `b.key` string, c_key array<int>")
    df.repartition(2).write.parquet(f"{tmp_path}/t")
    found = tables.footer_search(spark, {"t": f"{tmp_path}/t"}, "key$")
    want = [("t", "a_key", "bigint", 2, 1), ("t", "b.key", "string", 2, 1), ("t", "c_key", "array<int>", 2, 1)]
    assert rows_of(found) == want
    flat = plan_of(tables.footer_search(spark, {"t": f"{tmp_path}/t"}, "^a_key"))
    assert "COUNT(a_key)" in flat.replace("`", "") and "ReadSchema: struct<count" in flat
    with pytest.raises(ValueError, match="no column"):
        tables.footer_search(spark, {"t": f"{tmp_path}/t"}, "nothing")
    # The session that asks keeps its settings.
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


# --- sets --------------------------------------------------------------------
def test_bitmaps_count_as_distinct_does(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1998, 1999, 2001, None]), rng.choice([None, -5, 0, 1, 32767, 32768, 70000, 2**40])) for _ in range(400)]
    bitmaps = distinct_bitmaps(spark.createDataFrame(rows, "k string, year int, id long"), ["k", "year"], "id")
    known = [r for r in rows if r[2] is not None]

    def n(keep):
        return len({i for k, y, i in known if keep(k, y)})

    per_year = {(k, y): n(lambda a, b, k=k, y=y: a == k and b == y) for k, y, _ in known}
    assert {(r.k, r.year): r.n for r in distinct_in(bitmaps, ["k", "year"]).collect()} == per_year
    spans = {
        (k, a, b): n(lambda x, y, k=k, a=a, b=b: x == k and y is not None and a <= y <= b)
        for k in ("a", "b", None) for a, b in itertools.combinations_with_replacement(range(1998, 2002), 2)
    }
    got = {(r.k, r.first, r.last): r.n for r in distinct_in_spans(bitmaps, ["k"], "year").collect()}
    # A span without any row is absent.
    assert got == {s: v for s, v in spans.items() if v}
    assert distinct_in_spans(bitmaps.limit(0), ["k"], "year").count() == 0


# --- reconcile ---------------------------------------------------------------
def extracts(spark, changes):
    rows = [(None if i == 0 else i, f"z{i % 3}" if i % 5 else None, i / 7) for i in range(300)]
    new = spark.createDataFrame(rows, "k int, z string, v double")
    old = spark.createDataFrame([changes.get(i, r) for i, r in enumerate(rows) if changes.get(i, r)], new.schema)
    return new, old


def test_reconcile_finds_each_difference(spark):
    new, old = extracts(spark, {3: (3, "z0", 99.0), 4: None, 7: (7, "z1", 1.00001), 0: (None, None, None)})
    got = {(r.k, r.z): r.status for r in quality.reconcile(new, old, ["k", "z"], "v").collect()}
    assert got == {(3, "z0"): "changed", (4, "z1"): "added", (None, None): "changed"}
    got = {(r.k, r.z): r.status for r in quality.reconcile(old, new, ["k", "z"], "v", blocks=1).collect()}
    assert got == {(3, "z0"): "changed", (4, "z1"): "removed", (None, None): "changed"}


def test_equal_extracts_join_nothing(spark):
    new, old = extracts(spark, {})
    assert quality.reconcile(new, old.orderBy(F.rand(1)), ["k", "z"], "v").count() == 0
    block = F.pmod(F.xxhash64("k"), F.lit(16)).alias("_block")
    digests = [quality.block_digests(d.select("k", "v", block), ["k"], "v") for d in (new, old)]
    assert quality.differing_blocks(*digests).count() == 0


def test_digests_tell_repeats_and_null_places(spark):
    block = F.lit(0).alias("_block")

    def digest(rows):
        return quality.block_digests(spark.createDataFrame(rows, "a int, b int, v int").select("*", block), ["a", "b"], "v")

    for one, other in (
        ([(1, 1, 1)] * 2, [(1, 1, 2)] * 2),
        ([(1, None, 1)], [(None, 1, 1)]),
        ([(1, 1, 1)], [(1, 1, 1)] * 3),
    ):
        assert quality.differing_blocks(digest(one), digest(other)).count() == 1
        assert quality.differing_blocks(digest(one), digest(one)).count() == 0


# --- contour -------------------------------------------------------------------
def test_contour_against_neighbours(spark):
    rng = random.Random(5)
    xs, ys = [0.1, 0.2, 0.4, 0.8], [10, 20, 25, 40, 41]
    cells = [(s, x, y, rng.random() < 0.8) for s in ("p", None) for x in xs for y in ys]
    df = spark.createDataFrame(cells + cells[:3] + [("p", None, 10, True), ("p", 0.1, None, True)], "s string, x double, y int, inside boolean")
    inside = {(s, xs.index(x), ys.index(y)) for s, x, y, i in cells if i}
    want = []
    for s, i, j in inside:
        near = sum((s, i + a, j + b) in inside for a in (-1, 0, 1) for b in (-1, 0, 1)) - 1
        if near < 8:
            want.append((s, xs[i], ys[j], near, i in (0, 3) or j in (0, 4)))
    assert rows_of(md.profile_contour(df, "x", "y", ["s"])) == sorted(want, key=str)
    assert md.profile_contour(df.where("s = 'p' AND NOT inside"), "x", "y").count() == 0


# --- folded batches --------------------------------------------------------------
def test_folds_bound_what_is_read(spark):
    target = scratch_dir(spark, "folds")
    want = {}

    def write(n, rows):
        cells = [F.lit(v).alias(c) for c, v in zip(("week_start", "zone", "catch", "reports"), rows[0])]
        df = spark.range(1).coalesce(1).select(*cells).withColumn("zone", F.col("zone").cast("string"))
        weekly.merge_batch(df, n, target, fold_every=10)

    for n in range(100):
        # Every fourth batch corrects the first week, however late.
        week = dt.date(2024, 1, 1) + dt.timedelta(days=7 * (0 if n % 4 == 0 else n))
        write(n, [(week, "W", float(n), n)])
        want[week] = (float(n), n)
    # The last batch runs again with another value.
    week = dt.date(2024, 1, 1) + dt.timedelta(days=7 * 99)
    write(99, [(week, "W", -1.0, 1)])
    want[week] = (-1.0, 1)
    # A batch at a fold runs again after its fold was made.
    write(100, [(dt.date(2024, 1, 1), None, 5.0, 1)])
    write(100, [(dt.date(2024, 1, 1), None, 6.0, 1)])
    got = {(r.week_start, r.zone): (r.catch, r.reports) for r in weekly.latest(spark, target).collect()}
    assert got == {(w, "W"): v for w, v in want.items()} | {(dt.date(2024, 1, 1), None): (6.0, 1)}
    assert len(weekly._numbers(spark, target, weekly.BATCH)) <= 20
    assert weekly._numbers(spark, target, weekly.MARK) == [89, 99]
    assert weekly._numbers(spark, target, weekly.FOLD) == [89, 99]


def test_unfinished_fold_is_not_read(spark):
    target = scratch_dir(spark, "unfinished")
    schema = "week_start date, zone string, catch double, reports long"
    day = dt.date(2024, 1, 1)
    for n in range(3):
        weekly.merge_batch(spark.createDataFrame([(day, "W", float(n), 1)], schema), n, target)
    broken = spark.createDataFrame([(day, "W", 77.0, 1, 9)], f"{schema}, number long")
    broken.write.parquet(f"{target}/{weekly.FOLD}2")
    assert [r.catch for r in weekly.latest(spark, target).collect()] == [2.0]
    weekly.fold(spark, target, 3)
    assert [r.catch for r in weekly.latest(spark, target).collect()] == [2.0]
    with pytest.raises(ValueError, match="no batch"):
        weekly.latest(spark, scratch_dir(spark, "none"))
