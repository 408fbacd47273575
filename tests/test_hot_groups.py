"""Ranks, running sums and trailing means over chunks against the plain window, with one hot group, ties and null keys."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tidemark.operators import windows


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = [("hot", rng.randrange(1900, 2000), float(rng.randrange(50))) for _ in range(6000)]
    rows += [("tied", 1990, 7.0)] * 500
    rows += [(None, rng.choice([None, *range(1950, 1990)]), float(rng.randrange(9))) for _ in range(300)]
    rows += [("small", 1999, None), ("none", 2000, None), ("none", 2001, None), ("z", 2000, 1.0), ("z", 2003, 0.0)]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, year int, v double, id int").repartition(4)


def keyed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def plain(*order):
    return Window.partitionBy("k").orderBy(*order)


def test_row_number(hot):
    order = [F.col("year").desc(), "id"]
    got = windows.ranged_row_number(hot, ["k"], order, chunks=16)
    want = hot.withColumn("row", F.row_number().over(plain(*order)).cast("long"))
    assert keyed(got, "k", "id", "row") == keyed(want, "k", "id", "row")
    assert got.columns == [*hot.columns, "row"]


def test_ties_are_numbered_once_and_spread(hot):
    got = windows.ranged_row_number(hot.drop("id"), ["k"], ["year"], chunks=16)
    numbers = {}
    for r in got.collect():
        numbers.setdefault(r.k, []).append((r.row, r.year if r.year is not None else -1))
    for rows in numbers.values():
        rows.sort()
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1))
        assert [y for _, y in rows] == sorted(y for _, y in rows)
    chunks = windows.ranged(hot.where("k = 'tied'").drop("id"), ["k"], ["year"], chunks=8).groupBy("_chunk").count().collect()
    assert len(chunks) == 8 and max(r["count"] for r in chunks) < 200
    assert windows.ranged_row_number(hot.where("false"), ["k"], ["year"]).collect() == []


def test_running_sum_and_share(hot):
    got = windows.ranged_running_sum(hot, ["k"], ["year", "id"], "v", "total", share="part", chunks=16)
    rows = plain("year", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("total", F.sum("v").over(rows)).withColumn("part", F.try_divide("total", F.sum("v").over(Window.partitionBy("k"))))
    assert keyed(got, "k", "id", "total", "part") == keyed(want, "k", "id", "total", "part")


@pytest.mark.parametrize("years", [1, 5, 40])
def test_trailing_mean(hot, years):
    got = windows.ranged_trailing_mean(hot, ["k"], "year", "v", years, "mean", chunks=32)
    want = hot.where("year IS NOT NULL").withColumn("mean", F.avg("v").over(plain("year").rangeBetween(-years, -1))).select("k", "year", "mean").distinct()
    assert keyed(got.where("year IS NOT NULL"), "k", "year", "mean") == keyed(want, "k", "year", "mean")
    assert [tuple(r) for r in got.where("year IS NULL").collect()] == [(None, None, None)]
