"""Unique pivot cells, completed grids and the smoother's defined cases."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import reshape
from tidemark.plans import smoothing


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_two_rows_in_a_cell_fail_and_name_it(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (None, "b", 4.0), (None, "b", 5.0)], "id int, k string, v double")
    with pytest.raises(PySparkException, match=r"more than one row for cell \(null, b\)"):
        reshape.pivot_wide(df, ["id"], "k", "v", ["a", "b"]).collect()
    assert table(reshape.pivot_wide(df, ["id"], "k", "v", ["a", "b"], combine="sum")) == [(1, 2.0, 3.0), (None, None, 9.0)]
    # Equal rows are two rows as well; a null value still fills its cell.
    same = spark.createDataFrame([(1, "a", None), (1, "a", None)], "id int, k string, v double")
    with pytest.raises(PySparkException, match="more than one row"):
        reshape.pivot_wide(same, ["id"], "k", "v", ["a"]).collect()


def test_pivot_keeps_ids_of_other_levels(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "x", 3.0), (3, None, 4.0), (2, "x", 3.0)], "id int, k string, v double")
    assert table(reshape.pivot_wide(df, ["id"], "k", "v", ["a"], fill=0.0)) == [(1, 2.0), (2, 0.0), (3, 0.0)]


def test_pivot_takes_one_exchange(spark):
    df = spark.range(100).selectExpr("id % 7 AS id", "id DIV 7 AS k", "id * 1.0 AS v")
    plan = reshape.pivot_wide(df, ["id"], "k", "v", list(range(15)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


GRID = [("a", 1, "x", 2.0), ("a", 2, "q", 3.0), ("b", None, "x", 4.0), (None, 2, None, 5.0)]
GRID_SCHEMA = "k string, y int, z string, v double"


def test_grid_loses_no_row(spark):
    df = spark.createDataFrame(GRID, GRID_SCHEMA)
    got = table(reshape.complete_grid(df, ["k"], {"y": None, "z": ["x", "w"]}, {"v": 0.0}))
    values = {("a", 1, "x"): 2.0}
    full = [(k, y, z, values.get((k, y, z), 0.0)) for k in ("a", "b", None) for y in (1, 2) for z in "xw"]
    kept = [r for r in GRID if r[1] is None or r[2] not in ("x", "w")]
    assert got == sorted(full + kept, key=str)
    assert len(reshape.complete_grid(df, ["k"], {"y": None, "z": ["x", "w"]}, unlisted="drop").collect()) == 12
    with pytest.raises(PySparkException, match=r"level not listed in cell"):
        reshape.complete_grid(df, ["k"], {"y": None, "z": ["x", "w"]}, unlisted="fail").collect()
    report = table(reshape.unlisted_levels(df, {"y": None, "z": ["x", "w"]}))
    assert report == sorted([("y", None, 1), ("z", "q", 1), ("z", None, 1)], key=str)


def test_grid_names_a_repeated_cell(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "k string, y int, v double")
    for levels in (None, [1, 2]):
        with pytest.raises(PySparkException, match=r"more than one row for cell \(a, 1\)"):
            reshape.complete_grid(df, ["k"], {"y": levels}).collect()


def test_grid_without_any_level_or_row(spark):
    df = spark.createDataFrame([("a", None, 2.0)], "k string, y int, v double")
    assert table(reshape.complete_grid(df, ["k"], {"y": None})) == [("a", None, 2.0)]
    assert reshape.complete_grid(df.where("false"), ["k"], {"y": None}).collect() == []


def test_grid_with_spine(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "k string, y int, v double")
    spine = spark.createDataFrame([("a",), ("c",), (None,)], "k string")
    got = table(reshape.complete_grid(df, ["k"], {"y": [1, 2]}, {"v": 0.0}, spine=spine))
    assert got == sorted([(k, y, 2.0 if (k, y) == ("a", 1) else 0.0) for k in ("a", "c", None) for y in (1, 2)], key=str)


def test_too_many_levels_fail(spark):
    with pytest.raises(Exception, match="more than 10 levels of id"):
        spark.range(1).select(reshape.level_dictionary(spark.range(50), "id", max_levels=10)).collect()


SERIES = "strata string, year int, biomass double, cv double"


def test_smoother_reports_bounds_and_keeps_every_stratum(spark):
    flat = [("flat", y, 10.0, 0.1) for y in range(2000, 2010)]
    wild = [("wild", y, 10.0 ** (9 if y % 2 else -9), 0.01) for y in range(2000, 2010)]
    empty = [("empty", 2001, 0.0, 0.1), ("empty", 2003, 5.0, None)]
    late = [("late", 2000, 0.0, 0.1), ("late", 2002, 4.0, 0.2), ("late", 2004, 5.0, 0.2)]
    df = spark.createDataFrame([*flat, *wild, *empty, *late, (None, 2000, 3.0, 0.2)], SERIES)
    rows = smoothing.smooth_random_walk(df, ["strata"], end_year=2005).collect()
    fit = {r.strata: r.fit for r in rows}
    assert fit == {"flat": "low bound", "wild": "high bound", "empty": "no survey", "late": fit["late"], None: "one survey"}
    by = {(r.strata, r.year): r for r in rows}
    assert [y for s, y in sorted(by, key=str) if s == "empty"] == [2001, 2002, 2003, 2004, 2005]
    assert by["empty", 2001].obs == 0.0 and by["empty", 2001].estimate is None
    assert by["late", 2000].obs == 0.0 and by["late", 2001].estimate is None and by["late", 2002].estimate is not None
    assert math.isclose(by[None, 2005].estimate, 3.0)
    assert len(rows) == 10 + 10 + 5 + 6 + 6


def test_smoother_duplicate_years(spark):
    df = spark.createDataFrame([("a", 2000, 10.0, 0.1), ("a", 2000, 1000.0, 0.1)], SERIES)
    with pytest.raises(Exception, match="more than one survey row for a 2000"):
        smoothing.smooth_random_walk(df, ["strata"]).collect()
    assert smoothing.smooth_random_walk(df, ["strata"], duplicates="mean").first().obs == 505.0


def test_smoother_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a", 2000, 10.0, 0.1)], SERIES)
    plan = smoothing.smooth_random_walk(df, ["strata"])._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
