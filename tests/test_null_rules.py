"""Null, rounding, week and parsing rules."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import dates, nulls, rounding, stats, text
from tidemark.operators import joins, windows


def one(spark, *cols, **values):
    row = spark.range(1).select(*[F.lit(v).alias(n) if v is not None else F.lit(None).cast("double").alias(n) for n, v in values.items()])
    return row.select(*cols).first()


def test_sums_and_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "k string, x double")
    got = {
        r.k: (r.s, r.l, r.m)
        for r in df.groupBy("k").agg(
            nulls.strict_sum("x").alias("s"), nulls.lenient_sum("x").alias("l"), nulls.strict_mean("x").alias("m")
        ).collect()
    }
    assert got == {"a": (None, 1.0, None), "b": (2.0, 2.0, 2.0), "c": (None, 0.0, None)}


def test_row_sum(spark):
    r = one(spark, nulls.row_sum("a", "b").alias("s"), nulls.row_sum("a", "b", skip_null=True).alias("t"), a=1.0, b=None)
    assert (r.s, r.t) == (None, 1.0)


def test_member_and_if_else(spark):
    r = one(
        spark,
        nulls.member("a", [1.0, 2.0]).alias("m"),
        nulls.if_else(F.col("a") > 0, "yes", "no").alias("i"),
        nulls.if_else(F.col("b") > 0, "yes", "no").alias("j"),
        a=None, b=-1.0,
    )
    assert (r.m, r.i, r.j) == (False, None, "no")


def test_null_keys_match_in_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(None, "p"), (2, "q")], "k int, b string")
    inner = joins.null_safe_join(a, b, ["k"]).collect()
    assert [(r.k, r.a, r.b) for r in inner] == [(None, "y", "p")]
    outer = {(r.k, r.a, r.b) for r in joins.null_safe_join(a, b, ["k"], "full_outer").collect()}
    assert outer == {(1, "x", None), (None, "y", "p"), (2, None, "q")}


def test_rounding(spark):
    r = one(
        spark,
        rounding.round_even(F.lit(2.5)).alias("a"),
        rounding.round_even(F.lit(3.5)).alias("b"),
        rounding.round_away(F.lit(2.5)).alias("c"),
        rounding.round_away(F.lit(-2.5)).alias("d"),
        rounding.round_by_size(F.lit(0.126)).alias("e"),
        rounding.round_by_size(F.lit(1.0)).alias("f"),
        rounding.round_by_size(F.lit(12.6)).alias("g"),
        rounding.mask_small(F.lit(0.3)).alias("h"),
        rounding.mask_small(F.lit(7.6)).alias("i"),
    )
    assert list(r) == [2.0, 4.0, 3.0, -3.0, 0.13, 1.0, 13.0, "<1", "8"]


def test_rounding_looks_at_the_stored_number(spark):
    # 0.45 is as far from 0.4 as from 0.5 in double arithmetic: a tie, to the even digit.
    assert 0.45 - 0.4 == 0.5 - 0.45 and 0.15 - 0.1 < 0.2 - 0.15 and 0.65 - 0.6 > 0.7 - 0.65
    xs = [0.15, 0.25, 0.35, 0.45, 0.55, 0.65, -0.15, -0.25, 1e300, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(rounding.round_even("x", 1).alias("y"))
    assert [r.y for r in df.collect()] == [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, -0.1, -0.2, 1e300, None]


def test_weeks_are_seven_day_blocks_from_new_year(spark):
    days = ["2022-01-01", "2022-01-07", "2022-01-08", "2020-12-31", "2021-01-03"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(dates.week_of_year(F.to_date("d")).alias("w"))
    assert [r.w for r in df.collect()] == [1, 1, 2, 53, 1]


def test_month_first_dates(spark):
    texts = ["10/13/2022", "1/3/95", "1/3/22", "Oct 13, 2022", "13/10/2022", "n/a", None]
    df = spark.createDataFrame([(x,) for x in texts], "d string").select(dates.parse_month_first("d").alias("d"))
    assert [r.d for r in df.collect()] == [
        dt.date(2022, 10, 13), dt.date(1995, 1, 3), dt.date(2022, 1, 3), dt.date(2022, 10, 13), None, None, None,
    ]


def test_text(spark):
    r = one(
        spark,
        text.paste(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), sep="-").alias("p"),
        text.comma_number(F.lit("40,503")).alias("n"),
        text.comma_number(F.lit("x")).alias("x"),
        text.part_of(F.lit("Main_RecrDev_1990_b"), 3, "_", 3).alias("q"),
        text.part_of(F.lit("one"), 2).alias("none"),
        rounding.value_sd_text(F.lit("1"), F.lit(None).cast("string")).alias("v"),
    )
    assert list(r) == ["a-NA-b", 40503.0, None, "1990_b", None, "1 ()"]


def test_division_and_bins(spark):
    r = one(
        spark,
        stats.cv(F.lit(4.0), F.lit(0.0)).alias("cv"),
        stats.length_bin(F.lit(3.0)).alias("a"),
        stats.length_bin(F.lit(7.9)).alias("b"),
        stats.length_bin(F.lit(99.0)).alias("c"),
        stats.length_bin(F.lit(None).cast("double")).alias("d"),
        stats.age_bin(F.lit(35)).alias("e"),
        stats.class_of(F.lit(500.0)).alias("f"),
        stats.class_of(F.lit(500.1)).alias("g"),
        stats.class_of(F.lit(99999.0)).alias("h"),
    )
    assert list(r) == [None, 6, 6, 70, None, 29, 1, 2, 6]


def test_ties_are_kept(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 4), ("d", 4), ("e", 1)], "k string, n int").withColumn("g", F.lit(1))
    assert {r.k for r in windows.top_with_ties(df, ["g"], "n", 3).collect()} == {"a", "b", "c", "d"}


def test_scalar_table_must_have_one_row(spark):
    import pytest

    two = spark.createDataFrame([(0.4,), (0.6,)], "f double")
    with pytest.raises(Exception, match="more than one row|MORE_THAN_ONE_ROW|SCALAR_SUBQUERY"):
        joins.with_scalar(spark.range(2), two, "f").collect()
