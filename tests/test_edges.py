"""Rows that earlier plans lost or changed: null keys, null values, infinities, late rows, absent markers."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.aggregates import exact_quantiles
from tidemark.operators.filters import groups_with_a_value
from tidemark.operators.reshape import complete_grid
from tidemark.operators.windows import carry_forward, carry_forward_chunked
from tidemark.plans import comps
from tidemark.session import scratch_dir
from tidemark.sources.sinks import replace_after_marker
from tidemark.streaming import weekly


def test_null_key_group_is_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", None), ("b", 2.0)], "k string, v double")
    want = sorted([(None, 1.0), (None, None), ("b", 2.0)], key=str)
    for raw in (True, False):
        assert sorted((tuple(r) for r in groups_with_a_value(df, ["k"], "v", raw).select("k", "v").collect()), key=str) == want


def test_null_key_is_carried(spark):
    df = spark.createDataFrame([(None, 1, 1, 5.0), (None, 2, 2, None), ("a", 1, 1, None), ("a", 2, 2, 3.0)], "k string, c int, o int, v double")
    a = sorted(map(str, carry_forward(df, ["k"], ["o"], ["v"]).collect()))
    assert a == sorted(map(str, carry_forward_chunked(df, ["k"], "c", ["o"], ["v"]).collect()))


def test_null_key_cell_keeps_its_value(spark):
    df = spark.createDataFrame([(None, 1, 5.0), ("a", 2, 7.0)], "k string, l int, v double")
    got = {(r.k, r.l): r.v for r in complete_grid(df, ["k"], {"l": None}, {"v": 0.0}).collect()}
    assert got == {(None, 1): 5.0, (None, 2): 0.0, ("a", 1): 0.0, ("a", 2): 7.0}


def test_null_length_is_in_no_total(spark):
    df = spark.createDataFrame([(2000, "F", 20.0, 1.0), (2000, "F", None, 1.0)], "y int, s string, l double, n double")
    out = comps.length_frequencies(df, F.col("y"), F.col("s"), F.col("l"), F.col("n"))
    assert out.agg(F.sum("freq")).first()[0] == 1.0


def test_quantiles_keep_null_groups_and_infinities(spark):
    rows = [("n", None), ("n", math.nan), ("i", math.inf), ("i", -math.inf), ("i", 1.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for cuts in (0, 1, 3):
        got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", {"q": 0.5}, cuts=cuts).collect()}
        assert got == {"n": None, "i": 1.0, None: 3.0}
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", {"q": 1.0}).collect()}
    assert got["i"] == math.inf


def test_absent_marker_fails(spark):
    lines = spark.createDataFrame([(1, "a"), (2, "5")], "n int, value string")
    assert replace_after_marker(lines, lines, "^a$", 2).count() == 3
    with pytest.raises(PySparkException, match="no line matches"):
        replace_after_marker(lines, lines, "absent", 2).collect()


def test_late_corrections_arrive(spark):
    base = scratch_dir(spark, "late")
    days = [dt.datetime(2024, 1, 8), dt.datetime(2024, 6, 3), dt.datetime(2024, 1, 9)]
    schema = "ts timestamp, zone string, catch double"
    for i, (d, c) in enumerate(zip(days, (1.0, 2.0, 5.0))):
        spark.createDataFrame([(d, "z", c)], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = weekly.stream_files(spark, f"{base}/in", schema)
        weekly.run_to_table(weekly.weekly_totals(stream, F.col("ts"), F.col("zone"), F.col("catch")), f"{base}/out", f"{base}/state")
    got = sorted(map(str, weekly.latest(spark, f"{base}/out").collect()))
    batch = weekly.weekly_totals(spark.read.parquet(f"{base}/in"), F.col("ts"), F.col("zone"), F.col("catch"))
    assert got == sorted(map(str, batch.collect()))
