"""Properties and brute-force checks on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, reshape, windows
from tidemark.plans import comps, spatial
from tidemark.session import scratch_dir
from tidemark.sources import sinks, text


@pytest.mark.parametrize("resolution, cuts", [(1, 0), (256, 1), (1, 3)])
def test_exact_quantiles_match_brute_force(spark, resolution, cuts):
    rng = random.Random(3)
    groups = {
        "hot": [rng.gauss(0, 50) for _ in range(3000)] + [7.0] * 1500,
        "ties": [1.0] * 40 + [2.0] * 3,
        "one": [4.5],
        "mixed": [-3.0, -1e-9, 0.0, 0.0, 1e-12, 2.0, 1e12],
        "two": [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), (None, 3.0), (None, 5.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.1, "med": 0.5, "hi": 0.9, "min": 0.0, "max": 1.0}
    got = {r.k: r for r in aggregates.exact_quantiles(df, ["k"], "v", probs, resolution, cuts).collect()}
    groups[None] = [3.0, 5.0]
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-12, abs=1e-18), (k, name)


def test_composition_sums_to_one_and_has_all_bins(spark):
    rng = random.Random(1)
    rows = [(y, rng.choice("FMU"), rng.uniform(0, 90), rng.random()) for y in (1999, 2001) for _ in range(400)]
    df = spark.createDataFrame(rows, "year int, sex string, length double, n double")
    c = F.col
    freq = comps.length_frequencies(df, c("year"), c("sex"), c("length"), c("n"))
    per_year = freq.groupBy("year").agg(F.sum("freq").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(1.0) and r.n == 66 for r in per_year) and len(per_year) == 2


def test_completion_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "x", 2.0), ("b", 2, "y", 3.0)], "k string, y int, z string, v double")
    once = reshape.complete_grid(df, ["k"], {"y": None, "z": ["x", "y", "w"]}, {"v": 0.0})
    twice = reshape.complete_grid(once, ["k"], {"y": None, "z": ["x", "y", "w"]}, {"v": 0.0})
    assert once.count() == 2 * 2 * 3
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_unpivot_undoes_pivot(spark):
    rows = [(i, k, float(i * 10 + j)) for i in range(20) for j, k in enumerate("abc")]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    wide = reshape.pivot_wide(df, ["id"], "k", "v", list("abc"))
    back = reshape.unpivot_long(wide, ["id"], list("abc"), "k", "v")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_group_value_plans_agree(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), (None, 4.0)], "k string, v double")
    raw = sorted(map(str, windows.group_value(df, ["k"], F.sum("v"), "t", raw=True).collect()))
    win = sorted(map(str, windows.group_value(df, ["k"], F.sum("v"), "t", raw=False).collect()))
    assert raw == win and len(raw) == 4


def test_chunked_fill_equals_plain_fill(spark):
    rng = random.Random(5)
    rows = [(g, i // 7, i, rng.choice([None, None, None, i])) for g in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "g string, chunk int, i int, v int")
    plain = windows.carry_forward(df, ["g"], ["i"], ["v"])
    chunked = windows.carry_forward_chunked(df, ["g"], "chunk", ["i"], ["v"])
    assert sorted(map(str, plain.collect())) == sorted(map(str, chunked.collect()))


def test_idw_matches_brute_force(spark):
    rng = random.Random(2)
    pts = [(rng.uniform(-100, 100), rng.uniform(-100, 100), rng.uniform(0, 9000)) for _ in range(60)] + [(15.0, 25.0, 77.0)]
    df = spark.createDataFrame(pts, "x double, y double, z double")
    cell, radius = 10.0, 33.0
    got = {(r.cell_x, r.cell_y): (r.value, r.points) for r in spatial.idw_grid(df, F.col("x"), F.col("y"), F.col("z"), cell, radius).collect()}
    want = {}
    for cx in range(-20, 21):
        for cy in range(-20, 21):
            mx, my = (cx + 0.5) * cell, (cy + 0.5) * cell
            near = [((x - mx) ** 2 + (y - my) ** 2, z) for x, y, z in pts]
            near = [(d, z) for d, z in near if d <= radius * radius]
            if near:
                exact = [z for d, z in near if d == 0]
                v = sum(exact) / len(exact) if exact else sum(z / d for d, z in near) / sum(1 / d for d, z in near)
                want[(cx, cy)] = (v, len(near))
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


# --- text over many splits --------------------------------------------------
@pytest.fixture()
def tiny_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def _file(tmp_path, name, lines):
    p = tmp_path / name
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_tagged_sections_across_splits(spark, tmp_path, tiny_splits):
    vec = {"yrs": list(range(1984, 2022)), "biomA": [1000.5 + i for i in range(38)], "few": [1, 2, 3]}
    for name in ("a.rep", "b.rep"):
        lines = []
        for k, v in vec.items():
            lines.append(k)
            for i in range(0, len(v), 9):
                lines.append(" " + " ".join(map(str, v[i : i + 9])))
        _file(tmp_path, name, lines)
    assert text.read_lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 4
    got = {(r.path.rsplit("/", 1)[1], r.tag, r.yrs): r.value for r in text.report_vectors(spark, str(tmp_path)).collect()}
    assert got == {(f, "biomA", y): v for f in ("a.rep", "b.rep") for y, v in zip(vec["yrs"], vec["biomA"])}


def test_blocks_and_markers_across_splits(spark, tmp_path, tiny_splits):
    bins = [2, 4]
    lines = ["# catch"] + [f"{y} 1 1 {y * 1.5} 0.01 # c" for y in range(1980, 2000)] + ["-9999 0 0 0 0", ""]
    lines += [f"{y}\t7\t1\t3\t0\t50\t0.1\t0.2\t0.3\t0.4" for y in range(1990, 1999)] + ["-9999 0 0", "0 # end"]
    path = _file(tmp_path, "data.txt", lines)
    rows = text.terminated_blocks(spark, path)
    catch = text.numeric_rows(rows, 0, ["yr", "seas", "fleet", "catch", "se"]).collect()
    assert sorted((r.yr, r.catch) for r in catch) == [(float(y), y * 1.5) for y in range(1980, 2000)]
    comp = text.composition_block(rows, 1, ["yr", "month", "fleet", "sex", "part", "n"], bins)
    assert {(r.bin_sex, r.bin, r.freq) for r in comp.where("yr = 1995").collect()} == {("F", 2, 0.1), ("F", 4, 0.2), ("M", 2, 0.3), ("M", 4, 0.4)}
    between = text.lines_between(spark, path, r"^1985", r"^1990 1").count()
    assert between == 4
    after = text.rows_after_marker(spark, path, r"^-9999 0 0 0 0", r"^\d{4}\s", "yr int, month int").count()
    assert after == 9


def test_preamble_files(spark, tmp_path, tiny_splits):
    for y in (2020, 2021):
        _file(
            tmp_path, f"{y}.csv",
            ["Report of the week", "as of, today", "", "ACCOUNT.NAME,WEEK.END.DATE,METRIC.TONS"]
            + [f'"Sole, rock {i}",{1 + i % 12}/{1 + i % 28}/{y},{i}.25' for i in range(30)],
        )
    w = text.weekly_catch(spark, str(tmp_path), glob="*.csv")
    assert w.count() == 60 and w.where("date is null or catch is null").count() == 0
    assert w.agg(F.sum("catch")).first()[0] == pytest.approx(2 * (sum(range(30)) + 30 * 0.25))


def test_key_value_report(spark, tmp_path, tiny_splits):
    path = _file(
        tmp_path, "sara.dat",
        ["#Stock results file", "#prose line about fields", "#STOCK - short code", '"ROCKSOLE"', "#STOCK_NAME - name", '"Rock sole - Gulf"',
         "#FISHERYYEAR -list years", "1978 1979\t1980", "#B_MSY - level", "32404"],
    )
    got = {}
    for r in text.key_value_report(spark, path).orderBy("section", "pos").collect():
        got.setdefault(r.tag, []).append(r.value)
    assert got == {"STOCK": ["ROCKSOLE"], "STOCK_NAME": ["Rock sole - Gulf"], "FISHERYYEAR": ["1978", "1979", "1980"], "B_MSY": ["32404"]}


def test_ordered_text_round_trip(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), F.concat(F.lit("line "), F.col("id")).alias("value"))
    path = sinks.ordered_text(df.repartition(7), scratch_dir(spark, "t"), ["n"], by=["k"])
    import glob

    for k in range(3):
        lines = []
        for part in sorted(glob.glob(f"{path}/k={k}/part-*")):
            lines += open(part).read().splitlines()
        assert lines == [f"line {i}" for i in range(5000) if i % 3 == k]


def test_template_keeps_header_and_bumps_count(spark):
    lines = spark.createDataFrame(
        [(1, "# setup"), (2, "# years"), (3, "3"), (4, "# Catch in each future year"), (5, "2022 1"), (6, "2023 2")], "n long, value string"
    )
    new = spark.createDataFrame([(2023, "2023 9"), (2024, "2024 8")], "n long, value string")
    out = sinks.replace_after_marker(lines, new, "future year", 3).orderBy("part", "n").collect()
    assert [r.value for r in out] == ["# setup", "# years", "4", "# Catch in each future year", "2023 9", "2024 8"]


def test_jdbc_options_take_credentials_from_the_caller():
    from tidemark.sources.tables import jdbc_options

    o = jdbc_options(url="jdbc:x", query="select 1", user="u", password="p")
    assert o["query"] == "select 1" and o["user"] == "u"
    o = jdbc_options(url="jdbc:x", table="t", partition=("year", 1980, 2020, 40))
    assert o["numPartitions"] == "40" and o["dbtable"] == "t" and "query" not in o and "user" not in o
    with pytest.raises(ValueError):
        jdbc_options(url="jdbc:x")


def test_catalog_search(spark):
    from tidemark.sources.tables import catalog_columns

    spark.range(1).selectExpr("id as HAUL_LENGTH", "id as other").createOrReplaceTempView("find_me")
    got = [tuple(r) for r in catalog_columns(spark, "LENGTH", "find_me").collect()]
    assert got == [("find_me", "HAUL_LENGTH", "bigint")]


def test_haul_key_keeps_all_digits(spark):
    from tidemark.plans.survey import haul_key

    df = spark.sql("select cast('1234567890123456789' as decimal(38,0)) as h, 7 as s")
    assert df.select(haul_key(F.col("h"), F.col("s")).alias("k")).first().k == "12345678901234567897"
    assert math.isfinite(1.0)


def test_stream_merges_later_files(spark, tmp_path):
    from tidemark.streaming import weekly

    schema = "ts timestamp, zone string, catch double"
    base = scratch_dir(spark, "stream")
    first = spark.createDataFrame([("2024-01-02 00:00:00", "W", 1.0), ("2024-01-09 00:00:00", "W", 2.0)], "ts string, zone string, catch double")
    later = spark.createDataFrame([("2024-01-03 00:00:00", "W", 5.0), ("2024-01-10 00:00:00", "C", 3.0)], "ts string, zone string, catch double")

    def land(df):
        df.select(F.col("ts").cast("timestamp"), "zone", "catch").write.mode("append").parquet(f"{base}/in")

    def run():
        files = weekly.stream_files(spark, f"{base}/in", schema)
        weekly.run_to_table(weekly.weekly_totals(files, F.col("ts"), F.col("zone"), F.col("catch")), f"{base}/out", f"{base}/state")

    land(first)
    run()
    land(later)
    run()
    got = {(str(r.week_start), r.zone): (r.catch, r.reports) for r in weekly.latest(spark, f"{base}/out").collect()}
    assert got == {("2024-01-01", "W"): (6.0, 2), ("2024-01-08", "W"): (2.0, 1), ("2024-01-08", "C"): (3.0, 1)}
