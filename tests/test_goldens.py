"""Published values of one stock, typed in as constants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.plans import apportion, catch, comps, scenarios, smoothing, survey

# Survey years, biomass and CVs of one area (fixed values).
SURVEY_YEARS = [1984, 1987, 1990, 1993, 1996, 1999, 2001, 2003, 2005, 2007, 2009, 2011, 2013, 2015, 2017, 2019, 2021]
BIOMASS = [
    45099.6, 33603.1, 58740.1, 57760.4, 66731.7, 49636.4, 68164.3, 67054.6, 59458, 78360.9, 80115.4, 76049, 62131.2,
    67664.6, 99008.5, 66710.4, 46234.2,
]
CVS = [
    0.410665680400556, 0.186620252855454, 0.192116265030148, 0.205833087404695, 0.182746331306292, 0.209928661776012,
    0.200114587708087, 0.126911432980876, 0.174762362581231, 0.160455753986569, 0.208019415285707, 0.157842658856334,
    0.190620274243577, 0.178964103410848, 0.189152812464607, 0.165387480648327, 0.209001788734069,
]
# Log-scale errors printed for the same series (fixed values).
LOG_SE = [
    0.394773, 0.185025, 0.190378, 0.203702, 0.181248, 0.207669, 0.198153, 0.126405, 0.17345, 0.159437, 0.20582,
    0.156873, 0.188922, 0.177555, 0.187493, 0.164273, 0.206772,
]


@pytest.fixture(scope="module")
def area(spark):
    rows = [("West", y, float(b), c) for y, b, c in zip(SURVEY_YEARS, BIOMASS, CVS)]
    return spark.createDataFrame(rows, "strata string, year int, biomass double, cv double")


def test_log_se(area):
    got = [r.s for r in area.orderBy("year").select(stats.log_se("cv").alias("s")).collect()]
    assert got == pytest.approx(LOG_SE, abs=1e-6)


def test_smoother_matches_published_fit(area):
    rows = {r.year: r for r in smoothing.smooth_random_walk(area, ["strata"]).collect()}
    assert sorted(rows) == list(range(1984, 2022))
    first, mid, last = rows[1984], rows[2000], rows[2021]
    assert first.log_sigma == pytest.approx(-2.74124, abs=1e-3)
    assert first.nll == pytest.approx(0.208580, abs=1e-5)
    assert (first.estimate, mid.estimate, last.estimate) == pytest.approx((45997.7, 61789.2, 63136.8), rel=1e-4)
    assert (first.lci, mid.lci, last.lci) == pytest.approx((32180.5, 51206.5, 48550.8), rel=1e-4)
    assert (first.uci, mid.uci, last.uci) == pytest.approx((65747.6, 74559.1, 82104.9), rel=1e-4)
    assert (first.low90, last.upp90) == pytest.approx((34082.1, 78710.7), rel=1e-4)
    assert (first.log_sd, last.log_sd) == pytest.approx((0.182261, 0.134027), abs=1e-5)
    assert mid.obs is None and last.obs == 46234.2


def test_smoother_fills_to_end_year_and_handles_one_survey(spark):
    df = spark.createDataFrame([("a", 2000, 10.0, 0.1), ("b", 2000, 5.0, 0.2), ("b", 2002, 6.0, 0.2)], "strata string, year int, biomass double, cv double")
    rows = smoothing.smooth_random_walk(df, ["strata"], end_year=2004).collect()
    assert {(r.strata, r.year) for r in rows} == {(s, y) for s in "ab" for y in range(2000, 2005)}
    assert all(r.estimate == pytest.approx(10.0) for r in rows if r.strata == "a")


def test_reference_points(spark):
    df = spark.createDataFrame([("s", 92.5823, 91.8344)], "stock string, b100 double, now double")
    r = scenarios.reference_points(df, "b100", "now", ["stock"]).first()
    assert (r.b40, r.b35) == pytest.approx((37.0329, 32.4038), abs=1e-4)


def test_reference_table_rounds_and_orders(spark):
    summary = [
        (1, y, m, v)
        for y, k in ((2024, 0), (2025, 1))
        for m, v in (("SSBMean", 96.6649), ("SSBF100", 92.5823), ("SSBFabc", 37.0329), ("SSBFofl", 32.4038), ("Fofl", 0.4664 + k), ("Fabc", 0.375))
    ]
    s = spark.createDataFrame(summary, "alt int, year int, metric string, value double")
    run = spark.createDataFrame(
        [(2024, 1.908, 40.503, 49.414, 96.6, 294.5), (2025, 1.908, 41.258, 50.322, 98.9, 293.6)],
        "year int, Catch double, ABC double, OFL double, SSB double, TotBiom double",
    )
    rows = {r.ord: r for r in scenarios.reference_table(s, run, (2024, 2025)).collect()}
    assert sorted(rows) == list(range(1, 12))
    assert (rows[11].label, rows[11].y2024, rows[11].y2025) == ("ABC (t)", 40503.0, 41258.0)
    assert (rows[9].y2024, rows[9].y2025) == (49414.0, 50322.0)
    assert (rows[6].y2024, rows[6].y2025) == (0.47, 1.47)
    assert rows[7].metric == rows[8].metric == "Fabc" and rows[7].y2024 == 0.38


def test_projection_vector_rules(spark):
    annual = spark.createDataFrame(
        [(2017, 2050.49), (2018, 2202.28), (2019, 2667.93), (2020, 1911.45), (2021, 707.78), (2022, 600.0)], "year int, catch double"
    )
    estimate = spark.createDataFrame([(687.0,)], "predicted_catch double")
    rows = {r.year: (r.catch, r.source) for r in catch.projection_vector(annual, estimate, 2022).collect()}
    mean = (2050.49 + 2202.28 + 2667.93 + 1911.45 + 707.78) / 5
    assert rows[2020] == (1911.45, "observed") and rows[2022] == (687.0, "estimated")
    assert rows[2023][0] == pytest.approx(mean) and rows[2024][1] == "mean"
    assert mean == pytest.approx(1907.968, abs=0.05)


def test_inseason_estimate_by_hand(spark):
    weekly = spark.createDataFrame(
        [(2021, 30, 5.0), (2021, 40, 7.0), (2021, 50, 3.0), (2020, 45, 4.0), (2019, 10, 100.0), (2015, 50, 1000.0), (2022, 20, 50.0)],
        "year int, week int, catch double",
    )
    to_date = spark.createDataFrame([(50.0,)], "catch double")
    r = catch.inseason_estimate(weekly, to_date, dt.date(2022, 8, 15)).first()
    # Day 227 is week 33: 2021 adds 10, 2020 adds 4, 2019 has nothing later and does not enter.
    assert (r.catch_to_add, r.predicted_catch, r.expansion_factor) == (7.0, 57.0, 1.14)
    r = catch.inseason_estimate(weekly, to_date, dt.date(2022, 8, 15), years_back=None).first()
    assert r.catch_to_add == pytest.approx((10 + 4 + 1000) / 3)


def test_recruit_stats_by_hand(spark):
    xs = [181867.1, 190543.2, 182161.0, 124447.3, 218847.0]
    df = spark.createDataFrame([("s", x) for x in xs], "stock string, rec double")
    r = scenarios.recruit_stats(df, ["stock"], "rec").first()
    mean, harm = sum(xs) / 5, 5 / sum(1 / x for x in xs)
    assert (r.mean_rec, r.harmonic_rec) == pytest.approx((mean, harm))
    assert r.cv_rec == pytest.approx(math.sqrt(mean / harm - 1))


def test_control_rule_knees(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.05, 0.4 / 0.35, 2.0, None)], "r double")
    rows = scenarios.with_control_rules(df, "r").collect()
    assert [r.ofl_rule for r in rows[:4]] == pytest.approx([0.0, 0.0, 1.0, 1.0])
    assert [r.abc_rule for r in rows[:4]] == pytest.approx([0.0, 0.0, 0.8, 0.8])
    assert rows[4].ofl_rule is None


def test_index_limits_golden(spark):
    obs, cv = 185840.1, 0.094379743
    df = spark.createDataFrame([(2019, obs, (obs * cv) ** 2)], "year int, biomass double, variance double")
    r = survey.index_with_limits(df).first()
    assert (r.obs, r.cv) == pytest.approx((obs, cv))
    assert r.uci - r.obs == pytest.approx(obs * cv)


def test_apportionment_adds_up(spark):
    shares = spark.createDataFrame([("W", 0.3337), ("C", 0.5012), ("WY", 0.0951), ("SE", 0.07)], "strata string, share double")
    out = apportion.rounded_parts(shares, {2024: 40503.0, 2025: 41258.0})
    totals = {r.year_limit: r.s for r in out.groupBy("year_limit").agg(F.sum("area_abc").alias("s")).collect()}
    assert totals == {2024: 40503.0, 2025: 41258.0}
    named = apportion.rounded_parts(shares, {2024: 40503.0}, adjust_area="WY").groupBy().agg(F.sum("area_abc")).first()[0]
    assert named == 40503.0


def test_caal_invariants(spark):
    rows = [(2001, s, 200.0 + 7 * i, (i % 31) or None, 5.0 if i % 9 else None) for i in range(300) for s in (1, 2, 3)]
    df = spark.createDataFrame(rows, "year int, sex int, length double, age int, weight double")
    c = F.col
    long = comps.caal_long(df, c("year"), c("sex"), c("length"), c("age"), c("weight"))
    wide = comps.caal_rows(long).collect()
    kept = [r for r in rows if r[1] != 3 and r[3] is not None and r[4] is not None]
    assert sum(r.nsamp for r in wide) == len(kept)
    for r in wide:
        females = [r[f"f{a}"] for a in range(1, 30)]
        assert females == [r[f"m{a}"] for a in range(1, 30)] and sum(females) == r.nsamp > 0
    assert {r.sex for r in wide} == {1, 2}


def test_percent_can_be_rounded_twice(spark):
    shares = spark.createDataFrame([("W", 0.123454996), ("C", 0.876545004)], "strata string, share double")
    once = {r.strata: r.percent for r in apportion.rounded_parts(shares, {2024: 100.0}).collect()}
    twice = {r.strata: r.percent for r in apportion.rounded_parts(shares, {2024: 100.0}, percent_digits=(3, 2)).collect()}
    assert once["W"] == 12.35 and twice["W"] in (12.34, 12.35) and once["C"] == 87.65


def test_canonical_names(spark):
    from tidemark.sources.schemas import canonical

    df = spark.sql("select 2001 as YEAR, 'WG' as FMP_SUBAREA, 1.5 as WEIGHT_POSTED, 7 as Other")
    assert canonical(df).columns == ["year", "zone", "tons", "other"]


def test_approximate_hauls_are_close(spark):
    df = spark.range(20000).selectExpr("2001 as year", "id % 5000 as haul")
    exact = comps.haul_counts(df, F.col("year"), F.col("haul")).first().hauls
    near = comps.haul_counts(df, F.col("year"), F.col("haul"), approx=True).first().hauls
    assert exact == 5000 and abs(near - exact) < 500
