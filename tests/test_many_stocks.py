"""Several stocks in one call give the same rows as one call per stock."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catch, comps, models, scenarios, survey

c = F.col


def both(spark, df, run, by=("stock",)):
    """run(df, by) must not mix stocks."""
    together = run(df, list(by))
    apart = None
    for s in [r.stock for r in df.select("stock").distinct().collect()]:
        one = run(df.where(c("stock") == s), []).withColumn("stock", F.lit(s)).select(*together.columns)
        apart = one if apart is None else apart.unionByName(one)
    key = lambda rows: sorted(map(str, (tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)))
    a, b = key(together.collect()), key(apart.collect())
    assert a == b and a


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [
        (
            rng.choice(["x", "y"]), rng.choice([1988, 1999, 2000, 2001]), rng.choice(["WG", "CG", "WY", "SE"]), rng.choice("DR"),
            rng.choice(["A", "B"]), rng.choice("FM"), rng.randint(1, 3), rng.uniform(50, 700), rng.randint(1, 35), float(rng.randint(1, 9)),
        )
        for _ in range(500)
    ]
    schema = "stock string, year int, zone string, type string, gear string, s string, sex int, length double, age int, n double"
    return spark.createDataFrame(data, schema).cache()


def named(by):
    return {b: c(b) for b in by}


def test_catch(spark, rows):
    both(spark, rows, lambda d, by: catch.catch_by_area(d, c("year"), c("zone"), c("n"), by=tuple(c(b) for b in by)))
    both(spark, rows, lambda d, by: catch.catch_area_rollup(d, c("year"), c("zone"), c("n"), by=tuple(c(b) for b in by)))
    both(spark, rows, lambda d, by: catch.gear_zone_type(d, c("year"), c("zone"), c("gear"), c("type"), c("n"), ["B"], by=named(by)))

    def splice(d, by):
        s = d.groupBy(*by, "year").agg(F.sum("n").alias("catch"))
        return catch.splice_history(s.where("year > 1999"), s, 2001, by=by)

    both(spark, rows, splice)

    def vector(d, by):
        return catch.projection_vector(d.groupBy(*by, "year").agg(F.sum("n").alias("catch")), None, 2001, by=by)

    both(spark, rows, vector)

    def season(d, by):
        w = d.groupBy(*by, "year", (c("age") + 10).alias("week")).agg(F.sum("n").alias("catch"))
        to_date = d.where("year = 2001").groupBy(*by).agg(F.sum("n").alias("catch"))
        return catch.inseason_estimate(w, to_date, dt.date(2001, 6, 1), by=by)

    both(spark, rows, season)

    def share(d, by):
        d = d.withColumnRenamed("zone", "species")
        return catch.nontarget_share(d, c("gear") == "A", "n", by=by)

    both(spark, rows, share)


def test_compositions(spark, rows):
    both(spark, rows, lambda d, by: comps.length_frequencies(d, c("year"), c("s"), c("length") / 10, c("n"), by=named(by)))
    both(spark, rows, lambda d, by: comps.caal_rows(
        comps.caal_long(d, c("year"), c("sex"), c("length"), c("age"), c("n"), by=named(by)), by=by))

    def marginal(d, by):
        f = comps.age_marginal(d, c("year"), c("sex"), c("age"), c("n"), by=named(by))
        return comps.age_marginal_rows(f, comps.haul_counts(d, c("year"), c("length"), by=named(by)), by=by)

    both(spark, rows, marginal)

    def wide(d, by):
        d = d.withColumns({"M": F.when(c("s") == "M", c("n")), "W": F.when(c("s") == "F", c("n"))})
        return comps.length_frequencies_wide_source(d, "year", "length", "M", "W", by=by)

    both(spark, rows, wide)

    def front(d, by):
        f = comps.length_frequencies(d, c("year"), c("s"), c("length") / 10, c("n"), by=named(by))
        return comps.with_front_matter(f, comps.haul_counts(d, c("year"), c("length"), by=named(by)), list(range(6, 71, 2)), 1, by=by)

    both(spark, rows, front)


def test_survey_scenarios_and_models(spark, rows):
    def cells(d, by):
        return d.groupBy(*by, "year", c("zone").alias("area")).agg(F.sum("n").alias("biomass"), F.var_samp("n").alias("variance"))

    both(spark, rows, lambda d, by: survey.index_by_area_wide(cells(d, by), ["WG", "CG", "SE"], by=by))
    both(spark, rows, lambda d, by: survey.index_by_area_long(cells(d, by), by=by))
    both(spark, rows, lambda d, by: scenarios.fan(d.select(*by, "year", c("age").cast("double").alias("v"), "n"), [*by, "year"], ["v", "n"]))

    def surface(d, by):
        like = d.groupBy(*by, c("sex").alias("x"), c("zone").alias("y")).agg(F.sum("n").alias("value")).withColumn("label", F.lit("TOTAL"))
        return models.profile_surface(like, "x", "y", 5.0, by=by)

    both(spark, rows, surface)

    def wide(d, by):
        m = d.groupBy(*by, c("zone").alias("label"), c("gear").alias("model")).agg(F.sum("n").alias("value"))
        return models.compare_wide(m, "label", "value", ["A", "B"], 0.01, by=by)

    both(spark, rows, wide)
