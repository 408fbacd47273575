"""Random-walk smoothing of survey biomass per stratum.

A stratum is one row that holds its sorted survey series as an array (one entry
per calendar year). The Kalman filter, the smoother and the likelihood search
are folds over that array, so the whole fit stays inside JVM expressions: one
shuffle by stratum, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import let
from ..functions.stats import Z90, Z95

# Bounds of log sigma, and the search: a grid, then finer ones around the best point.
LOW, HIGH = -7.0, 2.0
GRID, ROUNDS = 25, 5
# Step in log sigma of the numeric derivatives.
H = 0.01

_TWO_PI = 6.283185307179586


def _filter_step(s: Column, x: Column, q: Column) -> dict[str, Column]:
    """One year: predict, then update where there is an observation."""
    ap, pp = s["a"], s["p"] + q
    gap, var = x["y"] - ap, pp + x["v"]
    gain = F.coalesce(pp / var, F.lit(0.0))
    cost = F.lit(0.5) * (F.log(F.lit(_TWO_PI) * var) + gap * gap / var)
    return {
        "a": ap + F.coalesce(gain * gap, F.lit(0.0)),
        "p": (1 - gain) * pp,
        "ap": ap,
        "pp": pp,
        "nll": s["nll"] + F.coalesce(cost, F.lit(0.0)),
    }


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _start(series: Column) -> Column:
    """Diffuse start: the first entry is an observation."""
    first = series[0]
    return _struct({"a": first["y"], "p": first["v"], "ap": F.lit(0.0), "pp": F.lit(0.0), "nll": F.lit(0.0)})


def _later(series: Column) -> Column:
    return F.slice(series, F.lit(2), F.size(series))


def negative_log_likelihood(series: Column, log_sigma: Column) -> Column:
    q = F.exp(2 * log_sigma)
    return F.aggregate(_later(series), _start(series), lambda s, x: _struct(_filter_step(s, x, q)), lambda s: s["nll"])


def _filtered(series: Column, log_sigma: Column) -> Column:
    """The filter's states, one per year."""
    q = F.exp(2 * log_sigma)
    return F.aggregate(
        _later(series),
        F.array(_start(series)),
        lambda path, x: F.concat(path, F.array(_struct(_filter_step(F.element_at(path, -1), x, q)))),
    )


def _smoothed(path: Column) -> Column:
    """Smoothed mean m and variance c per year, by a fold from the last year back."""
    last = F.element_at(path, -1)
    end = F.array(F.struct(last["a"].alias("m"), last["p"].alias("c"), last["ap"].alias("ap"), last["pp"].alias("pp")))

    def back(done: Column, s: Column) -> Column:
        nxt = done[0]
        g = s["p"] / nxt["pp"]
        here = F.struct(
            (s["a"] + g * (nxt["m"] - nxt["ap"])).alias("m"),
            (s["p"] + g * g * (nxt["c"] - nxt["pp"])).alias("c"),
            s["ap"].alias("ap"),
            s["pp"].alias("pp"),
        )
        return F.concat(F.array(here), done)

    return F.aggregate(F.reverse(F.slice(path, F.lit(1), F.size(path) - 1)), end, back)


def _search(series: Column) -> Column:
    """log sigma with the least negative log likelihood."""

    def refine(s: Column, _: Column) -> Column:
        step = (s["hi"] - s["lo"]) / (GRID - 1)
        points = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda k: s["lo"] + step * k)
        tried = F.transform(points, lambda x: F.struct(negative_log_likelihood(series, x).alias("nll"), x.alias("s")))
        return let(F.array_min(tried)["s"], lambda best: _bounds(F.greatest(F.lit(LOW), best - step), F.least(F.lit(HIGH), best + step), best))

    def _bounds(lo: Column, hi: Column, best: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), best.alias("best"))

    start = _bounds(F.lit(LOW), F.lit(HIGH), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, refine, lambda s: s["best"])


def _fit(series: Column, surveys: Column, log_sigma: float | None) -> Column:
    """log_sigma, how it was reached, and per log sigma around it the likelihood and the smoothed path."""

    def around(best: Column) -> Column:
        if log_sigma is not None:
            how = F.lit("fixed")
        else:
            how = F.when(surveys < 2, "one survey").when(best <= LOW, "low bound").when(best >= HIGH, "high bound").otherwise("inside")
        three = F.array(best - H, best, best + H)
        return F.struct(
            best.alias("log_sigma"),
            how.alias("fit"),
            F.transform(three, lambda s: negative_log_likelihood(series, s)).alias("nll"),
            F.transform(three, lambda s: _smoothed(_filtered(series, s))).alias("path"),
        )

    best = F.lit(float(log_sigma)) if log_sigma is not None else F.when(surveys < 2, F.lit(LOW)).otherwise(_search(series))
    return let(best, around)


def smooth_random_walk(
    df: DataFrame,
    strata: list[str],
    end_year: int | None = None,
    log_sigma: float | None = None,
    duplicates: str = "fail",
) -> DataFrame:
    """Smoothed biomass for every year of each stratum with 90% and 95% limits.

    df: (strata..., year, biomass, cv), one row per survey year. Years without
    a survey are filled; `end_year` carries the series on. `log_sigma` fixes the
    process error instead of fitting it. Two rows of one stratum and year are an
    error that names them, or with duplicates="mean" their mean counts.

    Only positive biomass with a cv is an observation. Other rows keep their
    year and `obs`; before a stratum's first observation, and in a stratum
    without any, the estimates are null. `fit` says how log_sigma was reached:
    inside its bounds, at the low or high bound (of LOW and HIGH), fixed, from
    one survey (log_sigma is then LOW, not estimated), or no survey.
    """
    if duplicates not in ("fail", "mean"):
        raise ValueError(f"duplicates: fail or mean, not {duplicates}")
    years = df.groupBy(*strata, F.col("year").cast("int").alias("year")).agg(
        F.avg("biomass").alias("obs"), F.avg("cv").alias("obs_cv"), F.count("*").alias("_rows")
    )
    if duplicates == "fail":
        told = F.concat_ws(" ", F.lit("more than one survey row for"), *[F.col(s).cast("string") for s in strata], F.col("year").cast("string"))
        years = years.withColumn("year", F.when(F.col("_rows") > 1, F.raise_error(told).cast("int")).otherwise(F.col("year")))
    counts = (F.col("obs") > 0) & (F.col("obs_cv") >= 0) & ~F.isnan("obs_cv")
    entry = F.struct(
        F.col("obs").alias("obs"),
        F.col("obs_cv").alias("obs_cv"),
        F.when(counts, F.log("obs")).alias("y"),
        F.when(counts, F.log1p(F.col("obs_cv") * F.col("obs_cv"))).alias("v"),
    )
    fits = years.where(F.col("year").isNotNull()).groupBy(*strata).agg(
        F.map_from_entries(F.collect_list(F.struct("year", entry.alias("e")))).alias("_at"),
        F.min("year").alias("_first"),
        F.max("year").alias("_last"),
        F.min(F.when(counts, F.col("year"))).alias("_from"),
        F.count_if(counts).alias("_surveys"),
    )
    fits = fits.withColumn("_last", F.greatest(F.col("_last"), F.lit(end_year).cast("int")))
    fits = fits.withColumn("_years", F.transform(F.sequence("_first", "_last"), lambda y: F.struct(y.alias("year"), F.try_element_at("_at", y).alias("e"))))
    series = F.transform(F.filter("_years", lambda x: x["year"] >= F.col("_from")), lambda x: x["e"])
    fits = fits.select(*strata, "_years", series.alias("_series"), "_from", "_surveys")

    def year_rows(f: Column) -> Column:
        # The reported SD also carries the uncertainty of log sigma (delta method).
        nll, path = f["nll"], f["path"]
        curve = (nll[2] - 2 * nll[1] + nll[0]) / (H * H)
        curve = F.when((curve > 1e-8) & (f["fit"] != "fixed"), curve)
        before = F.size("_years") - F.size(path[1])

        def row(x: Column, i: Column) -> Column:
            low, mid, high = [F.when(i >= before, F.get(path[k], i - before)) for k in range(3)]
            slope = (high["m"] - low["m"]) / (2 * H)
            extra = F.coalesce(slope * slope / curve, F.lit(0.0))
            return F.struct(
                x["year"].alias("year"),
                x["e"]["obs"].alias("obs"),
                x["e"]["obs_cv"].alias("obs_cv"),
                mid["m"].alias("log_est"),
                F.sqrt(mid["c"] + extra).alias("log_sd"),
                F.sqrt(mid["c"]).alias("sd_conditional"),
                f["log_sigma"].alias("log_sigma"),
                nll[1].alias("nll"),
                F.coalesce(f["fit"], F.lit("no survey")).alias("fit"),
            )

        return F.transform("_years", row)

    fitted = let(F.col("_series"), lambda s: F.when(F.col("_surveys") > 0, _fit(s, F.col("_surveys"), log_sigma)))
    # The outer form: the plain one adds a filter on its size, for which the whole fit would be computed once more.
    rows = fits.select(*strata, F.inline_outer(let(fitted, year_rows)))
    limits = {"lci": -Z95, "uci": Z95, "low90": -Z90, "upp90": Z90}
    return rows.select(
        *strata,
        "year",
        "obs",
        "obs_cv",
        F.exp("log_est").alias("estimate"),
        *[F.exp(F.col("log_est") + z * F.col("log_sd")).alias(c) for c, z in limits.items()],
        "log_est",
        "log_sd",
        "sd_conditional",
        "log_sigma",
        "nll",
        "fit",
    )
