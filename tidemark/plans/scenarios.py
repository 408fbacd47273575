"""Harvest-scenario summaries, reference points and stock status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import round_even, with_commas
from ..functions.text import comma_number
from ..operators.aggregates import exact_quantiles
from ..operators.reshape import order_by_items, pivot_wide, union_fill, unpivot_long

# Metrics of the scenario summary file, with the unit factor and decimals of
# the report (fixed values).
MEAN_TABLES = {"SSBMean": (1000.0, 0), "F_Mean": (1.0, 3), "CMean": (1000.0, 0)}
ALTERNATIVES = [1, 2, 3, 4, 5, 6, 7]

# Rows of the reference table in report order: metric, label, unit factor,
# decimals (fixed values).
REFERENCE_ITEMS = [
    ("TotBiom", "Projected total (3+) biomass (t)", 1000.0, 0),
    ("SSBMean", "Projected Female spawning biomass (t)", 1000.0, 0),
    ("SSBF100", "B100%", 1000.0, 0),
    ("SSBFabc", "B40%", 1000.0, 0),
    ("SSBFofl", "B35%", 1000.0, 0),
    ("Fofl", "FOFL", 1.0, 2),
    ("Fabc", "maxFABC", 1.0, 2),
    ("Fabc", "FABC", 1.0, 2),
    ("OFL", "OFL (t)", 1000.0, 0),
    ("ABC", "maxABC (t)", 1000.0, 0),
    ("ABC", "ABC (t)", 1000.0, 0),
]
# Metrics taken from the scenario summary; the others come from the catch run.
SUMMARY_METRICS = ["SSBMean", "SSBFofl", "SSBFabc", "SSBF100", "Fofl", "Fabc"]


def mean_table(
    summary: DataFrame, metric: str, unit: float | None = None, digits: int | None = None, alts=tuple(ALTERNATIVES), by: list[str] = ()
) -> DataFrame:
    """One mean metric as year by scenario.

    summary: (by..., alt, year, metric, value).
    """
    default = MEAN_TABLES.get(metric, (1.0, 3))
    unit = default[0] if unit is None else unit
    digits = default[1] if digits is None else digits
    rows = summary.where(F.col("metric") == metric).withColumn("_v", round_even(F.col("value") * F.lit(unit), digits))
    return pivot_wide(rows, [*by, "year"], "alt", "_v", list(alts), label="scenario_{level}")


def fan(draws: DataFrame, ids: list[str], metrics: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Median and lower/upper quantiles of simulation draws per id and metric.

    draws: (ids..., one column per metric), one row per simulation.
    """
    long = draws if metrics == ["value"] and "metric" in draws.columns else unpivot_long(draws, ids, metrics, "metric", "value")
    return exact_quantiles(long, [*ids, "metric"], "value", {"med": 0.5, "lwr": low, "upr": high})


def mean_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample SD and their sum."""
    out = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("mean_plus_sd", F.col("mean") + F.col("sd"))


def reference_table(
    summary: DataFrame, catch_run: DataFrame, years: tuple[int, int], scenario: int = 1, items=tuple(REFERENCE_ITEMS), by: list[str] = ()
) -> DataFrame:
    """Two-year reference points in report order and units.

    summary: (by..., alt, year, metric, value) of which one scenario is used;
    catch_run: (by..., year, Catch, ABC, OFL, SSB, TotBiom).
    """
    first, second = years
    a = summary.where(
        (F.col("alt") == scenario) & F.col("year").isin(list(years)) & F.col("metric").isin(SUMMARY_METRICS)
    ).select(*by, "year", "metric", "value")
    b = unpivot_long(
        catch_run.where(F.col("year").isin(list(years))).select(*by, "year", "Catch", "ABC", "OFL", "SSB", "TotBiom"),
        [*by, "year"],
        ["Catch", "ABC", "OFL", "SSB", "TotBiom"],
        "metric",
        "value",
    )
    wide = pivot_wide(union_fill(a, b), [*by, "metric"], "year", "value", [first, second], label="y{level}")
    keyed = order_by_items(wide, "metric", list(items), ("label", "unit", "digits"))

    def shown(col: str) -> Column:
        scaled = F.col(col) * F.col("unit")
        rounded = [F.when(F.col("digits") == d, round_even(scaled, d)) for d in sorted({i[3] for i in items})]
        return F.coalesce(*rounded)

    return keyed.select(*by, "ord", "label", "metric", shown(f"y{first}").alias(f"y{first}"), shown(f"y{second}").alias(f"y{second}"))


def report_table(
    previous: DataFrame, current: DataFrame, prev_years: tuple[int, int], years: tuple[int, int], mortality: str = "0.2", tier: str = "3a", by: list[str] = ()
) -> DataFrame:
    """Previous and current reference tables side by side as printed text.

    Both tables are (by..., ord, label, y<year>...), previous values may be
    text with commas. Adds the mortality and tier rows on top and the three
    status rows at the end.
    """
    pa, pb = (f"y{y}" for y in prev_years)
    ca, cb = (f"y{y}" for y in years)
    prev = previous.select(*by, "ord", comma_number(F.col(pa).cast("string")).alias("p1"), comma_number(F.col(pb).cast("string")).alias("p2"))
    both = current.select(*by, "ord", "label", F.col(ca).alias("c1"), F.col(cb).alias("c2")).join(prev, [*by, "ord"], "left")
    whole = F.col("ord").between(1, 5) | (F.col("ord") >= 9)

    def text(c: str) -> Column:
        return F.when(whole, with_commas(c, 0)).otherwise(with_commas(c, 2))

    body = both.select(*by, (F.col("ord") + 2).alias("ord"), "label", *[text(c).alias(c) for c in ("p1", "p2", "c1", "c2")])
    # Each stock gets its fixed rows by a fan-out of its first body row.
    heads = [(1, "M", [mortality] * 4), (2, "Tier", [tier] * 4)]
    tails = [
        (14, "Overfishing", ["no", None, "no", None]),
        (15, "Overfished", [None, "no", None, "no"]),
        (16, "Approaching Overfished", [None, "no", None, "no"]),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(o).alias("ord"),
                F.lit(label).alias("label"),
                *[F.lit(v).cast("string").alias(c) for c, v in zip(("p1", "p2", "c1", "c2"), vals)],
            )
            for o, label, vals in heads + tails
        ]
    )
    fixed = body.where(F.col("ord") == 3).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    out = body.unionByName(fixed)
    return out.select(*by, "ord", "label", F.col("p1").alias(f"previous_{prev_years[0]}"), F.col("p2").alias(f"previous_{prev_years[1]}"), F.col("c1").alias(f"current_{years[0]}"), F.col("c2").alias(f"current_{years[1]}"))


def reference_points(df: DataFrame, b100: str, current: str, by: list[str]) -> DataFrame:
    """B40 and B35 from unfished biomass, and current biomass relative to each."""
    b = F.col(b100)
    return df.select(
        *by,
        b.alias("b100"),
        (F.lit(0.4) * b).alias("b40"),
        (F.lit(0.35) * b).alias("b35"),
        F.try_divide(F.col(current), b).alias("depletion"),
        F.try_divide(F.col(current), F.lit(0.35) * b).alias("b_over_b35"),
    )


def recruit_stats(df: DataFrame, by: list[str], recruits: str) -> DataFrame:
    """Mean, harmonic mean and the inverse-Gaussian CV of a recruitment series."""
    r = F.col(recruits)
    out = df.where(r > 0).groupBy(*by).agg(
        F.avg(r).alias("mean_rec"), F.try_divide(F.count(r).cast("double"), F.sum(F.lit(1.0) / r)).alias("harmonic_rec")
    )
    return out.withColumn("cv_rec", F.sqrt(F.try_divide(F.col("mean_rec"), F.col("harmonic_rec")) - 1))


def catch_abc_ratio(catch: DataFrame, abc: DataFrame, years: tuple[int, int], by: list[str] = ()) -> DataFrame:
    """Mean realised catch / ABC over a span of years. Inputs (by..., year, catch|abc)."""
    j = catch.join(abc, [*by, "year"]).where(F.col("year").between(*years))
    return j.groupBy(*by).agg(F.avg(F.try_divide(F.col("catch"), F.col("abc"))).alias("catch_abc_ratio"))


def phase_series(
    model: DataFrame, projected: DataFrame, reference: DataFrame, unit: float = 1000.0, by: list[str] = ()
) -> DataFrame:
    """SSB/B35 and F/F35 by year; a projected year replaces the model's.

    model and projected: (by..., year, ssb, f), ssb in tons and in thousand tons;
    reference: (by..., b35, f35), b35 in thousand tons.
    """
    a = model.select(*by, "year", "ssb", "f", F.lit(1).alias("_p"), F.lit("model").alias("source"))
    b = projected.select(
        *by, "year", (F.col("ssb") * unit).alias("ssb"), "f", F.lit(2).alias("_p"), F.lit("projection").alias("source")
    )
    best = a.unionByName(b).groupBy(*by, "year").agg(F.max_by(F.struct("ssb", "f", "source"), "_p").alias("r"))
    rows = best.select(*by, "year", "r.*")
    if by:
        rows = rows.join(reference, list(by))
    else:
        rows = rows.withColumns({c: reference.select(c).scalar() for c in ("b35", "f35")})
    return rows.select(
        *by,
        "year",
        "ssb",
        "f",
        F.try_divide(F.col("ssb"), F.col("b35") * unit).alias("b_b35"),
        F.try_divide(F.col("f"), F.col("f35")).alias("f_f35"),
        "source",
    )


def control_rule(df: DataFrame, ratio: str, low: float = 0.05, knee: float = 0.4 / 0.35, plateau: float = 1.0) -> Column:
    """F limit as a share of F35: 0 up to `low`, a ramp to the knee, then the plateau."""
    r = F.col(ratio)
    ramp = F.lit(plateau) * (r - F.lit(low)) / F.lit(knee - low)
    return F.when(r.isNull(), F.lit(None)).otherwise(F.least(F.lit(plateau), F.greatest(F.lit(0.0), ramp)))


def with_control_rules(df: DataFrame, ratio: str) -> DataFrame:
    return df.withColumn("ofl_rule", control_rule(df, ratio)).withColumn(
        "abc_rule", control_rule(df, ratio, plateau=0.8)
    )


def status_flags(
    ssb: DataFrame, b35: DataFrame, this_year: int, by: list[str]
) -> DataFrame:
    """Overfished and approaching-overfished tests.

    ssb: (by..., alt, year, ssb); b35: (by..., b35). Scenario 6 tests this year
    against B35, then half of B35 with B35 ten years on; scenario 7 does the
    same two years later.
    """

    def at(alt: int, year: int, name: str) -> Column:
        return F.max(F.when((F.col("alt") == alt) & (F.col("year") == year), F.col("ssb"))).alias(name)

    wide = ssb.groupBy(*by).agg(
        at(6, this_year, "s6_now"), at(6, this_year + 10, "s6_later"),
        at(7, this_year + 2, "s7_now"), at(7, this_year + 12, "s7_later"),
    ).join(b35, by)

    def fine(now: str, later: str) -> Column:
        return (F.col(now) > F.col("b35")) | ((F.col(now) > F.col("b35") / 2) & (F.col(later) > F.col("b35")))

    return wide.select(
        *by, "b35", "s6_now", "s6_later", "s7_now", "s7_later",
        (~fine("s6_now", "s6_later")).alias("overfished"),
        (~fine("s7_now", "s7_later")).alias("approaching"),
    )
