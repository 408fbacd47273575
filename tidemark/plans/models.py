"""Comparing model runs: wide tables, parameters, time series, retrospectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import round_by_size, round_even, value_sd_text
from ..operators.filters import beyond
from ..operators.joins import null_safe_join, with_scalar
from ..operators.reshape import pivot_wide, unpivot_long
from ..operators.windows import rescale_min


def compare_wide(
    df: DataFrame, item: str, value: str, models: list[str], threshold: float | None = None, by: list[str] = ()
) -> DataFrame:
    """Items by model run: likelihood parts, index values, parameters."""
    rows = beyond(df, value, threshold) if threshold is not None else df
    return pivot_wide(rows, [*by, item], "model", value, models)


def parameter_counts(df: DataFrame, patterns: dict[str, str], by: list[str] = ("model",)) -> DataFrame:
    """Estimated parameters (phase above 0) per model, in all and per label pattern."""
    on = F.col("phase") > 0
    return df.groupBy(*by).agg(
        F.count_if(on).alias("estimated"),
        *[F.count_if(on & F.col("label").rlike(p)).alias(n) for n, p in patterns.items()],
    )


def parameter_table(df: DataFrame, labels: dict[str, str], models: list[str], digits: int = 3, by: list[str] = ()) -> DataFrame:
    """Chosen parameters by model with printed names, in the order given."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(labels) for x in (k, i + 1)])
    rows = (
        df.where(F.col("label").isin(list(labels)))
        .withColumn("_name", F.try_element_at(pairs, F.col("label")))
        .withColumn("ord", F.try_element_at(order, F.col("label")))
        .withColumn("_v", round_even("value", digits))
    )
    return pivot_wide(rows, [*by, "ord", "_name"], "model", "_v", models).withColumnRenamed("_name", "parameter")


def labelled_series(df: DataFrame, quantities: dict[str, str], by: list[str] = ()) -> DataFrame:
    """Quantities labelled PREFIX_YEAR -> (model, quantity, year, value, sd).

    quantities = {printed name: pattern of the whole prefix}. Labels whose tail
    is no year are left out.
    """
    prefix = F.regexp_extract("label", r"^(.*)_[^_]*$", 1)
    name = F.lit(None).cast("string")
    for printed, pattern in reversed(quantities.items()):
        name = F.when(prefix.rlike(f"^(?:{pattern})$"), F.lit(printed)).otherwise(name)
    rows = df.withColumn("quantity", name).withColumn("year", F.regexp_extract("label", r"_([^_]*)$", 1).try_cast("int"))
    return rows.where(F.col("quantity").isNotNull() & F.col("year").isNotNull()).select(
        *by, "model", "quantity", "year", "value", "sd"
    )


def timeseries_table(series: DataFrame, models: list[str], quantities: list[str], after: int | None = None, by: list[str] = ()
) -> DataFrame:
    """Year by quantity and model, each cell "value (sd)" with size-dependent decimals."""

    def shown(c: str) -> Column:
        v = round_by_size(c, 4, 0)
        return F.when(F.col(c) >= 1, F.format_number(v, 0)).otherwise(F.format_number(v, 4))

    rows = series.where(F.col("year") > after) if after is not None else series
    rows = rows.withColumn("_cell", value_sd_text(shown("value"), shown("sd"))).withColumn(
        "_key", F.concat_ws(" | ", "model", "quantity")
    )
    levels = [f"{m} | {q}" for q in quantities for m in models]
    return pivot_wide(rows, [*by, "year"], "_key", "_cell", levels)


def biomass_ratio(df: DataFrame, virgin: str = "SSB_Virgin", share: float = 0.35, before: int | None = None, by: list[str] = ()
) -> DataFrame:
    """SSB and its one-SD limits with SSB / (share of unfished SSB), per model.

    df: (model, label, value, sd). Only the SSB series gets a ratio.
    """
    base = df.where(F.col("label") == virgin).groupBy(*by, "model").agg((F.lit(share) * F.max("value")).alias("b35"))
    kind = F.split_part(F.col("label"), F.lit("_"), F.lit(1))
    year = F.split_part(F.col("label"), F.lit("_"), F.lit(2)).try_cast("int")
    rows = df.where(F.col("label").rlike("^(SSB|Bratio)_")).withColumn("quantity", kind).withColumn("year", year)
    rows = rows.where(F.col("year").isNotNull())
    if before is not None:
        rows = rows.where(F.col("year") < before)
    return rows.join(base, [*by, "model"]).select(
        *by,
        "model",
        "quantity",
        "year",
        "value",
        (F.col("value") - F.col("sd")).alias("lci"),
        (F.col("value") + F.col("sd")).alias("uci"),
        F.when(F.col("quantity") == "SSB", F.try_divide(F.col("value"), F.col("b35"))).alias("b_over_b35"),
    )


def index_fit(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(model, year, obs, exp, se) -> long with limits value -/+ value * se."""
    long = unpivot_long(
        df.select(*by, "model", "year", "se", "obs", "exp"), [*by, "model", "year", "se"], ["obs", "exp"]
    )
    return long.withColumn("lwr", F.col("value") - F.col("value") * F.col("se")).withColumn(
        "upr", F.col("value") + F.col("value") * F.col("se")
    )


def selectivity_long(df: DataFrame, ages: list[str], factor: str, year: int | None = None, by: list[str] = ()
) -> DataFrame:
    """Selectivity by age as rows, one factor, one year (the latest per model by default).

    df: (model, factor, year, fleet, sex, one column per age).
    """
    rows = df.where(F.col("factor") == factor)
    if year is None:
        last = rows.groupBy(*by, "model").agg(F.max("year").alias("_last"))
        rows = rows.join(last, [*by, "model"]).where(F.col("year") == F.col("_last"))
    else:
        rows = rows.where(F.col("year") == year)
    long = unpivot_long(
        rows.select(*by, "model", "fleet", "sex", *ages), [*by, "model", "fleet", "sex"], ages, "age", "value"
    )
    return long.select(
        *by,
        "model",
        F.when(F.col("fleet") == 1, "Fishery").otherwise("Survey").alias("fleet"),
        F.when(F.col("sex") == 1, "Females").otherwise("Males").alias("sex"),
        F.col("age").try_cast("int").alias("age"),
        "value",
    )


def profile_best(df: DataFrame, runs: list[str], grid: dict[str, float] | None = None, by: list[str] = ()
) -> DataFrame:
    """Best run per likelihood component from a table with one column per run.

    grid gives the profiled value of each run.
    """
    long = unpivot_long(df, [*by, "label"], runs, "run", "value").where(F.col("value").isNotNull())
    if grid:
        values = F.create_map(*[F.lit(x) for k, v in grid.items() for x in (k, float(v))])
        long = long.withColumn("at", F.try_element_at(values, F.col("run")))
    else:
        long = long.withColumn("at", F.lit(None).cast("double"))
    best = F.min_by(F.struct("run", "at"), F.struct("value", "run"))
    return long.groupBy(*by, "label").agg(best.alias("_b"), F.min("value").alias("value")).select(
        *by, "label", F.col("_b.run").alias("run"), F.col("_b.at").alias("at"), "value"
    )


def profile_surface(likelihoods: DataFrame, x: str, y: str, cut: float, by: list[str] = ()) -> DataFrame:
    """Total likelihood over a 2-D grid, rescaled to its minimum.

    likelihoods: (by..., label, x, y, value). `best` marks the minimum (ties kept),
    `inside` the points within `cut` of it.
    """
    total = likelihoods.where(F.col("label") == "TOTAL")
    out = rescale_min(total, list(by), "value", "delta")
    return out.select(*by, x, y, "delta", (F.col("delta") == 0).alias("best"), (F.col("delta") <= cut).alias("inside"))


def profile_matrix(surface: DataFrame, x: str, y: str, levels: list, by: list[str] = ()) -> DataFrame:
    """The rescaled likelihoods as a matrix: one row per x, one column per stated level of y."""
    return pivot_wide(surface, [*by, x], y, "delta", levels, label=f"{y}_{{level}}")


def profile_contour(surface: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """Edge of the inside set: inside cells with fewer than eight inside neighbours.

    Returns (by..., x, y, near, at_border): inside neighbours, and whether the cell lies on
    the border of the grid, where the set may go on. Neighbours are next to each other among
    the values met on each axis (a grid has as many as runs were made). A cell given twice is
    inside if one of its rows is; a cell without a place is left out.
    """
    by = list(by)
    cells = surface.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(
        F.coalesce(F.bool_or("inside"), F.lit(False)).alias("_in")
    )
    axes = cells.groupBy(*by).agg(F.array_sort(F.collect_set(x)).alias("_xs"), F.array_sort(F.collect_set(y)).alias("_ys"))
    cells = null_safe_join(cells, axes, by) if by else with_scalar(cells, axes, "_xs", "_ys")
    i, j = F.array_position("_xs", F.col(x)), F.array_position("_ys", F.col(y))
    border = (i == 1) | (j == 1) | (i == F.size("_xs")) | (j == F.size("_ys"))
    placed = cells.select(*by, x, y, "_in", i.alias("_i"), j.alias("_j"), border.alias("at_border"))
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    reached = F.array(*[F.struct((F.col("_i") + a).alias("_i"), (F.col("_j") + b).alias("_j")) for a, b in steps])
    near = placed.where("_in").select(*by, F.inline(reached)).groupBy(*by, "_i", "_j").agg(F.count(F.lit(1)).alias("near"))
    edge = null_safe_join(placed.where("_in"), near, [*by, "_i", "_j"], "left")
    return edge.select(*by, x, y, F.coalesce("near", F.lit(0).cast("long")).alias("near"), "at_border").where(F.col("near") < len(steps))


def mohns_rho(df: DataFrame, by: list[str] = ("quantity",)) -> DataFrame:
    """Mean over peels of (peel at its terminal year / full run) - 1.

    df: (by..., peel, end_year, year, value); peel 0 is the full run.
    """
    ends = df.where((F.col("peel") != 0) & (F.col("year") == F.col("end_year")))
    full = df.where(F.col("peel") == 0).select(*by, "year", F.col("value").alias("_full"))
    j = ends.join(full, [*by, "year"])
    return j.groupBy(*by).agg(
        F.avg(F.try_divide(F.col("value"), F.col("_full")) - 1).alias("rho"), F.count(F.lit(1)).alias("peels")
    )
