"""Survey biomass indices with their uncertainty, and haul counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.nulls import recode
from ..functions.stats import cv, limits
from ..operators.aggregates import distinct_bitmaps, distinct_in_spans
from ..operators.reshape import pivot_wide

# Survey area spellings to one form (fixed values).
AREA_NAMES = {
    "CENTRAL GOA": "Central GOA",
    "WESTERN GOA": "Western GOA",
    "EASTERN GOA": "Eastern GOA",
}


def index_with_limits(df: DataFrame, k: float = 1.0, month: int = 1, fleet: int = 2, by: list[str] = ()) -> DataFrame:
    """(year, biomass, variance) -> observation, CV, limits and model columns."""
    lower, upper = limits("biomass", "_cv", k)
    return df.withColumn("_cv", cv("variance", "biomass")).select(
        *by,
        "year",
        F.lit(month).alias("month"),
        F.lit(fleet).alias("fleet"),
        F.col("biomass").alias("obs"),
        F.col("_cv").alias("cv"),
        lower.alias("lci"),
        upper.alias("uci"),
    )


def index_by_area_wide(df: DataFrame, areas: list[str], by: list[str] = ()) -> DataFrame:
    """(year, area, biomass, variance) -> biomass and CV per area plus the total.

    The total adds biomass and variance over the listed areas, absent ones as 0.
    """
    listed = F.col("area").isin(areas)
    cells = df.withColumn("cv", cv("variance", "biomass"))
    per_area = []
    for a in areas:
        here = F.col("area") == a
        per_area += [
            F.max(F.when(here, F.col("biomass"))).alias(f"biomass_{a}"),
            F.max(F.when(here, F.col("cv"))).alias(f"cv_{a}"),
        ]
    out = cells.groupBy(*by, "year").agg(
        F.coalesce(F.sum(F.when(listed, F.col("biomass"))), F.lit(0.0)).alias("total_biomass"),
        F.coalesce(F.sum(F.when(listed, F.col("variance"))), F.lit(0.0)).alias("_var"),
        *per_area,
    )
    return out.select(
        *by,
        "year",
        "total_biomass",
        cv("_var", "total_biomass").alias("total_cv"),
        *[c for a in areas for c in (f"biomass_{a}", f"cv_{a}")],
    )


def index_by_area_long(
    current: DataFrame,
    older: DataFrame | None = None,
    older_before: int = 1990,
    names: dict[str, str] = AREA_NAMES,
    drop_year: int | None = None,
    by: list[str] = (),
) -> DataFrame:
    """(strata, year, biomass, cv), early years taken from an older run, names unified.

    current: (area, year, biomass, variance); older: (strata, year, biomass, cv).
    """
    out = current.select(*by, F.col("area").alias("strata"), "year", "biomass", cv("variance", "biomass").alias("cv"))
    if older is not None:
        out = out.unionByName(
            older.where(F.col("year") < older_before).select(*by, "strata", "year", "biomass", "cv")
        )
    out = out.withColumn("strata", recode("strata", names, keep_unmapped=True)).where(F.col("biomass").isNotNull())
    return out.where(F.col("year") != drop_year) if drop_year is not None else out


def index_by_depth(df: DataFrame, bands: list[str], by: list[str] = ()) -> DataFrame:
    """(year, area, band, biomass) -> one row per area and year, one column per band."""
    return pivot_wide(df, [*by, "area", "year"], "band", "biomass", bands)


def stack_sources(design: DataFrame, model: DataFrame, k_design: float = 1.0, k_model: float = 1.0, by: list[str] = ()
) -> DataFrame:
    """Design-based and model-based indices in one table with limits.

    design: (year, value, cv); model: (year, value, se) with se as a share of
    the value. Only positive values are kept.
    """

    def one(df: DataFrame, rel: str, k: float, label: str) -> DataFrame:
        lo, hi = limits("value", rel, k)
        return df.select(*by, "year", "value", lo.alias("lci"), hi.alias("uci"), F.lit(label).alias("src"))

    both = one(model, "se", k_model, "model-based").unionByName(one(design, "cv", k_design, "design-based"))
    return both.where(F.col("value") > 0)


def hauls_per_year(sources: dict[str, DataFrame], drop_areas: list[int] = (), by: list[str] = ()) -> DataFrame:
    """Distinct hauls per year and source, joined by year.

    Each source is (year, haul, area). Hauls without an id are not counted.
    """
    out = None
    for name, df in sources.items():
        rows = df.where(~F.coalesce(F.col("area").isin(list(drop_areas)), F.lit(False))) if drop_areas else df
        n = rows.groupBy(*by, "year").agg(F.count_distinct("haul").alias(f"hauls_{name}"))
        out = n if out is None else out.join(n, [*by, "year"], "full_outer")
    return out


def hauls_by_span(df: DataFrame, drop_areas: list[int] = (), by: list[str] = ()) -> DataFrame:
    """Distinct hauls in every span of years, from one scan: (by..., first, last, hauls).

    df: (by..., year, haul, area); haul is an integer.
    """
    rows = df.where(~F.coalesce(F.col("area").isin(list(drop_areas)), F.lit(False))) if drop_areas else df
    return distinct_in_spans(distinct_bitmaps(rows, [*by, "year"], "haul"), list(by), "year", "hauls")


def haul_key(*parts: Column) -> Column:
    """A haul key kept as exact text, never as a floating number."""
    return F.concat_ws("", *[p.cast("string") for p in parts])
