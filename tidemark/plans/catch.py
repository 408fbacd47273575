"""Catch tables, in-season extrapolation and bycatch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import week_of_year
from ..functions.nulls import member, row_sum
from ..functions.rounding import retained_percent, round_away, round_even
from ..functions.text import comma_number, paste
from ..operators.aggregates import target_share
from ..operators.columns import snake_name
from ..operators.filters import groups_with_a_value
from ..operators.joins import measured, relabel_unlisted
from ..operators.reshape import pivot_wide, unpivot_long
from ..operators.windows import top_with_ties

# Management zones and the area each belongs to (fixed values).
EASTERN_ZONES = ("WY", "EY", "SE")
WESTERN_ZONE = "WG"
CENTRAL_ZONE = "CG"


def catch_by_area(
    df: DataFrame,
    year: Column,
    zone: Column,
    tons: Column,
    eastern=EASTERN_ZONES,
    western: str = WESTERN_ZONE,
    central: str = CENTRAL_ZONE,
    strict_total: bool = True,
    by: tuple[Column, ...] = (),
) -> DataFrame:
    """Year by area: one aggregation with conditional sums.

    The eastern area adds its zones with absent ones as 0. The total is null
    when the western or central zone has no catch, unless strict_total=False.
    """
    areas = df.groupBy(*by, year.alias("year")).agg(
        F.sum(F.when(zone == western, tons)).alias("western"),
        F.sum(F.when(zone == central, tons)).alias("central"),
        F.coalesce(F.sum(F.when(zone.isin(list(eastern)), tons)), F.lit(0.0)).alias("eastern"),
    )
    return areas.withColumn("total", row_sum("western", "central", "eastern", skip_null=not strict_total))


def catch_area_rollup(
    df: DataFrame, year: Column, area: Column, tons: Column, by: tuple[Column, ...] = ()
) -> DataFrame:
    """Area sums with the year total as an extra row (area null)."""
    if by:
        # The year stands in one rollup key with the stock, so only the area is rolled up.
        key = F.struct(*by, year.alias("year")).alias("_k")
    else:
        key = F.struct(year.alias("year")).alias("_k")
    out = df.where(year.isNotNull()).rollup(key, area.alias("area")).agg(F.sum(tons).alias("tons"))
    return out.where(F.col("_k").isNotNull()).select("_k.*", "area", "tons")


def splice_history(current: DataFrame, older: DataFrame, before_year: int, by: list[str] = ()) -> DataFrame:
    """Annual series from `current`, filled from `older` before a year; 2 decimals.

    Both tables are (by..., year, catch). Adds the model columns of a catch series.
    """
    keys = [*by, "year"]
    old = older.where(F.col("year") < before_year).select(*keys, F.col("catch").alias("_old"))
    both = current.select(*keys, "catch").join(old, keys, "full_outer")
    return both.select(
        *keys,
        F.lit(1).alias("seas"),
        F.lit(1).alias("fleet"),
        round_even(F.coalesce("catch", "_old"), 2).alias("catch_mt"),
        F.lit(0.01).alias("catch_se"),
    )


def inseason_estimate(
    weekly: DataFrame,
    to_date: DataFrame,
    as_of: dt.date,
    by: list[str] = (),
    years_back: int | None = 5,
) -> DataFrame:
    """Full-year catch from the year to date plus the usual rest of the year.

    weekly: (by..., year, week, catch); to_date: (by..., catch) for this year.
    The rest is the mean over years of catch in weeks after the week of
    `as_of`; years without such weeks do not enter. years_back=None uses all
    years of the file.
    """
    by = list(by)
    this_week = (as_of.timetuple().tm_yday - 1) // 7 + 1
    later = weekly.where(F.col("week") > this_week)
    if years_back is not None:
        later = later.where(F.col("year") >= as_of.year - years_back)
    per_year = later.groupBy(*by, "year").agg(F.sum("catch").alias("_c"))
    if by:
        rest = per_year.groupBy(*by).agg(F.avg("_c").alias("catch_to_add"))
        out = to_date.join(rest, by, "left")
    else:
        rest = per_year.agg(F.avg("_c").alias("catch_to_add"))
        out = to_date.withColumn("catch_to_add", rest.scalar())
    out = out.withColumn("estimate", F.col("catch") + F.col("catch_to_add"))
    return out.select(
        *by,
        F.col("catch").alias("catch_to_date"),
        "catch_to_add",
        round_even("estimate", 0).alias("predicted_catch"),
        round_even(F.try_divide(F.col("estimate"), F.col("catch")), 2).alias("expansion_factor"),
    )


def projection_vector(
    annual: DataFrame,
    estimate: DataFrame | None,
    this_year: int,
    by: list[str] = (),
    mean_years: int = 5,
    include_this_year: bool = False,
) -> DataFrame:
    """Two observed years, this year (estimated when given), two future years.

    annual: (by..., year, catch); estimate: (by..., predicted_catch). Future
    years take the mean of the last `mean_years` complete years.
    """
    by = list(by)
    last = this_year if include_this_year else this_year - 1
    window = F.col("year").between(this_year - mean_years, last)
    wide = annual.groupBy(*by).agg(
        F.avg(F.when(window, F.col("catch"))).alias("_mean"),
        *[F.max(F.when(F.col("year") == this_year + k, F.col("catch"))).alias(f"_y{k + 2}") for k in (-2, -1, 0)],
    )
    now = F.col("_y2")
    if estimate is not None:
        wide = wide.join(estimate, by, "left") if by else wide.withColumn(
            "predicted_catch", estimate.select("predicted_catch").scalar()
        )
        now = F.coalesce(F.col("predicted_catch"), now)
    points = [F.col("_y0"), F.col("_y1"), now, F.col("_mean"), F.col("_mean")]
    sources = ["observed", "observed", "estimated", "mean", "mean"]
    rows = F.array(
        *[
            F.struct(F.lit(this_year - 2 + i).alias("year"), p.alias("catch"), F.lit(s).alias("source"))
            for i, (p, s) in enumerate(zip(points, sources))
        ]
    )
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def gear_zone_type(
    df: DataFrame, year: Column, zone: Column, gear: Column, disposal: Column, tons: Column, drop_gears, discard: str = "D",
    by: dict[str, Column] | None = None,
) -> DataFrame:
    """Tons by year, zone, type and gear without the minor gears, with a label."""
    by = by or {}
    rows = df.select(
        *[c.alias(n) for n, c in by.items()], year.alias("year"), zone.alias("zone"), gear.alias("gear"), disposal.alias("type"), tons.alias("_t")
    ).where(~member("gear", drop_gears))
    out = rows.groupBy(*by, "year", "zone", "type", "gear").agg(F.sum("_t").alias("tons"))
    kind = F.when(F.col("type") == discard, F.lit(" Discarded")).otherwise(F.lit(" Retained"))
    return out.withColumn("label", paste(F.col("gear"), kind))


def retention_table(discards: DataFrame, limits_long: DataFrame, kinds=("OFL", "ABC", "TAC", "Catch"), by: list[str] = ()) -> DataFrame:
    """Harvest limits beside the percent of catch retained.

    discards: (by..., year, discarded); limits_long: (by..., year, kind, value).
    """
    keys = [*by, "year"]
    wide = pivot_wide(limits_long, keys, "kind", "value", list(kinds))
    return discards.join(wide, keys).select(
        *keys,
        *[k for k in kinds if k != "Catch"],
        round_even("Catch", 0).alias("total_catch"),
        retained_percent("discarded", "Catch").alias("percent_retained"),
    )


def limits_with_catch(limits_text: DataFrame, catch: DataFrame, extra: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Limits printed with commas, joined to catches, in long form without OFL.

    limits_text: (by..., year, kind, text); catch: (by..., year, catch); extra:
    (by..., year, catch) used in projections.
    """
    keys = [*by, "year"]
    wide = pivot_wide(limits_text.withColumn("v", comma_number("text")), keys, "kind", "v", ["TAC", "ABC", "OFL"])
    out = wide.join(catch.withColumnRenamed("catch", "catch_model"), keys, "left")
    cols = ["TAC", "ABC", "OFL", "catch_model"]
    if extra is not None:
        out = out.join(extra.withColumnRenamed("catch", "catch_projection"), keys, "full_outer")
        cols.append("catch_projection")
    return unpivot_long(out, keys, cols).where(F.col("variable") != "OFL")


def weekly_by_zone(
    weekly: DataFrame, year: int | None, strip: str, zones: dict[str, str], central: str, western: str,
    by: list[str] = (),
) -> DataFrame:
    """Weekly reports summed by zone, the zone read off the species label.

    zones maps the label left after removing `strip` and blanks to an output
    column; several labels may share one. Eastern is every mapped zone that is neither central nor western.
    """
    zone = F.regexp_replace(F.regexp_replace("species", strip, ""), " ", "")
    rows = weekly.withColumn("_zone", zone)
    if year is not None:
        rows = rows.where(F.col("year") == year)
    names = list(dict.fromkeys(zones.values()))
    labels = {n: [k for k, v in zones.items() if v == n] for n in names}
    sums = rows.groupBy(*by, "year").agg(
        *[F.sum(F.when(F.col("_zone").isin(labels[n]), F.col("catch"))).alias(n) for n in names]
    )
    east = [n for n in names if n not in (central, western)]
    return sums.select(
        *by,
        "year",
        row_sum(*names).alias("total_catch"),
        F.col(western).alias("WG"),
        F.col(central).alias("CG"),
        row_sum(*east).alias("EG"),
    )


def noncommercial_top(
    df: DataFrame, collapse_agency: str, other: str, keep: int, area: str | None, levels: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Removals in tons by year and source, minor sources of one agency lumped.

    df: (year, agency, source, area, kg). The agency keeps its `keep` sources
    of highest mean weight (ties kept); the ranking uses all areas, the table
    only `area`. With `levels` the result is wide, else long.
    """
    # Facts are read once, into sums by (year, agency, source); ranks and labels use the sums.
    here = F.lit(True) if area is None else F.col("area") == area
    pre = measured(df.groupBy("year", "agency", "source").agg(
        F.sum("kg").alias("_all"),
        F.count("kg").alias("_n"),
        F.sum(F.when(here, F.col("kg"))).alias("kg"),
        F.count_if(here).alias("_here"),
    ))
    own = pre.where(F.col("agency") == collapse_agency)
    means = own.groupBy("agency", "source").agg(F.try_divide(F.sum("_all"), F.sum("_n")).alias("_m"))
    top = top_with_ties(means, ["agency"], "_m", keep)
    lumped = relabel_unlisted(own, top, ["agency", "source"], "source", other)
    rows = lumped.unionByName(pre.where(~F.col("agency").eqNullSafe(F.lit(collapse_agency)))).where("_here > 0")
    # The sum is rounded to a millionth first: the order of adding must not decide a tie.
    total = F.round(F.sum("kg"), 6)
    long = rows.groupBy("year", "agency", "source").agg(round_even(total / 1000.0, 3).alias("tons"))
    if levels is None:
        return long
    key = F.concat_ws("_", "agency", "source")
    wide = pivot_wide(long, ["year"], key, "tons", [f"{a}_{s}" for a, s in levels])
    names = [snake_name(c) for c in wide.columns]
    wide = wide.toDF(*names)
    return wide.select("year", *sorted(n for n in names if n != "year"))


def prohibited_table(
    df: DataFrame, after_year: int, years: list[int], group: str, mortality: str, numbers: str, by: list[str] = ()
) -> DataFrame:
    """Mortality (t) and numbers by group, one column pair per year."""
    sums = (
        df.where(F.col("year") > after_year)
        .groupBy(*by, "year", group)
        .agg(
            round_even(F.coalesce(F.sum(mortality), F.lit(0.0)), 3).alias("mortality"),
            round_even(F.coalesce(F.sum(numbers), F.lit(0.0)), 3).alias("numbers"),
        )
    )
    return pivot_wide(
        sums, [*by, group], "year", {"mortality_t": "mortality", "numbers": "numbers"}, years, label="{value}_{level}"
    )


def nontarget_share(df: DataFrame, is_target: Column, value: str, by: list[str] = ()) -> DataFrame:
    """Share of the target fishery in all bycatch, for groups it ever caught.

    df: (by..., year, species, value...).
    """
    shares = target_share(df, [*by, "year", "species"], is_target, value, "target_wt", "all_wt", "prop")
    return groups_with_a_value(shares, [*by, "species"], "target_wt", raw=False)


def nontarget_share_sql(spark, view: str, target_code: str, low: int, high: int, complete_keys: bool = True) -> DataFrame:
    """The same share as SQL with two common table expressions and a full join.

    complete_keys=False keeps the key of the overall side only, as a plain
    reading of the two-table form would.
    """
    year = "coalesce(g.year, f.year)" if complete_keys else "g.year"
    species = "coalesce(g.species, f.species)" if complete_keys else "g.species"
    return spark.sql(
        f"""
        with f as (select year, species, round(sum(weight), 2) as target_wt from {view}
                   where code = :code and year between :low and :high group by year, species),
             g as (select year, species, round(sum(weight), 2) as all_wt from {view}
                   where year between :low and :high group by year, species)
        select {year} as year, {species} as species, f.target_wt, g.all_wt,
               round(try_divide(f.target_wt, g.all_wt), 2) as prop
        from f full join g on f.species = g.species and f.year = g.year
        """,
        args={"code": target_code, "low": low, "high": high},
    )


def catch_over_biomass(
    model: DataFrame, draws: DataFrame, catch_projection: DataFrame, years: tuple[int, int], unit: float = 1000.0,
    by: list[str] = (),
) -> DataFrame:
    """Catch / summary biomass: model years, then projection means.

    model: (by..., year, biomass, catch); draws: (by..., year, total_biomass);
    catch_projection: (by..., year, catch). The mean is rounded to 2 decimals before
    `unit` scales it.
    """
    keys = [*by, "year"]
    means = (
        draws.where(F.col("year").between(*years))
        .groupBy(*keys)
        .agg((F.lit(unit) * round_even(F.avg("total_biomass"), 2)).alias("biomass"))
    )
    projected = means.join(catch_projection, keys).select(*keys, "biomass", "catch", F.lit("projection").alias("source"))
    both = model.select(*keys, "biomass", "catch", F.lit("model").alias("source")).unionByName(projected)
    return both.withColumn("catch_over_biomass", F.try_divide(F.col("catch"), F.col("biomass")))


def weekly_from_dates(df: DataFrame, date: Column, catch: Column, by: dict[str, Column]) -> DataFrame:
    """Sum records to (by..., year, week, catch)."""
    return df.groupBy(
        *[c.alias(n) for n, c in by.items()], F.year(date).alias("year"), week_of_year(date).alias("week")
    ).agg(F.sum(catch).alias("catch"))


def rounded_sql_sum(col: str, digits: int) -> Column:
    """Database-style rounded sum."""
    return round_away(F.sum(col), digits)
