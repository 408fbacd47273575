"""Splitting a harvest limit over areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rounding import round_even
from ..operators.joins import with_scalar
from ..operators.windows import share_of_total


def area_shares(smoothed: DataFrame, year: int | None = None, by: list[str] = ()) -> DataFrame:
    """(by..., strata, year, estimate) -> share of each stratum in its year."""
    rows = smoothed.where(F.col("year") == year) if year is not None else smoothed
    return share_of_total(rows, [*by, "year"], "estimate", "share").select(*by, "year", "strata", "share")


def split_area(
    shares: DataFrame, area: str, fractions: DataFrame, into: dict[str, str]
) -> DataFrame:
    """Replace one area by parts: its share times fractions of a one-row table.

    into = {new area: fraction column}.
    """
    df = with_scalar(shares, fractions, *into.values())
    parts = F.array(
        *[F.struct(F.lit(n).alias("strata"), (F.col("share") * F.col(c)).alias("share")) for n, c in into.items()]
    )
    own = F.array(F.struct(F.col("strata"), F.col("share")))
    keep = [c for c in shares.columns if c not in ("strata", "share")]
    chosen = F.when(F.col("strata") == area, parts).otherwise(own)
    return df.select(*keep, F.explode(chosen).alias("p")).select(*keep, "p.strata", "p.share")


def rounded_parts(
    shares: DataFrame, limits: DataFrame | dict[int, float], by: list[str] = (), adjust_area: str | None = None,
    percent_digits: tuple[int, ...] = (2,),
) -> DataFrame:
    """Area limits as whole tons that add up to the total, itself rounded to whole tons.

    shares: (by..., strata, share); limits: (by..., year_limit, abc), or
    {year: abc} when one set of limits holds for all rows. Parts are rounded
    half to even; the difference goes to `adjust_area`, or to the area with the
    largest share when none is named. The printed percent is rounded to each of
    percent_digits in turn, so (3, 2) rounds twice.
    """
    keys = [*by, "year_limit"]
    if isinstance(limits, dict):
        pairs = F.array(
            *[F.struct(F.lit(y).alias("year_limit"), F.lit(float(v)).alias("abc")) for y, v in limits.items()]
        )
        rows = shares.withColumn("_l", F.explode(pairs)).select(*shares.columns, "_l.year_limit", "_l.abc")
    elif by:
        rows = shares.join(limits, list(by))
    else:
        raise ValueError("a table of limits needs key columns to join on; give {year: abc} otherwise")
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_part", round_even(F.col("share") * F.col("abc"), 0))
    rows = rows.withColumn("_diff", round_even(F.col("abc"), 0) - F.sum("_part").over(w))
    if adjust_area is not None:
        chosen: Column = F.col("strata") == adjust_area
    else:
        rank = F.row_number().over(w.orderBy(F.col("share").desc_nulls_last(), F.col("strata")))
        rows = rows.withColumn("_rank", rank)
        chosen = F.col("_rank") == 1
    percent = F.col("share") * 100
    for digits in percent_digits:
        percent = round_even(percent, digits)
    return rows.select(
        *keys,
        "strata",
        "abc",
        percent.alias("percent"),
        (F.col("_part") + F.when(chosen, F.col("_diff")).otherwise(F.lit(0.0))).alias("area_abc"),
    )
