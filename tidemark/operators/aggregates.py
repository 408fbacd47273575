"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.nulls import strict_sum
from ..functions.rounding import round_away
from .joins import measured, null_safe_join, with_scalar


def sum_by(df: DataFrame, by: list, value, out: str, strict: bool = False) -> DataFrame:
    c = F.col(value) if isinstance(value, str) else value
    return df.groupBy(*by).agg((strict_sum(c) if strict else F.sum(c)).alias(out))


def mean_of_sums(df: DataFrame, inner: list[str], outer: list[str], value: str, out: str) -> DataFrame:
    """Mean over groups of per-group sums."""
    sums = df.groupBy(*outer, *inner).agg(F.sum(value).alias("_s"))
    return sums.groupBy(*outer).agg(F.avg("_s").alias(out))


def additive_variance(df: DataFrame, by: list[str], mean: str, variance: str, prefix: str) -> DataFrame:
    """Sum estimates and variances over parts; the CV belongs to the sum."""
    out = df.groupBy(*by).agg(F.sum(mean).alias(prefix), F.sum(variance).alias(f"{prefix}_var"))
    return out.withColumn(f"{prefix}_cv", F.try_divide(F.sqrt(f"{prefix}_var"), F.col(prefix)))


def distinct_bitmaps(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Exact sets of an integer key per group: (by..., bucket, ids), mergeable without another scan.

    A bucket spans 32,768 keys and its set is one bitmap of 4 KB, combined before
    the shuffle; a hot group spreads over its buckets. Null keys are in no set.
    """
    k = F.col(key).cast("long")
    return df.where(k.isNotNull()).groupBy(*by, F.bitmap_bucket_number(k).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("ids")
    )


def distinct_in(bitmaps: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """Distinct keys per coarser group: bitmaps of a bucket or-ed, then counted."""
    merged = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("ids")).alias(out))


def distinct_in_spans(bitmaps: DataFrame, by: list[str], year: str, out: str = "n") -> DataFrame:
    """Distinct keys in every span first..last of calendar years, as (by..., first, last, out).

    Spans run over all years from the earliest to the latest of a group; each
    bitmap is fanned out to the spans that hold its year, bounded by the calendar.
    A missing year is in no span.
    """
    known = bitmaps.where(F.col(year).isNotNull())
    ends = known.groupBy(*by).agg(F.min(year).alias("_low"), F.max(year).alias("_high"))
    placed = null_safe_join(known, ends, by) if by else with_scalar(known, ends, "_low", "_high")
    fanned = placed.withColumn("first", F.explode(F.sequence("_low", year))).withColumn("last", F.explode(F.sequence(year, "_high")))
    return distinct_in(fanned, [*by, "first", "last"], out)


def crosstab(df: DataFrame, row: str, col: str, col_values: list) -> DataFrame:
    """Counts of row by column value, one column per listed value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in col_values])


def count_identical(df: DataFrame, cols: list[str], min_count: int = 2, out: str = "dupe_count") -> DataFrame:
    """One row per distinct row with its count; min_count=2 leaves out rows seen once."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) >= min_count)


def target_share(
    df: DataFrame, by: list[str], is_target: Column, value: str, target_out: str, all_out: str, share_out: str
) -> DataFrame:
    """Target and overall sums side by side in one pass, with their rounded ratio."""
    sums = df.groupBy(*by).agg(
        round_away(F.sum(F.when(is_target, F.col(value))), 2).alias(target_out),
        round_away(F.sum(value), 2).alias(all_out),
    )
    return sums.withColumn(share_out, round_away(F.try_divide(F.col(target_out), F.col(all_out)), 2))


def arg_min(df: DataFrame, by: list[str], value: str, at: list[str]) -> DataFrame:
    """Minimum of `value` and where it sits; a tie goes to the smallest position."""
    pos = F.min_by(F.struct(*at), F.struct(F.col(value), *at))
    out = df.where(F.col(value).isNotNull()).groupBy(*by).agg(pos.alias("_at"), F.min(value).alias(value))
    return out.select(*by, value, *[F.col(f"_at.{a}").alias(a) for a in at])


def _value_band(v: Column, resolution: int) -> Column:
    """Index of a narrow band of values; it never falls as v grows."""
    # ln of any positive double lies in (-746, 710), so the offset keeps bands positive.
    magnitude = F.floor(F.log(F.abs(v)) * resolution) + F.lit(1000 * resolution)
    finite = F.when(F.abs(v) == float("inf"), F.lit(2000 * resolution).cast("long")).otherwise(magnitude)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, finite).otherwise(-finite)


def _same(by: list[str]) -> Column:
    """Null-safe match of key columns with their _k_ copies."""
    match = F.lit(True)
    for i, b in enumerate(by):
        term = F.col(b).eqNullSafe(F.col(f"_k_{b}"))
        match = term if i == 0 else match & term
    return match


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    resolution: int = 256,
    cuts: int = 1,
) -> DataFrame:
    """Exact linearly interpolated quantiles of groups of any size.

    A built-in percentile holds all values of a group in one task. Here rows
    are first counted per narrow value band (relative width 1/resolution),
    which shuffles only partial counts. The counts tell which bands hold the
    wanted ranks; rows of other bands are dropped before anything else is
    shuffled, equal values are counted, and the few left are ranked inside
    their band. Each of `cuts` further rounds cuts the wanted bands into 4096
    finer ones in the same way, at every size of table. The answer does not
    depend on the band settings. Nulls and NaN are left out; a group with
    nothing else has null quantiles.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    rows = rows.withColumn("_band", _value_band(F.col("_v"), resolution))

    # Wanted places: (id, rank from 0, weight of the upper neighbour), from the last rank.
    ranks = []
    for p in probs.values():
        at = F.col("_last").cast("double") * F.lit(float(p))
        low = F.floor(at)
        ranks += [(low, at - low), (F.least(low + 1, F.col("_last")), at - low)]
    held = F.lit(False)
    for rank, _ in ranks:
        held = held | ((rank >= F.col("_start")) & (rank < F.col("_end")))

    def keep(bands: DataFrame) -> DataFrame:
        """Bands that hold a wanted rank: at most two per quantile and group."""
        keys = [F.col(b).alias(f"_k_{b}") for b in [*by, "_band"]]
        return measured(bands.where(held).select(*keys, "_start", "_last"))

    running = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*by, "_band").agg(F.count(F.lit(1)).alias("_n"))
    bands = keep(
        counts.select(
            *by,
            "_band",
            F.sum("_n").over(running).alias("_end"),
            (F.sum("_n").over(running) - F.col("_n")).alias("_start"),
            (F.sum("_n").over(Window.partitionBy(*by)) - 1).alias("_last"),
        )
    )
    match = _same([*by, "_band"])
    # Three cuts would reach the spacing of doubles; beyond it a band is one repeated value.
    for _ in range(cuts):
        resolution *= 4096
        outer = bands.select(*[f"_k_{b}" for b in [*by, "_band"]], F.col("_start").alias("_base"), "_last")
        rows = rows.join(outer, match).select(
            *by, "_v", F.col("_band").alias("_outer"), "_base", "_last", _value_band(F.col("_v"), resolution).alias("_band")
        )
        within = Window.partitionBy(*by, "_outer").orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
        counts = rows.groupBy(*by, "_outer", "_base", "_last", "_band").agg(F.count(F.lit(1)).alias("_n"))
        end = F.col("_base") + F.sum("_n").over(within)
        bands = keep(counts.select(*by, "_band", end.alias("_end"), (end - F.col("_n")).alias("_start"), "_last"))
        rows = rows.select(*by, "_v", "_band")

    counted = rows.join(bands, match, "left_semi").groupBy(*by, "_band", "_v").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        counted.join(bands, match)
        .withColumn("_to", F.col("_start") + F.sum("_n").over(order))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    wanted = F.array(
        *[F.struct(F.lit(i).alias("id"), rank.alias("rank"), frac.alias("frac")) for i, (rank, frac) in enumerate(ranks)]
    )
    covered = F.filter(wanted, lambda r: (r["rank"] >= F.col("_from")) & (r["rank"] < F.col("_to")))
    hit = hit.withColumn("_r", F.explode(covered))
    found = hit.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("_r.id", F.struct("_v", "_r.frac")))).alias("_m")
    )
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    out = null_safe_join(groups, found, by, "left") if by else found
    for i, name in enumerate(probs):
        lo, hi = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
        between = lo["_v"] + lo["frac"] * (hi["_v"] - lo["_v"])
        out = out.withColumn(name, F.when((lo["_v"] == hi["_v"]) | (lo["frac"] == 0), lo["_v"]).otherwise(between))
    return out.drop("_m")
