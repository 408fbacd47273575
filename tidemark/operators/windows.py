"""Group totals, running sums and ranks.

Functions with a `raw` switch choose between two exact plans. raw=True is for
fact rows: the totals are computed first (partial sums before the shuffle) and
joined back; small totals are broadcast by measured size, so the facts are not
shuffled at all, and large ones give a join whose hot keys AQE splits.
raw=False is for tables already summarised to a few rows per group: one
window, one shuffle.

The functions named ranged_* give ranks, running sums and trailing means for
groups of any size: rows are range-partitioned by group and order, so a group
spreads over as many chunks as its share of the rows; each chunk works alone and
one row per group and chunk carries counts, totals or the last years over.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .joins import measured, null_safe_join


def group_value(df: DataFrame, by: list[str], agg: Column, out: str, raw: bool = True) -> DataFrame:
    """Attach a per-group aggregate to every row; with no keys, one overall value."""
    if not by:
        return df.withColumn(out, df.agg(agg.alias(out)).scalar())
    if not raw:
        return df.withColumn(out, agg.over(Window.partitionBy(*by)))
    totals = measured(df.groupBy(*by).agg(agg.alias(out)))
    renamed = totals.select(*[F.col(b).alias(f"_k_{b}") for b in by], out)
    cond = None
    for b in by:
        term = df[b].eqNullSafe(renamed[f"_k_{b}"])
        cond = term if cond is None else cond & term
    return df.join(renamed, cond, "inner").drop(*[f"_k_{b}" for b in by])


def share_of_total(df: DataFrame, by: list[str], value: str, out: str, raw: bool = False) -> DataFrame:
    """value / group total; null when the total is zero."""
    total = group_value(df, by, F.sum(value), "_total", raw=raw)
    return total.withColumn(out, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def cumulative_share(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Running total and its share, on rows already summarised to the order key."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn(f"cumulative_{value}", F.sum(value).over(w))
        .withColumn("_total", F.sum(value).over(Window.partitionBy(*by)))
        .withColumn("cumulative_share", F.try_divide(F.col(f"cumulative_{value}"), F.col("_total")))
        .drop("_total")
    )


def number_rows(df: DataFrame, by: list[str], order: list[Column | str], out: str = "row") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def carry_forward(df: DataFrame, by: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Fill nulls with the last value before them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def carry_forward_chunked(
    df: DataFrame, by: list[str], chunk: str, order: list[str], cols: list[str]
) -> DataFrame:
    """carry_forward for groups too long for one task.

    `chunk` splits a group into consecutive pieces (its order agrees with
    `order`). Each piece fills itself; one row per piece then carries the last
    value over to the next piece.
    """
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.withColumns({f"_in_{c}": F.last(c, ignorenulls=True).over(inner) for c in cols})
    key = F.struct(*order)
    tails = df.groupBy(*by, chunk).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_tail_{c}") for c in cols]
    )
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumns({f"_pre_{c}": F.last(f"_tail_{c}", ignorenulls=True).over(before) for c in cols})
    keys = [*by, chunk]
    tails = tails.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_pre_{c}" for c in cols])
    # Missing keys match each other, as they do in a window.
    match = functools.reduce(lambda a, b: a & b, [filled[k].eqNullSafe(tails[f"_k_{k}"]) for k in keys])
    out = filled.join(tails, match, "left")
    return out.select(
        *[F.coalesce(F.col(f"_in_{c}"), F.col(f"_pre_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def rescale_min(df: DataFrame, by: list[str], value: str, out: str, raw: bool = False) -> DataFrame:
    return (
        group_value(df, by, F.min(value), "_min", raw=raw)
        .withColumn(out, F.col(value) - F.col("_min"))
        .drop("_min")
    )


def top_with_ties(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n highest rows per group, ties kept, on summarised rows."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last())
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= n).drop("_rank")


def trailing_mean(df: DataFrame, by: list[str], year: str, value: str, years: int, out: str) -> DataFrame:
    """Mean over the `years` calendar years before each row's year."""
    w = Window.partitionBy(*by).orderBy(year).rangeBetween(-years, -1)
    return df.withColumn(out, F.avg(value).over(w))


def _ordering(order: list[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranged(df: DataFrame, by: list[str], order: list[Column | str], chunks: int | None = None) -> DataFrame:
    """Rows in range partitions of (by, order), with `_chunk` and the place `_at`, which rises over all rows.

    Rows equal in `order` are told apart by all their columns, then by their
    place in the input, so that they spread too. The rows are written once:
    all that follows sees one and the same division.
    """
    told = [F.xxhash64(*df.columns).alias("_told"), F.monotonically_increasing_id().alias("_input")]
    keys = [*[F.col(b) for b in by], *_ordering(order), F.col("_told"), F.col("_input")]
    rows = df.select("*", *told)
    rows = rows.repartitionByRange(*([chunks] if chunks else []), *keys).sortWithinPartitions(*keys)
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).drop("_told", "_input")
    # The upper bits of the id number the partition.
    return stored(placed.withColumn("_chunk", F.shiftright("_at", 33).cast("int")), "ranged")


def _carried(placed: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and chunk: `_first` place, and for each sum its value in the chunks before and in the whole group."""
    heads = placed.groupBy(*by, "_chunk").agg(F.min("_at").alias("_first"), *[c.alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return measured(
        heads.select(
            *by,
            "_chunk",
            "_first",
            *[F.sum(n).over(before).alias(f"{n}_before") for n in sums],
            *[F.sum(n).over(whole).alias(f"{n}_whole") for n in sums],
        )
    )


def ranged_row_number(df: DataFrame, by: list[str], order: list[Column | str], out: str = "row", chunks: int | None = None) -> DataFrame:
    """row_number() for groups of any size: the place within a chunk plus the group's rows in chunks before.

    Missing keys form a group. Rows equal in `order` get numbers in a fixed order of their columns.
    """
    placed = ranged(df, by, order, chunks)
    heads = _carried(placed, by, {"_n": F.count("*")})
    joined = null_safe_join(placed, heads, [*by, "_chunk"])
    number = F.col("_at") - F.col("_first") + 1 + F.coalesce("_n_before", F.lit(0))
    return joined.withColumn(out, number).select(*df.columns, out)


def ranged_running_sum(
    df: DataFrame, by: list[str], order: list[Column | str], value: str, out: str, share: str | None = None, chunks: int | None = None
) -> DataFrame:
    """Running sum in `order` (rows one by one) for groups of any size, and optionally its share of the group's total.

    A null value adds nothing; the sum is null until the first value, and the
    share is null where the total is zero or null, as with a window.
    """
    placed = ranged(df, by, order, chunks)
    heads = _carried(placed, by, {"_s": F.sum(value)})
    inner = Window.partitionBy(*by, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.sum(value).over(inner))
    joined = null_safe_join(own, heads, [*by, "_chunk"])
    total = F.coalesce(F.col("_own") + F.col("_s_before"), "_own", "_s_before")
    result = joined.withColumn(out, total)
    if share:
        result = result.withColumn(share, F.try_divide(F.col(out), F.col("_s_whole")))
    return result.select(*df.columns, out, *([share] if share else []))


def ranged_trailing_mean(
    df: DataFrame, by: list[str], year: str, value: str, years: int, out: str, chunks: int | None = None
) -> DataFrame:
    """Mean of `value` over the `years` calendar years before, per group and year met, for groups of any size.

    Rows are first summed by group and year. A chunk of these sums borrows the
    last `years` years of the chunks before it, at most `years` from each of at
    most `years` chunks, which is all that a window at its edge can reach.
    Returns (by..., year, out): one row per group and year. A null year has no
    years before it, and so a null mean.
    """
    sums = df.groupBy(*by, F.col(year).cast("int").alias(year)).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    unplaced = sums.where(F.col(year).isNull()).select(*by, year, F.lit(None).cast("double").alias(out))
    placed = ranged(sums.where(F.col(year).isNotNull()), by, [year], chunks)
    newest = Window.partitionBy(*by, "_chunk").orderBy(F.desc(year))
    edge = placed.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= years)
    edges = edge.groupBy(*by, "_chunk").agg(F.collect_list(F.struct(year, "_s", "_c")).alias("_edge"))
    low = placed.groupBy(*by, "_chunk").agg(F.min(year).alias("_low"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(-years, -1)
    reach = null_safe_join(edges, low, [*by, "_chunk"]).withColumn("_near", F.flatten(F.collect_list("_edge").over(before)))
    lent = reach.select(*by, "_chunk", F.inline(F.filter("_near", lambda e: e[year] >= F.col("_low") - years)), F.lit(True).alias("_lent"))
    every = placed.select(*by, "_chunk", year, "_s", "_c", F.lit(False).alias("_lent")).unionByName(lent)
    w = Window.partitionBy(*by, "_chunk").orderBy(year).rangeBetween(-years, -1)
    mean = F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w)).cast("double")
    return every.withColumn(out, mean).where(~F.col("_lent")).select(*by, year, out).unionByName(unplaced)
