"""Checks. Each returns a table of findings or one row with counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rounding import round_even
from .joins import null_safe_join


def unmapped(df: DataFrame, source: str, recoded: str) -> DataFrame:
    """Source values that a recode left without a target, with their row counts."""
    return df.where(F.col(recoded).isNull()).groupBy(source).agg(F.count(F.lit(1)).alias("rows"))


def keys_align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys on both sides, only left, only right."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, keys, "full_outer")
    return j.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def nonempty(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("ok", F.col("rows") > 0)


def require_nonempty(df: DataFrame, name: str = "query") -> DataFrame:
    """Stop when a source returned no row."""
    if df.isEmpty():
        raise ValueError(f"{name} returned no rows")
    return df


def sums_to_one(df: DataFrame, by: list[str], share: str, tol: float = 1e-9) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(share).alias("total")).withColumn(
        "ok", F.abs(F.col("total") - 1.0) < F.lit(tol)
    )


def parts_equal_total(df: DataFrame, by: list[str], part: str, total: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(part).alias("parts"), F.max(total).alias("total")).withColumn(
        "ok", F.col("parts") == F.col("total")
    )


def block_digests(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Row count and two order-free digests of the rows (keys, value) of each `_block`."""
    cols = [F.col(c) for c in (*keys, value)]
    # A hash skips nulls, so it is told where they are.
    row = F.xxhash64(*cols, *[c.isNull() for c in cols])
    return df.groupBy("_block").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("total"), F.bit_xor(row).alias("mixed")
    )


def differing_blocks(new: DataFrame, old: DataFrame) -> DataFrame:
    """Blocks whose digests differ or that one side lacks; at most the number of blocks."""
    digests = [F.col(c) for c in ("rows", "total", "mixed")]
    a = new.select("_block", F.struct(*digests).alias("_a"))
    b = old.select("_block", F.struct(*digests).alias("_b"))
    return a.join(b, "_block", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("_block")


def reconcile(new: DataFrame, old: DataFrame, keys: list[str], value: str, digits: int = 4, blocks: int = 4096) -> DataFrame:
    """Rows that differ between two extracts after rounding, or exist in one only.

    Keys are hashed to `blocks` blocks and each extract is digested per block;
    only rows of blocks whose digests differ reach the join, so equal extracts
    are digested and not joined. A missing key matches a missing key. A key repeated
    in a block that differs is compared with each of its rows on the other side.
    """
    block = F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("_block")
    a = new.select(*keys, round_even(value, digits).alias("new_value"), block)
    b = old.select(*keys, round_even(value, digits).alias("old_value"), block)
    differ = differing_blocks(block_digests(a, keys, "new_value"), block_digests(b, keys, "old_value"))
    a = a.join(differ, "_block", "left_semi").select(*keys, "new_value", F.lit(True).alias("_n"))
    b = b.join(differ, "_block", "left_semi").select(*keys, "old_value", F.lit(True).alias("_o"))
    j = null_safe_join(a, b, keys, "full_outer")
    status = (
        F.when(F.col("_o").isNull(), F.lit("added"))
        .when(F.col("_n").isNull(), F.lit("removed"))
        .when(~F.col("new_value").eqNullSafe(F.col("old_value")), F.lit("changed"))
    )
    return j.withColumn("status", status).where(F.col("status").isNotNull()).drop("_n", "_o")


def bins_present(df: DataFrame, by: list[str], bin_col: str, expected: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(bin_col).alias("bins")).withColumn(
        "ok", F.col("bins") == F.lit(expected)
    )
