"""Double age reads: preparation and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import count_identical
from ..operators.filters import drop_known, require_values
from ..operators.reshape import pivot_wide

# Code for "not read by this reader" (fixed value).
NO_READ = -999


def usable_reads(df: DataFrame, bad_ids=()) -> DataFrame:
    """Reads with both ages, without known outliers."""
    return drop_known(require_values(df, "read_age", "test_age"), "fish_id", bad_ids)


def reads_by_reader(df: DataFrame, readers: list[str], bad_ids=(), min_count: int = 2, pooled: bool = False) -> DataFrame:
    """Identical read patterns with their counts.

    df, one row per fish: (fish_id, read_age, test_age, reader_name, tester_name). One column per
    reader holds the age, NO_READ where it did not read and the higher age where
    both reads of a fish are by one reader; pooled=True uses the
    two read positions instead. min_count=2 leaves out patterns seen once.
    """
    reads = usable_reads(df, bad_ids)
    if pooled:
        levels = ["reader1", "reader2"]
        wide = reads.select(F.col("read_age").alias("reader1"), F.col("test_age").alias("reader2"))
    else:
        levels = readers
        age = lambda r: F.greatest(F.when(F.col("reader_name") == r, F.col("read_age")), F.when(F.col("tester_name") == r, F.col("test_age")))
        wide = reads.select(*[F.coalesce(age(r), F.lit(NO_READ)).alias(r) for r in readers])
    return count_identical(wide, levels, min_count)


def read_offsets(df: DataFrame, bad_ids=()) -> DataFrame:
    """Per reader: number of reads, mean and spread of read minus test age."""
    d = (F.col("read_age") - F.col("test_age")).cast("double")
    return (
        usable_reads(df, bad_ids)
        .groupBy("reader_name")
        .agg(
            F.count(F.lit(1)).alias("reads"),
            F.avg(d).alias("mean_offset"),
            F.stddev_samp(d).alias("sd_offset"),
            F.avg((d == 0).cast("double")).alias("agreement"),
        )
    )


def reads_and_tests(df: DataFrame, bad_ids=()) -> DataFrame:
    """Per person: usable fish read as reader and as tester."""
    parts = F.array(
        F.struct(F.col("reader_name").alias("name"), F.lit(1).alias("read")),
        F.struct(F.col("tester_name").alias("name"), F.lit(0).alias("read")),
    )
    each = usable_reads(df, bad_ids).select(F.inline(parts))
    return each.groupBy("name").agg(F.sum("read").alias("reads"), F.sum(1 - F.col("read")).alias("tests"))


def reader_tester_crosstab(df: DataFrame, people: list[str], bad_ids=()) -> DataFrame:
    """Usable fish per reader (rows) and tester (columns), zero where they never met."""
    one = usable_reads(df, bad_ids).select("reader_name", "tester_name", F.lit(1).alias("n"))
    return pivot_wide(one, ["reader_name"], "tester_name", "n", people, combine="sum", fill=0)


def cells_read(wide: DataFrame, readers: list[str]) -> DataFrame:
    """Number of cells that hold a read."""
    out = wide.agg(*[F.count_if(F.col(f"`{r}`") != NO_READ).alias(r) for r in readers])
    total = None
    for r in readers:
        total = F.col(f"`{r}`") if total is None else total + F.col(f"`{r}`")
    return out.select(total.alias("n_read"))
