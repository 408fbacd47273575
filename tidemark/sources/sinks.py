"""Writers.

Text outputs are written as one row per line, range-partitioned by position:
parts of a file stay in order by part number and no task holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import null_safe_join


def snapshot(df: DataFrame, path: str, pull_date: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Dated snapshot: a pull_date=... folder under path. The date is a parameter."""
    target = f"{path}/pull_date={pull_date}"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(target)
    return path


def split_by_key(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """One folder per key value.

    Rebalancing gathers the rows of a key into files of a good size; AQE splits
    a hot key over several tasks and merges small ones.
    """
    df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys).format(fmt).save(path)
    return path


def ordered_text(df: DataFrame, path: str, order: list[str], by: list[str] = (), value: str = "value") -> str:
    """Write lines so that reading parts by name gives the stated order."""
    sorted_df = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).select(*by, value)
    writer = sorted_df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).text(path)
    return path


def tagged_lines(
    df: DataFrame, by: list[str], order: str, sections: list[tuple[str, str]], heads: list[tuple[str, Column]] = ()
) -> DataFrame:
    """Lines of a label/values file per key: (by..., part, place, value).

    `heads` are one-line sections computed per key: (label, aggregate giving
    the text). `sections` list one value per line in `order`: (label, column).
    One grouped pass over `df` makes both the row of each key, which carries
    labels and heads, and the rows of its values; one explode makes the lines,
    so a key's lines spread over tasks. Repeated rows give repeated lines.
    """
    cells = {"_place": F.col(order).cast("double")} | {f"_c{i}": F.col(c).cast("string") for i, (_, c) in enumerate(sections)}
    grouped = df.withColumns(cells).groupingSets([[*by, *cells], [*by]], *by, *cells)
    rows = grouped.agg(
        F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("_rows"), *[agg.cast("string").alias(f"_h{i}") for i, (_, agg) in enumerate(heads)]
    )

    def line(part: int, place: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), place.alias("place"), value.alias("value"))

    zero, k = F.lit(0.0), 2 * len(heads)
    fixed = [line(2 * i, zero, F.lit(label)) for i, (label, _) in enumerate(heads)]
    fixed += [line(2 * i + 1, zero, F.col(f"_h{i}")) for i in range(len(heads))]
    fixed += [line(k + 2 * i, zero, F.lit(label)) for i, (label, _) in enumerate(sections)]
    listed = [line(k + 2 * i + 1, F.col("_place"), F.col(f"_c{i}")) for i in range(len(sections))]
    # Level 0 groups by the row itself.
    lines = F.when(F.col("_level") == 0, F.array(*listed)).otherwise(F.array(*fixed))
    times = F.when(F.col("_level") == 0, F.col("_rows")).otherwise(1)
    many = rows.select(*by, lines.alias("_lines"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_copy"))
    return many.select(*by, F.inline("_lines"))


def replace_after_marker(
    lines: DataFrame, new_rows: DataFrame, marker: str, count_line: int, count_step: int = 1, by: list[str] = ()
) -> DataFrame:
    """Keep a file up to its marker line, raise the number on one line, add new rows.

    `lines` has (n, value) with n the line number from 1; `new_rows` has
    (n, value) with its own order. The result is ordered by (part, n).
    A file without the marker is an error. With `by`, both hold many files,
    named by these columns.
    """
    at = lines.where(F.col("value").rlike(marker)).groupBy(*by).agg(F.min("n").alias("_at"))
    absent = F.raise_error(F.lit(f"no line matches {marker}")).cast("int")
    placed = lines.join(at.withColumnRenamed("_at", "_first"), [*by], "left") if by else lines.withColumn("_first", at.scalar())
    head = placed.withColumn("_at", F.coalesce("_first", absent)).where(F.col("n") <= F.col("_at")).drop("_at", "_first")
    bumped = F.when(
        F.col("n") == count_line, (F.col("value").try_cast("int") + count_step).cast("string")
    ).otherwise(F.col("value"))
    head = head.select(*by, F.lit(0).alias("part"), "n", bumped.alias("value"))
    return head.unionByName(new_rows.select(*by, F.lit(1).alias("part"), "n", "value"))


def composition_lines(wide: DataFrame, front: list[str], bins: list[str], sep: str = "\t") -> DataFrame:
    """Front columns and bin columns as one text line per row."""
    return wide.select(
        *front, F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in [*front, *bins]]).alias("value")
    )


def vector_lines(df: DataFrame, by: list[str], order: str, fields: list[tuple[str, str, str]], chunk: int = 60) -> DataFrame:
    """Archive form: a "#FIELD - text" line, then the values in order.

    Each field is (name, description, column). Values are packed `chunk` to a
    line by their place (order - the key's first), so long vectors wrap over
    several lines and no task concatenates a whole vector. One grouped pass
    makes the lines of all fields.
    """
    first = df.groupBy(*by).agg(F.min(order).alias("_first"))
    placed = null_safe_join(df, first, by).withColumn("_row", F.floor((F.col(order) - F.col("_first")) / chunk).cast("long"))
    values = F.struct(F.col(order).alias("o"), *[F.col(c).cast("string").alias(f"v{i}") for i, (_, _, c) in enumerate(fields)])
    packed = placed.groupBy(*by, "_first", "_row").agg(F.array_sort(F.collect_list(values)).alias("_v"))

    def line(part: int, place: Column, value: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), place.alias("place"), value.alias("value"))

    heads, bodies = [], []
    for i, (name, text, _) in enumerate(fields):
        heads.append(line(2 * i, F.lit(0).cast("long"), F.lit(f"#{name} - {text}")))
        bodies.append(line(2 * i + 1, F.col("_row"), F.array_join(F.col(f"_v.v{i}"), " ")))
    # The first chunk holds the least place; a key without any place has one chunk.
    opens = F.coalesce(F.col("_row") == 0, F.col("_first").isNull())
    return packed.select(*by, F.inline(F.when(opens, F.array(*heads, *bodies)).otherwise(F.array(*bodies))))
