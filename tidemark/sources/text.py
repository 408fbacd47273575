"""Sectioned and blank-separated text.

Lines are read as rows with (path, block, line): the file, the split it came
from and its place in that split. Running values over a file are computed per
split and carried over splits by a one-row-per-split table, so a single very
large file still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dates import parse_month_first, week_of_year


def read_lines(spark: SparkSession, path, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Lines with their position: path, block, line, value."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_replace("value", "\r$", "").alias("value"),
    )


def select_files(lines: DataFrame, keep: str = ".*", drop: str | None = None) -> DataFrame:
    """Keep files whose path matches one pattern and not another."""
    out = lines.where(F.col("path").rlike(keep))
    return out.where(~F.col("path").rlike(drop)) if drop else out


def running_values(
    lines: DataFrame, counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None
) -> DataFrame:
    """Running values down each file, this line included.

    counts: number of lines so far that pass a test. lasts: last non-null value
    so far. Each split is scanned by itself; one row per split carries the
    values on to the next split.
    """
    counts, lasts = counts or {}, lasts or {}
    hits = {n: F.when(test, 1).otherwise(0) for n, test in counts.items()}
    inner = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    local = lines.withColumns(
        {f"_in_{n}": F.sum(h).over(inner) for n, h in hits.items()}
        | {f"_in_{n}": F.last(e, ignorenulls=True).over(inner) for n, e in lasts.items()}
    )
    blocks = lines.groupBy("path", "block").agg(
        *[F.sum(h).alias(f"_t_{n}") for n, h in hits.items()],
        *[F.max_by(e, F.when(e.isNotNull(), F.col("line"))).alias(f"_t_{n}") for n, e in lasts.items()],
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "path",
        "block",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_pre_{n}") for n in hits],
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_pre_{n}") for n in lasts],
    )
    out = local.join(blocks, ["path", "block"])
    return out.select(
        *lines.columns,
        *[(F.col(f"_in_{n}") + F.col(f"_pre_{n}")).cast("long").alias(n) for n in hits],
        *[F.coalesce(F.col(f"_in_{n}"), F.col(f"_pre_{n}")).alias(n) for n in lasts],
    )


def running_count(lines: DataFrame, test: Column, out: str) -> DataFrame:
    """Number of lines up to and including this one that pass `test`, per file."""
    return running_values(lines, counts={out: test})


def words(value: Column | str) -> Column:
    """Blank-separated words of a line; a blank line gives none."""
    value = F.col(value) if isinstance(value, str) else value
    return F.filter(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "), lambda w: w != "")


def _typed_words(lines: DataFrame, schema: str, keep: list[str]) -> DataFrame:
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    w = lines.withColumn("_w", words("value"))
    w = w.where(F.size("_w") >= len(fields))
    return w.select(
        *keep, *[F.get("_w", F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)]
    )


def whitespace_table(spark: SparkSession, path, schema: str, header: bool = False, keep_path: bool = False) -> DataFrame:
    """Blank-separated table under a declared schema.

    With header=True header lines are recognised by their first two words being
    the first two column names (in any case), so they are found in every file.
    """
    lines = read_lines(spark, path)
    if header:
        names = [f.strip().rsplit(" ", 1)[0].lower() for f in schema.split(",")][:2]
        is_header = F.lower(F.concat_ws(" ", F.slice(words("value"), 1, len(names)))) == F.lit(" ".join(names))
        lines = lines.where(~is_header)
    return _typed_words(lines, schema, ["path"] if keep_path else [])


def rows_after_marker(spark: SparkSession, path, marker: str, row: str, schema: str) -> DataFrame:
    """Rows that match a pattern and stand after a marker line in their file."""
    lines = running_count(read_lines(spark, path), F.col("value").rlike(marker), "_seen")
    return _typed_words(lines.where((F.col("_seen") > 0) & F.col("value").rlike(row)), schema, [])


def lines_between(spark: SparkSession, path, start: str, end: str) -> DataFrame:
    """Lines after a start marker and before the next end marker, markers left out."""
    is_start, is_end = F.col("value").rlike(start), F.col("value").rlike(end)
    state = F.when(is_start, F.lit("in")).when(is_end, F.lit("out"))
    lines = running_values(read_lines(spark, path), lasts={"_state": state})
    return lines.where((F.col("_state") == "in") & ~is_start).drop("_state")


def preamble_csv(
    spark: SparkSession, path, header_pattern: str, columns: list[str], glob: str | None = None
) -> DataFrame:
    """Comma-separated files that carry a junk preamble before the header line.

    Every file is skipped to the line after its header; the columns are named
    by the caller, all as text. Quoted commas are understood.
    """
    lines = running_count(read_lines(spark, path, glob), F.col("value").rlike(header_pattern), "_seen")
    body = lines.where((F.col("_seen") > 0) & ~F.col("value").rlike(header_pattern) & (F.trim("value") != ""))
    schema = ", ".join(f"`{c}` string" for c in columns)
    return body.select("path", F.from_csv("value", schema).alias("r")).select("path", "r.*")


def weekly_catch(spark: SparkSession, path, header_pattern: str = r"ACCOUNT.NAME", glob: str | None = None) -> DataFrame:
    """Weekly report files as (species, date, week, year, catch)."""
    raw = preamble_csv(spark, path, header_pattern, ["species", "date", "catch"], glob)
    dated = raw.withColumn("date", parse_month_first("date")).withColumn("catch", F.col("catch").try_cast("double"))
    return dated.select(
        "species", "date", week_of_year("date").alias("week"), F.year("date").alias("year"), "catch"
    )


def tagged_sections(lines: DataFrame, label: Column, tag: Column) -> DataFrame:
    """Label lines followed by value lines -> (path, section, tag, size, pos, value).

    `label` tells label lines from value lines, `tag` reads a label line's name.
    Values keep their order inside the section across lines (pos from 0); size
    is the number of values in the section.
    """
    marked = running_values(lines, counts={"section": label}, lasts={"tag": F.when(label, tag)})
    cells = marked.where(~label & (F.col("section") > 0)).withColumn("_w", words("value")).where(F.size("_w") > 0)
    keys = ["path", "section", "block"]
    before_in = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_off", F.coalesce(F.sum(F.size("_w")).over(before_in), F.lit(0)))
    sizes = cells.groupBy(*keys).agg(F.sum(F.size("_w")).alias("_n"))
    section = Window.partitionBy("path", "section")
    before = section.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pre"), F.sum("_n").over(section).alias("size")
    )
    out = cells.join(sizes, keys).select(
        "path", "section", "tag", "size", (F.col("_off") + F.col("_pre")).alias("_base"), F.posexplode("_w").alias("_i", "value")
    )
    return out.select(
        "path", "section", "tag", "size", (F.col("_base") + F.col("_i")).cast("long").alias("pos"), "value"
    )


def report_vectors(spark: SparkSession, path, index_tag: str = "yrs") -> DataFrame:
    """Report of bare-word labels, each followed by a vector: values by index value.

    Vectors as long as the index vector are lined up with it by position.
    """
    lines = read_lines(spark, path)
    cells = tagged_sections(lines, F.col("value").rlike(r"^\s*[A-Za-z]"), F.trim("value"))
    # All tags of one place in one file: as many rows as the report has vectors.
    place = Window.partitionBy("path", "pos")
    is_index = F.col("tag") == index_tag
    number = F.col("value").try_cast("double")
    aligned = cells.select(
        "path",
        "tag",
        "size",
        F.max(F.when(is_index, number.cast("int"))).over(place).alias(index_tag),
        F.max(F.when(is_index, F.col("size"))).over(place).alias("_index_size"),
        number.alias("value"),
    )
    return aligned.where((F.col("tag") != index_tag) & (F.col("size") == F.col("_index_size"))).select(
        "path", index_tag, "tag", "value"
    )


def comment_sections(spark: SparkSession, path) -> DataFrame:
    """Sections whose label is a comment line starting with #."""
    lines = read_lines(spark, path)
    is_label = F.col("value").rlike(r"^\s*#")
    return tagged_sections(lines, is_label, F.trim(F.regexp_replace("value", r"^\s*#+\s*", "")))


def key_value_report(spark: SparkSession, path) -> DataFrame:
    """Archive report: a "#FIELD - description" line, then its value lines.

    A # line whose first word is not all capitals is prose and is skipped.
    Quoted text is one value; other lines are split at blanks.
    """
    lines = read_lines(spark, path)
    is_field = F.col("value").rlike(r"^#[A-Z][A-Z0-9_]*(\s|-|$)")
    is_prose = F.col("value").rlike(r"^#") & ~is_field
    tag = F.regexp_extract("value", r"^#([A-Z][A-Z0-9_]*)", 1)
    body = lines.where(~is_prose)
    quoted = F.col("value").rlike(r'^\s*"')
    # A quoted line becomes one word by hiding its blanks while it is split.
    text = F.when(
        quoted & ~is_field, F.translate(F.regexp_extract("value", r'^\s*"([^"]*)"', 1), " ", "\u0001")
    ).otherwise(F.col("value"))
    cells = tagged_sections(body.withColumn("value", text), F.col("value").rlike(r"^#"), tag)
    return cells.withColumn("value", F.translate("value", "\u0001", " "))


def terminated_blocks(spark: SparkSession, path, terminator: str = "-9999") -> DataFrame:
    """Data file whose blocks end at a terminator row -> (path, block_id, words).

    Comments after # are dropped. block_id counts terminators from 0; the
    terminator rows themselves are left out.
    """
    lines = read_lines(spark, path).withColumn("value", F.regexp_replace("value", "#.*$", ""))
    w = words("value")
    is_end = F.coalesce(F.get(w, F.lit(0)) == F.lit(terminator), F.lit(False))
    lines = running_count(lines, is_end, "block_id").where(~is_end)
    return lines.select("path", "block_id", w.alias("words")).where(F.size("words") > 0)


def numeric_rows(rows: DataFrame, block_id: int, columns: list[str]) -> DataFrame:
    """Rows of one block that have exactly the given columns, as doubles."""
    fit = rows.where((F.col("block_id") == block_id) & (F.size("words") == len(columns)))
    return fit.select(*[F.get("words", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)])


def composition_block(rows: DataFrame, block_id: int, front: list[str], bins: list[int]) -> DataFrame:
    """Composition rows of one block in long form: front columns, bin_sex, bin, freq.

    The vector holds all female bins, then all male bins.
    """
    k, n = len(front), len(bins)
    fit = rows.where((F.col("block_id") == block_id) & (F.size("words") == k + 2 * n))
    edges = F.array(*[F.lit(b) for b in bins])
    cells = fit.select(
        *[F.get("words", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(front)],
        F.posexplode(F.slice("words", k + 1, 2 * n)).alias("_i", "_v"),
    )
    return cells.select(
        *front,
        F.when(F.col("_i") < n, F.lit("F")).otherwise(F.lit("M")).alias("bin_sex"),
        F.get(edges, F.col("_i") % n).alias("bin"),
        F.col("_v").try_cast("double").alias("freq"),
    )


def many_runs(spark: SparkSession, path, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """The same table from many run folders, with `model` = the folder name.

    `path` is a glob over the files, so a folder named key=value is read as is.
    """
    df = spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return df.select("*", F.regexp_replace(folder, "^[^=]*=", "").alias("model"))
