"""Long and wide forms, unions, spines and completed grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How several long rows for one wide cell combine. "unique" fails on a second row.
_COMBINE = {"unique": "max", "max": "max", "min": "min", "sum": "sum", "mean": "avg"}

from ..functions.binding import let
from ..session import stored
from .joins import null_safe_join


def _cell_name(text: str, parts: list[Column]) -> Column:
    """`text` and the key of a cell, missing parts shown as null."""
    shown = [F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.concat(F.lit(f"{text} ("), F.concat_ws(", ", *shown), F.lit(")"))


def pivot_wide(
    df: DataFrame,
    ids: list[str],
    name: str | Column,
    values: dict[str, str] | str,
    levels: list,
    label: str = "{level}",
    combine: str = "unique",
    fill=None,
) -> DataFrame:
    """Long to wide with the levels stated, so the plan needs no extra job.

    `values` is one value column, or {label part: column} for several; `label`
    may use {level} and {value}. `fill` replaces absent cells. A cell with more
    than one row is an error that names it, unless `combine` says how its rows
    count together (max, min, sum, mean). Values and row counts per cell come from
    one pass: partial sums, then one exchange by `ids`. Rows of other levels
    (null too) keep their ids and fill no cell.
    """
    many = values if isinstance(values, dict) else {"": values}
    agg = _COMBINE[combine]
    key = F.col(name) if isinstance(name, str) else name
    # The place of the level, from 1; 0 or null for others.
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), key) if levels else F.lit(0)
    rows = df.select(*ids, place.alias("_k"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(many.values())])
    cells, counts, names = [], [], []
    for k, level in enumerate(levels):
        counts.append(F.expr(f"count_if(_k = {k + 1}) AS _n{k}"))
        for i, part in enumerate(many):
            cells.append(F.expr(f"{agg}(if(_k = {k + 1}, _v{i}, null)) AS _c{k}_{i}"))
            names.append(label.format(level=level, value=part))
    keys = [F.col(f"`{c}`") for c in ids]
    if not cells:
        return rows.select(*keys).distinct()
    wide = rows.groupBy(*keys).agg(*cells, *(counts if combine == "unique" else []))
    if combine == "unique":
        # A filter holds the check, as a column may be pruned.
        place = F.expr(f"array_position(array({', '.join(f'_n{k} > 1' for k in range(len(levels)))}), true)")
        at = F.get(F.array(*[F.lit(str(v)) for v in levels]), (place - 1).cast("int"))
        told = F.raise_error(_cell_name("more than one row for cell", [*keys, at])).cast("boolean")
        wide = wide.where(F.when(place > 0, told).otherwise(True))
    wide = wide.select(*keys, *[F.col(f"_c{k}_{i}") for k in range(len(levels)) for i in range(len(many))]).toDF(*ids, *names)
    return wide if fill is None else wide.fillna(fill, subset=names)


def unpivot_long(
    df: DataFrame, ids: list[str], cols: list[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def unpivot_pairs(df: DataFrame, ids: list[str], groups: dict[str, dict[str, str]], name: str) -> DataFrame:
    """Unpivot column sets together: groups = {"reader1": {"age": "read_age", ...}, ...}."""
    rows = F.array(
        *[
            F.struct(F.lit(tag).alias(name), *[F.col(src).alias(dst) for dst, src in cols.items()])
            for tag, cols in groups.items()
        ]
    )
    fields = [name, *next(iter(groups.values()))]
    return df.select(*ids, F.explode(rows).alias("_p")).select(*ids, *[F.col(f"_p.{f}") for f in fields])


def transpose(df: DataFrame, row: str, cols: list[str], row_levels: list, out: str = "item") -> DataFrame:
    """Columns become rows and the listed row keys become columns."""
    long = df.unpivot([row], cols, out, "_v")
    return pivot_wide(long, [out], row, "_v", row_levels)


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def union_fill(*dfs: DataFrame) -> DataFrame:
    """Union of tables with different columns; absent ones are null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def values_not_in(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Distinct values of left that right lacks."""
    return left.select(col).subtract(right.select(col))


def year_spine(bounds: DataFrame, low: str, high: str, out: str = "year", step: int = 1) -> DataFrame:
    """One row per step between two bound columns."""
    return bounds.withColumn(out, F.explode(F.sequence(F.col(low), F.col(high), F.lit(step))))


def missing_from_spine(spine: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    return spine.join(df.select(*keys).distinct(), keys, "left_anti")


def level_dictionary(df: DataFrame, name: str, max_levels: int = 100_000) -> Column:
    """The values of a column as one sorted array, nulls left out; more than `max_levels` are an error."""
    found = df.select(name).where(F.col(name).isNotNull()).distinct().limit(max_levels + 1)
    values = F.array_sort(F.collect_list(name))
    told = F.lit(f"more than {max_levels} levels of {name}")
    kind = f"array<{df.schema[name].dataType.simpleString()}>"
    return found.agg(F.when(F.count("*") > max_levels, F.raise_error(told).cast(kind)).otherwise(values).alias("_levels")).scalar()


def complete_grid(
    df: DataFrame,
    by: list[str],
    levels: dict[str, list | None],
    fill: dict[str, float] | None = None,
    spine: DataFrame | None = None,
    unlisted: str = "keep",
) -> DataFrame:
    """Add the missing combinations of `by` with each level column.

    A list states the levels; None takes the levels met in the data, gathered once
    into a size-checked dictionary. `df` has one row per combination (two are an
    error that names it). The cells of a key are gathered and looked up while
    the levels fan out inside its row, so there is one exchange by key and no
    product join; with data levels `df` is written once and not computed again.
    Rows whose level is missing or not listed stay as they are (unlisted="keep",
    after the grid), or fail="fail" names the first of a key, or "drop" leaves
    them out; `unlisted_levels` counts them. `spine` adds keys that `df` lacks.
    `fill` sets values for added (and null) cells.
    """
    if unlisted not in ("keep", "fail", "drop"):
        raise ValueError(f"unlisted: keep, fail or drop, not {unlisted}")
    names = list(levels)
    if any(v is None for v in levels.values()):
        df = stored(df, "grid-cells")
    rest = [c for c in df.columns if c not in by and c not in levels]
    rows = df if spine is None else df.unionByName(spine.select(*by).distinct().withColumn("_spine", F.lit(True)), allowMissingColumns=True)
    is_cell = F.lit(True) if spine is None else F.col("_spine").isNull()
    listed = F.lit(True)
    for n, v in levels.items():
        listed = listed & (F.col(n).isNotNull() if v is None else F.coalesce(F.col(n).isin(list(v)), F.lit(False)))
    entry = F.struct(F.struct(*names).alias("k"), F.struct(*rest).alias("v"))
    # collect_list skips nulls, so a key without any listed cell still gets its row.
    cells = rows.groupBy(*by).agg(
        F.collect_list(F.when(is_cell & listed, entry)).alias("_cells"),
        F.collect_list(F.when(is_cell & ~listed, entry)).alias("_others"),
    )
    keyed = [F.col(f"`{b}`") for b in by]
    kind = cells.schema["_cells"].dataType

    def failing(text: str, first: Column) -> Column:
        return F.raise_error(_cell_name(text, [*keyed, *[first[n] for n in names]])).cast(kind)

    def unique(keys: Column) -> Column:
        """The cells, or an error that names a key that occurs twice; `keys` are sorted."""
        place = F.array_position(F.transform(keys, lambda k, i: (i > 0) & F.coalesce(k == F.get(keys, i - 1), F.lit(False))), True)
        return F.when(place > 0, failing("more than one row for cell", F.get(keys, (place - 1).cast("int")))).otherwise(F.col("_cells"))

    checked = let(F.array_sort(F.transform("_cells", lambda e: e["k"])), unique)
    if unlisted == "fail":
        checked = F.when(F.size("_others") > 0, failing("level not listed in cell", F.col("_others")[0]["k"])).otherwise(checked)
    for i, (n, v) in enumerate(levels.items()):
        cells = cells.withColumn(f"_d{i}", level_dictionary(df, n) if v is None else _level_array(df, n, v))

    def combinations(at: Column, i: int, chosen: list[Column]) -> Column:
        if i == len(names):
            k = F.struct(*[c.alias(n) for n, c in zip(names, chosen)])
            return F.array(F.struct(k.alias("k"), F.try_element_at(at, k).alias("v")))
        return F.flatten(F.transform(F.col(f"_d{i}"), lambda x: combinations(at, i + 1, [*chosen, x])))

    grid = let(F.map_from_entries(checked), lambda at: combinations(at, 0, []))
    every = F.concat(grid, F.col("_others")) if unlisted == "keep" else grid
    # The outer form: the plain one adds a filter on its size, for which all cells would be built twice.
    out = cells.select(*by, F.explode_outer(every).alias("_e")).where(F.col("_e").isNotNull())
    out = out.select(*by, *[F.col(f"_e.k.{n}").alias(n) for n in names], *[F.col(f"_e.v.{c}").alias(c) for c in rest])
    for col, value in (fill or {}).items():
        out = out.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    return out


def unlisted_levels(df: DataFrame, levels: dict[str, list | None]) -> DataFrame:
    """(level, value, rows): rows whose level column is missing or holds a value that is not listed."""
    parts = []
    for n, v in levels.items():
        other = F.col(n).isNull() if v is None else F.coalesce(~F.col(n).isin(list(v)), F.lit(True))
        parts.append(F.when(other, F.struct(F.lit(n).alias("level"), F.col(n).cast("string").alias("value"))))
    each = df.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    return each.groupBy("p.level", "p.value").agg(F.count("*").alias("rows"))


def _level_array(df: DataFrame, name: str, values: list) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{df.schema[name].dataType.simpleString()}>")


def full_sequence(df: DataFrame, by: list[str], col: str, step: int) -> DataFrame:
    """Every value between a group's minimum and maximum at a fixed step."""
    ends = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return year_spine(ends, "_lo", "_hi", col, step).drop("_lo", "_hi")


def order_by_items(
    df: DataFrame, key: str, items: list[tuple], fields: tuple[str, ...] = ("label",)
) -> DataFrame:
    """Attach presentation rows to keyed rows: items = [(key, label, ...), ...].

    A key may appear more than once. `ord` is the place in the list. The list
    is part of the plan, so this is a narrow fan-out.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(item[0]).alias("_key"),
                F.lit(i + 1).alias("ord"),
                *[F.lit(x).alias(f) for f, x in zip(fields, item[1:])],
            )
            for i, item in enumerate(items)
        ]
    )
    out = df.withColumn("_item", F.explode(F.filter(rows, lambda r: r["_key"] == F.col(key))))
    return out.select(*df.columns, F.col("_item.ord").alias("ord"), *[F.col(f"_item.{f}").alias(f) for f in fields])
