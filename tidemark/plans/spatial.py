"""Gridding of point catch rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import CPUE_BREAKS, class_of


def idw_grid(
    points: DataFrame,
    x: Column,
    y: Column,
    value: Column,
    cell: float,
    radius: float,
    power: float = 2.0,
    by: dict[str, Column] | None = None,
    breaks=CPUE_BREAKS,
) -> DataFrame:
    """Inverse-distance mean at cell centres within a radius of any point.

    Each point adds its weight to the fixed number of cells around it, and the
    cells sum weights: a narrow fan-out and one pre-summed aggregation, with no
    point-to-cell join. A cell centre that coincides with points takes their
    mean value.
    """
    by = by or {}
    reach = int(math.ceil(radius / cell)) + 1
    steps = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    base = points.select(
        *[c.alias(n) for n, c in by.items()], x.cast("double").alias("_x"), y.cast("double").alias("_y"), value.cast("double").alias("_z")
    ).where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_z").isNotNull())
    base = base.withColumn("_cx", F.floor(F.col("_x") / cell)).withColumn("_cy", F.floor(F.col("_y") / cell))
    # Rows of cells first, cut by distance before the second fan-out.
    rows = base.withColumn("_i", F.explode(steps)).withColumn("cell_x", (F.col("_cx") + F.col("_i")).cast("long"))
    rows = rows.withColumn("_dx", (F.col("cell_x") + 0.5) * cell - F.col("_x")).where(F.abs("_dx") <= radius)
    cells = rows.withColumn("_j", F.explode(steps)).withColumn("cell_y", (F.col("_cy") + F.col("_j")).cast("long"))
    cells = cells.withColumn("_dy", (F.col("cell_y") + 0.5) * cell - F.col("_y"))
    d2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")
    cells = cells.withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)
    near = F.col("_d2") > 0
    # Null weight at zero distance; such points are summed apart.
    weight = F.when(near, F.lit(1.0) / F.col("_d2")) if power == 2.0 else F.when(near, F.pow("_d2", F.lit(-power / 2.0)))
    sums = cells.withColumn("_w", weight).groupBy(*by, "cell_x", "cell_y").agg(
        F.sum(F.col("_w") * F.col("_z")).alias("_wz"),
        F.sum("_w").alias("_ws"),
        F.avg(F.when(~near, F.col("_z"))).alias("_exact"),
        F.count(F.lit(1)).alias("points"),
    )
    est = F.coalesce(F.col("_exact"), F.try_divide(F.col("_wz"), F.col("_ws")))
    out = sums.select(*by, "cell_x", "cell_y", "points", est.alias("value"))
    # Nine decimals, so that the order of summing cannot move a value over a break.
    return out.withColumn("class", class_of(F.round("value", 9), breaks))
