"""Joins, aggregates, windows, reshaping and set operations (sections 2.5 to 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import lenient_sum, strict_mean, strict_sum
from ..functions.rounding import round_away
from ..operators import aggregates as agg, joins, reshape, windows as win
from ..plans import scenarios
from .bindings import (
    GEARS,
    AREAS,
    LANDINGS,
    PRIORITIES,
    SURVEY,
    WEEKLY,
    YEARS,
    ZONES,
    draws,
    DRAWS,
    hauls_with_region,
    landings,
    r,
    survey,
    weekly,
)
from .registry import query

# --- joins ------------------------------------------------------------------


@query(
    "join_inner",
    """SELECT o_orderkey, l_linenumber, o_custkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    o = t.orders.select("o_orderkey", "o_custkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    "join_inner_multi3",
    """SELECT o_orderkey, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    return hauls_with_region(t).select("o_orderkey", "n_name", "r_name", "o_totalprice")


@query(
    "join_inner_composite",
    """SELECT CAST(year(a.l_shipdate) AS INTEGER) AS year, a.l_returnflag, count(*) AS n, sum(b.catch) AS frequency
       FROM lineitem a JOIN (SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity) AS catch FROM lineitem GROUP BY ALL) b
         ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = b.l_returnflag
       WHERE a.l_returnflag IN ('A', 'R') GROUP BY ALL""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_returnflag"]
    fishlen = t.lineitem.where(F.col("l_returnflag").isin("A", "R")).select(*keys, "l_shipdate")
    catch = t.lineitem.groupBy(*keys).agg(F.sum("l_quantity").alias("catch"))
    j = fishlen.join(catch, keys)
    return j.groupBy(F.year("l_shipdate").alias("year"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("catch").alias("frequency")
    )


@query(
    "join_left",
    """SELECT c_custkey, c_mktsegment, o_orderkey FROM customer
       LEFT JOIN orders ON c_custkey = o_custkey * 2""",
)
def _(t):
    # Doubled keys leave customers without an order.
    o = t.orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    return t.customer.select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left")


@query(
    "join_right",
    """SELECT s_suppkey, s_name, q FROM (SELECT l_suppkey * 2 AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
       RIGHT JOIN supplier ON k = s_suppkey""",
)
def _(t):
    q = t.lineitem.groupBy((F.col("l_suppkey") * 2).alias("s_suppkey")).agg(F.sum("l_quantity").alias("q"))
    return q.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", "right")


@query(
    "join_full_outer",
    """WITH a AS (SELECT CASE WHEN year(o_orderdate) < 2000 THEN CAST(year(o_orderdate) + 1 AS INTEGER) END AS year, round(sum(o_totalprice), 2) AS target_wt
                  FROM orders GROUP BY 1),
            b AS (SELECT CASE WHEN year(l_shipdate) < 2000 THEN CAST(year(l_shipdate) AS INTEGER) END AS year, round(sum(l_extendedprice), 2) AS all_wt
                  FROM lineitem GROUP BY 1)
       SELECT coalesce(a.year, b.year) AS year, target_wt, all_wt, coalesce(target_wt, all_wt) AS weight
       FROM a FULL JOIN b ON a.year IS NOT DISTINCT FROM b.year""",
)
def _(t):
    # Late years fold into a null key; the shift leaves years without a partner on both sides.
    def folded(c, shift=0):
        y = F.year(c)
        return F.when(y < 2000, y + shift).alias("year")

    a = t.orders.groupBy(folded("o_orderdate", 1)).agg(
        round_away(F.sum("o_totalprice"), 2).alias("target_wt")
    )
    b = t.lineitem.groupBy(folded("l_shipdate")).agg(
        round_away(F.sum("l_extendedprice"), 2).alias("all_wt")
    )
    j = joins.null_safe_join(a, b, ["year"], "full_outer")
    return j.withColumn("weight", F.coalesce("target_wt", "all_wt"))


@query(
    "join_group_total",
    "SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS nsamp FROM lineitem",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    return win.group_value(rows, ["l_suppkey"], F.sum("l_quantity"), "nsamp").drop("l_suppkey")


@query(
    "join_positional",
    """WITH a AS (SELECT CAST(year(o_orderdate) + 1 AS INTEGER) AS year, count(*) AS n_orders FROM orders GROUP BY 1),
            b AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_lines FROM lineitem GROUP BY 1)
       SELECT coalesce(a.year, b.year) AS year, n_orders, n_lines, a.year IS NOT NULL AND b.year IS NOT NULL AS aligned
       FROM a FULL JOIN b ON a.year = b.year""",
)
def _(t):
    a = t.orders.groupBy((F.year("o_orderdate") + 1).alias("year")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    b = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n_lines"))
    return joins.aligned_join(a, b, ["year"])


@query(
    "join_semi_anti_other",
    """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS q FROM lineitem GROUP BY 1),
            top AS (SELECT l_suppkey FROM m QUALIFY rank() OVER (ORDER BY q DESC) <= 3)
       SELECT CASE WHEN l_suppkey IN (SELECT l_suppkey FROM top) THEN 'S' || l_suppkey ELSE 'Other' END AS source,
              sum(l_quantity) AS tons FROM lineitem GROUP BY 1""",
)
def _(t):
    # One summary per supplier gives both the means and the totals to relabel.
    name = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source")
    per = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.avg("l_quantity").alias("mean"))
    top = win.top_with_ties(per.select("l_suppkey", "mean", F.lit(1).alias("g")), ["g"], "mean", 3)
    sums = per.select("l_suppkey", name, "q")
    named = joins.relabel_unlisted(sums, top, ["l_suppkey"], "source", "Other")
    return named.groupBy("source").agg(F.sum("q").alias("tons"))


@query(
    "join_cross_grid",
    """WITH m AS (SELECT o_orderpriority AS model, avg(o_totalprice) / 100000 AS base FROM orders GROUP BY 1)
       SELECT model, i AS q, j AS m, round((base - i) * (base - i) + (base - j / 2.0) * (base - j / 2.0), 6) AS nll
       FROM m, (SELECT unnest(generate_series(1, 10)) AS i), (SELECT unnest(generate_series(1, 10)) AS j)""",
)
def _(t):
    base = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(
        (F.avg("o_totalprice") / 100000).alias("base")
    )
    one_to_ten = F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))
    grid = joins.expand_grid(base, q=one_to_ten, m=one_to_ten)
    b, q, m = F.col("base"), F.col("q"), F.col("m") / 2.0
    return grid.select("model", "q", "m", r((b - q) * (b - q) + (b - m) * (b - m)).alias("nll"))


@query(
    "join_lookup_scalar",
    f"""WITH {SURVEY}, frac AS (SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS west FROM orders)
        SELECT year, area, round(biomass * west, 2) AS west, round(biomass * (1 - west), 2) AS east FROM survey, frac""",
)
def _(t):
    frac = t.orders.agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("f"))
    s = joins.with_scalar(survey(t), frac, "f")
    return s.select(
        "year", "area", r(F.col("biomass") * F.col("f"), 2).alias("west"), r(F.col("biomass") * (1 - F.col("f")), 2).alias("east")
    )


# --- aggregates -------------------------------------------------------------


@query("agg_sum_by_key", f"WITH {LANDINGS} SELECT year, zone, type, gear, sum(tons) AS tons FROM landings GROUP BY ALL")
def _(t):
    return agg.sum_by(landings(t), ["year", "zone", "type", "gear"], "tons", "tons", strict=True)


@query(
    "agg_sum_null_rules",
    """WITH x AS (SELECT l_suppkey, CASE WHEN l_quantity > 1 OR l_suppkey > 50 THEN l_quantity END AS q,
                         CASE WHEN l_suppkey > 20 THEN l_quantity END AS z FROM lineitem)
       SELECT l_suppkey, CASE WHEN count(q) = count(*) THEN sum(q) END AS strict, coalesce(sum(z), 0.0) AS lenient,
              round(CASE WHEN count(q) = count(*) THEN avg(q) END, 6) AS strict_mean FROM x GROUP BY 1""",
)
def _(t):
    q, s = F.col("l_quantity"), F.col("l_suppkey")
    x = t.lineitem.select("l_suppkey", F.when((q > 1) | (s > 50), q).alias("q"), F.when(s > 20, q).alias("z"))
    return x.groupBy("l_suppkey").agg(
        strict_sum("q").alias("strict"), lenient_sum("z").alias("lenient"), r(strict_mean("q")).alias("strict_mean")
    )


@query("agg_mean_by_key", f"WITH {LANDINGS} SELECT gear, year, round(avg(tons), 6) AS mt FROM landings GROUP BY ALL")
def _(t):
    return landings(t).groupBy("gear", "year").agg(r(F.avg("tons")).alias("mt"))


@query("agg_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_count_distinct",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS nhaul FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count_distinct("l_orderkey").alias("nhaul"))


@query("agg_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").distinct()


@query(
    "agg_median_quantiles",
    """SELECT l_returnflag, l_suppkey % 7 AS grp, round(quantile_cont(l_extendedprice, 0.5), 4) AS med,
              round(quantile_cont(l_extendedprice, 0.1), 4) AS lwr, round(quantile_cont(l_extendedprice, 0.9), 4) AS upr
       FROM lineitem GROUP BY ALL""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", (F.col("l_suppkey") % 7).alias("grp"), "l_extendedprice")
    q = agg.exact_quantiles(rows, ["l_returnflag", "grp"], "l_extendedprice", {"med": 0.5, "lwr": 0.1, "upr": 0.9})
    return q.select("l_returnflag", "grp", r("med", 4).alias("med"), r("lwr", 4).alias("lwr"), r("upr", 4).alias("upr"))


@query(
    "agg_mean_sd",
    """SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd,
              round(avg(l_quantity) + stddev_samp(l_quantity), 6) AS mean_plus_sd FROM lineitem GROUP BY 1""",
)
def _(t):
    out = scenarios.mean_spread(t.lineitem, ["l_suppkey"], "l_quantity")
    return out.select("l_suppkey", *[r(c).alias(c) for c in ("mean", "sd", "mean_plus_sd")])


@query(
    "agg_min_max",
    """SELECT CASE WHEN year(l_shipdate) < 1998 THEN 'early' ELSE 'late' END AS era, min(l_extendedprice) AS lo,
              max(l_extendedprice) AS hi FROM lineitem GROUP BY 1""",
)
def _(t):
    era = F.when(F.year("l_shipdate") < 1998, "early").otherwise("late").alias("era")
    return t.lineitem.groupBy(era).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query(
    "agg_mean_of_sums",
    f"WITH {LANDINGS}, s AS (SELECT zone, year, sum(tons) AS s FROM landings GROUP BY ALL) SELECT zone, round(avg(s), 6) AS catch FROM s GROUP BY 1",
)
def _(t):
    return agg.mean_of_sums(landings(t), ["year"], ["zone"], "tons", "catch").select("zone", r("catch").alias("catch"))


@query(
    "agg_var_additive",
    f"""WITH {SURVEY} SELECT year, round(sum(biomass), 2) AS total, round(sqrt(sum(variance)) / sum(biomass), 8) AS total_cv
        FROM survey GROUP BY year""",
)
def _(t):
    out = agg.additive_variance(survey(t), ["year"], "biomass", "variance", "total")
    return out.select("year", r("total", 2).alias("total"), r("total_cv", 8).alias("total_cv"))


@query(
    "agg_sum_by_formula",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS bin, round(sum(o_totalprice), 2) AS pop
       FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""",
)
def _(t):
    rows = t.orders.select(
        F.year("o_orderdate").alias("year"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("bin"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("pop"),
    ).dropna()
    return rows.groupBy("year", "bin").agg(r(F.sum("pop"), 2).alias("pop"))


@query(
    "agg_row_sums",
    f"""WITH {LANDINGS} SELECT year, zone, coalesce(sum(tons), 0.0) AS nsamp
        FROM landings GROUP BY ALL""",
)
def _(t):
    from ..functions.nulls import row_sum

    gears = sorted(set(GEARS))
    wide = reshape.pivot_wide(landings(t), ["year", "zone"], "gear", "tons", gears, combine="sum")
    return wide.select("year", "zone", row_sum(*gears, skip_null=True).alias("nsamp"))


@query(
    "agg_conditional_sum",
    f"""WITH {LANDINGS} SELECT year, round(1 - sum(CASE WHEN type = 'D' THEN tons ELSE 0 END) / sum(tons), 6) AS retained
        FROM landings GROUP BY year""",
)
def _(t):
    d = F.sum(F.when(F.col("type") == "D", F.col("tons")).otherwise(0.0))
    return landings(t).groupBy("year").agg(r(1 - d / F.sum("tons")).alias("retained"))


@query(
    "agg_crosstab",
    "SELECT o_orderstatus AS reader, "
    + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in PRIORITIES)
    + " FROM orders GROUP BY 1",
)
def _(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("reader"), "o_orderpriority")
    return agg.crosstab(rows, "reader", "o_orderpriority", PRIORITIES)


@query(
    "agg_count_not_sentinel",
    "SELECT event_type, count(*) FILTER (CASE WHEN value < 5 THEN -999 ELSE value END <> -999) AS n FROM events GROUP BY 1",
)
def _(t):
    coded = F.when(F.col("value") < 5, F.lit(-999.0)).otherwise(F.col("value"))
    return t.events.groupBy("event_type").agg(F.count_if(coded != -999.0).alias("n"))


@query(
    "agg_dupe_collapse",
    """SELECT l_quantity, l_discount, l_returnflag, count(*) AS dupe_count FROM lineitem GROUP BY ALL HAVING count(*) >= 2""",
)
def _(t):
    return agg.count_identical(t.lineitem, ["l_quantity", "l_discount", "l_returnflag"], 2)


@query(
    "agg_cte_ratio",
    """WITH f AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS species, round(sum(l_quantity), 2) AS target_wt FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
            g AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS species, round(sum(l_quantity), 2) AS all_wt FROM lineitem GROUP BY ALL)
       SELECT g.year, g.species, target_wt, all_wt, round(target_wt / all_wt, 2) AS prop FROM f FULL JOIN g ON f.species = g.species AND f.year = g.year""",
)
def _(t):
    rows = t.lineitem.select(
        F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("species"), "l_returnflag", "l_quantity"
    )
    return agg.target_share(
        rows, ["year", "species"], F.col("l_returnflag") == "R", "l_quantity", "target_wt", "all_wt", "prop"
    )


@query(
    "agg_argmin",
    """WITH m AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS nll FROM lineitem GROUP BY ALL)
       SELECT l_suppkey, nll, year FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY nll, year) = 1""",
)
def _(t):
    m = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("nll"))
    return agg.arg_min(m, ["l_suppkey"], "nll", ["year"])


# --- windows ----------------------------------------------------------------


@query(
    "win_share_of_total",
    f"""WITH {SURVEY} SELECT year, area, round(biomass / sum(biomass) OVER (PARTITION BY year), 8) AS share FROM survey""",
)
def _(t):
    return win.share_of_total(survey(t), ["year"], "biomass", "share").select("year", "area", r("share", 8).alias("share"))


@query(
    "win_cumsum_share",
    f"""WITH {WEEKLY}, w AS (SELECT year, week, sum(catch) AS catch FROM weekly GROUP BY ALL)
        SELECT year, week, round(sum(catch) OVER x, 2) AS cumulative_catch,
               round(sum(catch) OVER x / sum(catch) OVER (PARTITION BY year), 8) AS cumulative_share
        FROM w WINDOW x AS (PARTITION BY year ORDER BY week)""",
)
def _(t):
    w = weekly(t).groupBy("year", "week").agg(F.sum("catch").alias("catch"))
    out = win.ranged_running_sum(w, ["year"], ["week"], "catch", "cumulative_catch", share="cumulative_share")
    return out.select(
        "year", "week", r("cumulative_catch", 2).alias("cumulative_catch"), r("cumulative_share", 8).alias("cumulative_share")
    )


@query(
    "win_row_number",
    """WITH s AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_suppkey, q, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_suppkey) AS INTEGER) AS row FROM s""",
)
def _(t):
    s = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    out = win.ranged_row_number(s, ["l_returnflag"], [F.col("q").desc(), "l_suppkey"])
    return out.withColumn("row", F.col("row").cast("int"))


LOCF_SQL = """WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL),
     x AS (SELECT o_orderpriority, day, CASE WHEN n % 3 = 0 THEN n END AS n FROM s)
     SELECT o_orderpriority, day, last_value(n IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY day) AS n FROM x"""


def _sparse_days(t):
    s = t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("n", F.when(F.col("n") % 3 == 0, F.col("n")))


@query("win_locf", LOCF_SQL)
def _(t):
    return win.carry_forward(_sparse_days(t), ["o_orderpriority"], ["day"], ["n"])


@query("win_locf_chunked", LOCF_SQL)
def _(t):
    x = _sparse_days(t).withColumn("chunk", F.trunc("day", "quarter"))
    return win.carry_forward_chunked(x, ["o_orderpriority"], "chunk", ["day"], ["n"]).drop("chunk")


@query(
    "win_rescale_min",
    f"""WITH {SURVEY} SELECT year, area, round(biomass - min(biomass) OVER (PARTITION BY area), 2) AS delta FROM survey""",
)
def _(t):
    return win.rescale_min(survey(t), ["area"], "biomass", "delta").select("year", "area", r("delta", 2).alias("delta"))


@query(
    "win_topn_ties",
    """WITH s AS (SELECT l_returnflag, l_suppkey, max(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_suppkey, n FROM s QUALIFY rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) <= 3""",
)
def _(t):
    s = t.lineitem.groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return win.top_with_ties(s, ["l_returnflag"], "n", 3)


@query(
    "win_trailing_mean",
    f"""WITH {LANDINGS}, s AS (SELECT zone, year, sum(tons) AS tons FROM landings GROUP BY ALL)
        SELECT zone, year, round(avg(tons) OVER (PARTITION BY zone ORDER BY year RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS mean5 FROM s""",
)
def _(t):
    s = landings(t).groupBy("zone", "year").agg(F.sum("tons").alias("tons"))
    return win.ranged_trailing_mean(s, ["zone"], "year", "tons", 5, "mean5").select("zone", "year", r("mean5").alias("mean5"))


# --- sorts, limits, reshape, sets -------------------------------------------


@query("sort_multi", f"WITH {LANDINGS} SELECT year, zone, sum(tons) AS tons FROM landings GROUP BY ALL ORDER BY year, tons DESC, zone")
def _(t):
    s = landings(t).groupBy("year", "zone").agg(F.sum("tons").alias("tons"))
    return s.orderBy(F.asc_nulls_last("year"), F.desc_nulls_last("tons"), F.asc_nulls_last("zone"))


@query(
    "sort_numeric_text",
    "SELECT CAST(p_size AS VARCHAR) AS age, count(*) AS n FROM part GROUP BY 1 ORDER BY TRY_CAST(age AS INTEGER)",
)
def _(t):
    s = t.part.groupBy(F.col("p_size").cast("string").alias("age")).agg(F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.col("age").try_cast("int").asc_nulls_last())


@query(
    "limit_head_tail",
    """(SELECT 'tail' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)
       UNION ALL (SELECT 'head', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 6)""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    tail = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6).select(F.lit("tail").alias("part"), "*")
    head = o.orderBy("o_totalprice", "o_orderkey").limit(6).select(F.lit("head").alias("part"), "*")
    return tail.unionByName(head)


@query(
    "sort_custom_items",
    f"""WITH {DRAWS}, m AS (SELECT alternative, round(avg(ssb), 4) AS value FROM draws GROUP BY 1),
        items(alternative, ord, label) AS (VALUES ('view', 1, 'First'), ('click', 2, 'Second'), ('view', 3, 'Again'))
        SELECT m.alternative, value, ord, label FROM m JOIN items USING (alternative)""",
)
def _(t):
    m = draws(t).groupBy("alternative").agg(r(F.avg("ssb"), 4).alias("value"))
    return reshape.order_by_items(m, "alternative", [("view", "First"), ("click", "Second"), ("view", "Again")])


@query(
    "reshape_pivot",
    f"WITH {LANDINGS}, s AS (SELECT year, zone, sum(tons) AS tons FROM landings GROUP BY ALL) SELECT year, "
    + ", ".join(f"max(CASE WHEN zone = '{z}' THEN tons END) AS {z}" for z in ZONES)
    + " FROM s GROUP BY year",
)
def _(t):
    return reshape.pivot_wide(landings(t), ["year"], "zone", "tons", ZONES, combine="sum")


@query(
    "reshape_pivot_multi",
    f"WITH {SURVEY} SELECT year, "
    + ", ".join(
        f"round(max(CASE WHEN area = '{a}' THEN biomass END), 2) AS \"{a}_obs\", "
        f"round(max(CASE WHEN area = '{a}' THEN sqrt(variance) / biomass END), 8) AS \"{a}_cv\""
        for a in AREAS
    )
    + " FROM survey GROUP BY year",
)
def _(t):
    s = survey(t).select(
        "year", "area", r("biomass", 2).alias("obs"), r(F.sqrt("variance") / F.col("biomass"), 8).alias("cv")
    )
    return reshape.pivot_wide(s, ["year"], "area", {"obs": "obs", "cv": "cv"}, AREAS, label="{level}_{value}")


@query(
    "reshape_pivot_fill",
    "SELECT o_custkey, "
    + ", ".join(f"coalesce(max(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), -999.0) AS \"{p}\"" for p in PRIORITIES)
    + " FROM orders GROUP BY 1",
)
def _(t):
    return reshape.pivot_wide(t.orders, ["o_custkey"], "o_orderpriority", "o_totalprice", PRIORITIES, combine="max", fill=-999.0)


@query(
    "reshape_pivot_multikey",
    f"WITH {LANDINGS} SELECT year, "
    + ", ".join(f"sum(CASE WHEN zone = '{z}' AND type = '{k}' THEN tons END) AS {z}_{k}" for z in ZONES for k in ("D", "R"))
    + " FROM landings GROUP BY year",
)
def _(t):
    levels = [f"{z}_{k}" for z in ZONES for k in ("D", "R")]
    return reshape.pivot_wide(
        landings(t), ["year"], F.concat_ws("_", "zone", "type"), "tons", levels, combine="sum"
    )


@query(
    "reshape_unpivot",
    """SELECT o_orderkey, variable, value FROM (SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS customer FROM orders)
       UNPIVOT INCLUDE NULLS (value FOR variable IN (price, customer))""",
)
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return reshape.unpivot_long(o, ["o_orderkey"], ["price", "customer"])


@query(
    "reshape_unpivot_paired",
    """SELECT o_orderkey, 'reader1' AS reader, o_custkey % 30 AS age, o_orderpriority AS name FROM orders
       UNION ALL SELECT o_orderkey, 'reader2', o_custkey % 29, o_orderstatus FROM orders""",
)
def _(t):
    o = t.orders.select(
        "o_orderkey",
        (F.col("o_custkey") % 30).alias("age1"),
        (F.col("o_custkey") % 29).alias("age2"),
        F.col("o_orderpriority").alias("name1"),
        F.col("o_orderstatus").alias("name2"),
    )
    groups = {"reader1": {"age": "age1", "name": "name1"}, "reader2": {"age": "age2", "name": "name2"}}
    return reshape.unpivot_pairs(o, ["o_orderkey"], groups, "reader")


@query(
    "reshape_transpose",
    f"WITH {LANDINGS}, s AS (SELECT year, sum(tons) AS tons, CAST(count(*) AS DOUBLE) AS n FROM landings GROUP BY 1), l AS (SELECT year, 'tons' AS item, tons AS v FROM s UNION ALL SELECT year, 'n', n FROM s) SELECT item, "
    + ", ".join(f"max(CASE WHEN year = {y} THEN v END) AS \"{y}\"" for y in YEARS)
    + " FROM l GROUP BY item",
)
def _(t):
    s = landings(t).groupBy("year").agg(F.sum("tons").alias("tons"), F.count(F.lit(1)).cast("double").alias("n"))
    return reshape.transpose(s, "year", ["tons", "n"], YEARS)


@query(
    "reshape_dcast_compose",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, "
    + ", ".join(
        f"sum(CASE WHEN l_linestatus = '{s}' AND l_linenumber = {a} THEN l_quantity ELSE 0.0 END) AS \"{p}{a}\""
        for s, p in (("F", ""), ("O", "10"))
        for a in range(1, 8)
    )
    + " FROM lineitem GROUP BY 1",
)
def _(t):
    rows = t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        F.concat(
            F.when(F.col("l_linestatus") == "O", "10").otherwise(""), F.format_string("%d", "l_linenumber")
        ).alias("key"),
        "l_quantity",
    )
    levels = [f"{p}{a}" for p in ("", "10") for a in range(1, 8)]
    return reshape.pivot_wide(rows, ["year"], "key", "l_quantity", levels, combine="sum", fill=0.0)


@query(
    "set_union_all",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS value, 'line' AS src FROM lineitem
       UNION ALL SELECT CAST(year(o_orderdate) AS INTEGER), o_totalprice, 'order' FROM orders""",
)
def _(t):
    a = t.lineitem.select(F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("value"), F.lit("line").alias("src"))
    b = t.orders.select(F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"), F.lit("order").alias("src"))
    return reshape.union_all(a, b)


@query(
    "set_union_by_name",
    "SELECT c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    return reshape.union_fill(a, b)


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey * 2 FROM orders")
def _(t):
    return reshape.values_not_in(t.customer, t.orders.select((F.col("o_custkey") * 2).alias("c_custkey")), "c_custkey")


@query(
    "set_missing_years",
    """WITH b AS (SELECT o_orderpriority AS src, min(year(o_orderdate)) - 3 AS lo, max(year(o_orderdate)) + 2 AS hi FROM orders GROUP BY 1),
            s AS (SELECT src, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS year FROM b)
       SELECT src, year FROM s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = s.src AND year(o_orderdate) = s.year)""",
)
def _(t):
    o = t.orders.select(F.col("o_orderpriority").alias("src"), F.year("o_orderdate").alias("year"))
    ends = o.groupBy("src").agg((F.min("year") - 3).alias("lo"), (F.max("year") + 2).alias("hi"))
    spine = reshape.year_spine(ends, "lo", "hi").select("src", "year")
    return reshape.missing_from_spine(spine, o, ["src", "year"])


@query(
    "grid_complete",
    """WITH s AS (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, sum(l_quantity) AS tons FROM lineitem GROUP BY ALL),
            g AS (SELECT a.l_suppkey, b.year, c.f AS l_returnflag FROM (SELECT DISTINCT l_suppkey FROM s) a, (SELECT DISTINCT year FROM s) b, (SELECT unnest(['A','N','R']) AS f) c)
       SELECT l_suppkey, year, l_returnflag, coalesce(tons, 0.0) AS tons FROM g LEFT JOIN s USING (l_suppkey, year, l_returnflag)""",
)
def _(t):
    s = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag").agg(
        F.sum("l_quantity").alias("tons")
    )
    return reshape.complete_grid(s, ["l_suppkey"], {"year": None, "l_returnflag": ["A", "N", "R"]}, {"tons": 0.0})


@query(
    "grid_full_seq",
    """WITH s AS (SELECT l_suppkey, CAST(floor(l_extendedprice / 500) * 2 AS INTEGER) AS bin, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
            g AS (SELECT l_suppkey, CAST(unnest(generate_series(min(bin), max(bin), 2)) AS INTEGER) AS bin FROM s GROUP BY 1)
       SELECT l_suppkey, bin, coalesce(n, 0.0) AS n FROM g LEFT JOIN s USING (l_suppkey, bin)""",
)
def _(t):
    s = t.lineitem.groupBy("l_suppkey", (F.floor(F.col("l_extendedprice") / 500) * 2).cast("int").alias("bin")).agg(
        F.sum("l_quantity").alias("n")
    )
    return reshape.full_sequence(s, ["l_suppkey"], "bin", 2).join(s, ["l_suppkey", "bin"], "left").fillna({"n": 0.0})


