"""Data-quality checks and the streaming operator (sections 2.13 and 2.14)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.rounding import round_even
from ..functions.nulls import recode
from ..operators import quality
from ..operators.windows import share_of_total
from ..plans import apportion
from ..session import scratch_dir
from ..streaming import weekly as stream
from .bindings import LANDINGS, SURVEY, landings, r, sql_round_even, survey
from .registry import query


@query(
    "dq_no_nulls_after_recode",
    f"WITH {LANDINGS} SELECT zone, count(*) AS rows FROM landings WHERE zone NOT IN ('WG', 'CG', 'WY') GROUP BY 1",
)
def _(t):
    coded = landings(t).withColumn("area", recode("zone", {"WG": "west", "CG": "central", "WY": "east"}))
    return quality.unmapped(coded, "zone", "area")


@query(
    "dq_keys_align",
    """WITH a AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), b AS (SELECT DISTINCT year(l_shipdate) + 2 AS y FROM lineitem)
       SELECT count(*) FILTER (a.y IS NOT NULL AND b.y IS NOT NULL) AS both, count(*) FILTER (b.y IS NULL) AS only_left, count(*) FILTER (a.y IS NULL) AS only_right FROM a FULL JOIN b ON a.y = b.y""",
)
def _(t):
    a = t.orders.select(F.year("o_orderdate").alias("year"))
    b = t.lineitem.select((F.year("l_shipdate") + 2).alias("year"))
    return quality.keys_align(a, b, ["year"])


@query(
    "dq_nonempty_query",
    """SELECT 'all' AS source, count(*) AS rows, count(*) > 0 AS ok FROM lineitem
       UNION ALL SELECT 'negative', count(*), count(*) > 0 FROM lineitem WHERE l_quantity < 0""",
)
def _(t):
    named = {"all": t.lineitem, "negative": t.lineitem.where("l_quantity < 0")}
    one, other = (quality.nonempty(d).select(F.lit(n).alias("source"), "rows", "ok") for n, d in named.items())
    return one.union(other)


# Shares as computed, and rounded to one digit, which need not sum to one.
@query(
    "dq_sums_to_one",
    f"""WITH {SURVEY}, s AS (SELECT year, biomass / sum(biomass) OVER (PARTITION BY year) AS share FROM survey),
        k AS (SELECT 'exact' AS kind, year, share FROM s UNION ALL SELECT 'rounded', year, round(share, 1) FROM s)
        SELECT kind, year, round(sum(share), 8) AS total, abs(sum(share) - 1) < 1e-9 AS ok FROM k GROUP BY ALL""",
)
def _(t):
    s = share_of_total(survey(t), ["year"], "biomass", "share").select("year", "share")
    both = s.withColumn("kind", F.lit("exact")).unionByName(s.select("year", r("share", 1).alias("share")).withColumn("kind", F.lit("rounded")))
    return quality.sums_to_one(both, ["kind", "year"], "share").withColumn("total", r("total", 8))


# Parts with the remainder added to one area, and as rounded, which need not add up.
@query(
    "dq_parts_equal_total",
    f"""WITH {SURVEY}, s AS (SELECT area, biomass / sum(biomass) OVER () AS share FROM survey WHERE year = 2000),
        a AS (SELECT CAST(y AS INTEGER) AS year_limit, abc, round_even(share * abc, 0) AS part, row_number() OVER (PARTITION BY y ORDER BY share DESC, area) AS rank FROM s, (VALUES (2001, 40503.0::DOUBLE), (2002, 41258.0::DOUBLE)) v(y, abc)),
        k AS (SELECT 'with remainder' AS kind, year_limit, abc, part + CASE WHEN rank = 1 THEN abc - sum(part) OVER (PARTITION BY year_limit) ELSE 0 END AS part FROM a
              UNION ALL SELECT 'rounded', year_limit, abc, part + rank FROM a)
        SELECT kind, year_limit, sum(part) AS parts, max(abc) AS total, sum(part) = max(abc) AS ok FROM k GROUP BY ALL""",
)
def _(t):
    s = survey(t).select(F.col("area").alias("strata"), "year", F.col("biomass").alias("estimate"))
    shares = apportion.area_shares(s, 2000).drop("year")
    parts = apportion.rounded_parts(shares, {2001: 40503.0, 2002: 41258.0}).select("year_limit", "strata", "abc", "area_abc")
    part = round_even(F.col("share") * F.col("abc"), 0)
    place = F.row_number().over(Window.partitionBy("year_limit").orderBy(F.col("share").desc(), "strata"))
    # The place is added so that this side never adds up.
    rounded = parts.join(shares, "strata").select("year_limit", "strata", "abc", (part + place).alias("area_abc"))
    both = parts.withColumn("kind", F.lit("with remainder")).unionByName(rounded.withColumn("kind", F.lit("rounded")))
    return quality.parts_equal_total(both, ["kind", "year_limit"], "area_abc", "abc")


@query(
    "dq_reconcile",
    f"""WITH n AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem WHERE l_suppkey <> 5 GROUP BY 1), o AS (SELECT l_suppkey, sum(l_quantity) + CASE WHEN l_suppkey % 7 = 0 THEN 0.001 ELSE 0.00001 END AS v FROM lineitem WHERE l_suppkey <> 8 GROUP BY 1),
       j AS (SELECT coalesce(n.l_suppkey, o.l_suppkey) AS l_suppkey, {sql_round_even('n.v', 4)} AS new_value, {sql_round_even('o.v', 4)} AS old_value, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' WHEN {sql_round_even('n.v', 4)} <> {sql_round_even('o.v', 4)} THEN 'changed' END AS status
             FROM n FULL JOIN o ON n.l_suppkey = o.l_suppkey) SELECT * FROM j WHERE status IS NOT NULL""",
)
def _(t):
    n = t.lineitem.where("l_suppkey <> 5").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    shift = F.when(F.col("l_suppkey") % 7 == 0, 0.001).otherwise(0.00001)
    o = t.lineitem.where("l_suppkey <> 8").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v")).withColumn("v", F.col("v") + shift)
    return quality.reconcile(n, o, ["l_suppkey"], "v")


@query(
    "dq_bins_present",
    "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, count(DISTINCT l_quantity) AS bins, count(DISTINCT l_quantity) = 50 AS ok FROM lineitem GROUP BY ALL",
)
def _(t):
    rows = t.lineitem.withColumn("year", F.year("l_shipdate"))
    return quality.bins_present(rows, ["year", "l_returnflag"], "l_quantity", 50)


STREAM_SQL = """SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type AS zone, round(sum(value), 4) AS catch, count(*) AS reports FROM events GROUP BY ALL"""


@query("stream_weekly_batch", STREAM_SQL)
def _(t):
    out = stream.weekly_totals(t.events, F.col("ts"), F.col("event_type"), F.col("value"))
    return out.withColumn("catch", r("catch", 4))


@query("stream_weekly_catch", STREAM_SQL)
def _(t):
    files = stream.stream_files(t.spark, t.folder, t.events.schema, glob="events.parquet")
    totals = stream.weekly_totals(files, F.col("ts"), F.col("event_type"), F.col("value"))
    base = scratch_dir(t.spark, "weekly")
    stream.run_to_table(totals, f"{base}/out", f"{base}/state")
    return stream.latest(t.spark, f"{base}/out").withColumn("catch", r("catch", 4))
