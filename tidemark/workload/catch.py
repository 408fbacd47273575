"""Catch computations (section 2.10)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..plans import catch
from .bindings import LANDINGS, WEEKLY, landings, pick, r, sql_pick, sql_round_even, weekly
from .registry import query

AS_OF = dt.date(2000, 8, 9)
AS_OF_WEEK = (AS_OF.timetuple().tm_yday - 1) // 7 + 1


@query(
    "catch_by_area_wide",
    f"""WITH {LANDINGS}, a AS (SELECT year, sum(CASE WHEN zone = 'WG' THEN tons END) AS western, sum(CASE WHEN zone = 'CG' THEN tons END) AS central,
          coalesce(sum(CASE WHEN zone IN ('WY','EY','SE') THEN tons END), 0.0) AS eastern FROM landings GROUP BY year)
        SELECT year, western, central, eastern, western + central + eastern AS total FROM a""",
)
def _(t):
    return catch.catch_by_area(landings(t), F.col("year"), F.col("zone"), F.col("tons"))


@query(
    "catch_area_rollup",
    f"""WITH {LANDINGS} SELECT year, zone AS area, sum(tons) AS tons FROM landings GROUP BY ROLLUP(year, zone) HAVING year IS NOT NULL""",
)
def _(t):
    return catch.catch_area_rollup(landings(t), F.col("year"), F.col("zone"), F.col("tons"))


@query(
    "catch_history_splice",
    f"""WITH {LANDINGS}, c AS (SELECT year, sum(tons) AS catch FROM landings GROUP BY 1),
        o AS (SELECT CAST(year(o_orderdate) - 1 AS INTEGER) AS year, sum(o_totalprice) / 1000 AS catch FROM orders GROUP BY 1)
        SELECT coalesce(c.year, o.year) AS year, 1 AS seas, 1 AS fleet, {sql_round_even('coalesce(c.catch, o.catch)', 2)} AS catch_mt, 0.01::DOUBLE AS catch_se
        FROM c FULL JOIN (SELECT * FROM o WHERE year < 1999) o ON c.year = o.year""",
)
def _(t):
    # The older series is a year earlier, so each series has a year of its own.
    c = landings(t).groupBy("year").agg(F.sum("tons").alias("catch"))
    o = t.orders.groupBy((F.year("o_orderdate") - 1).alias("year")).agg((F.sum("o_totalprice") / 1000).alias("catch"))
    return catch.splice_history(c, o, 1999)


def _to_date(t):
    return weekly(t).where((F.col("year") == AS_OF.year) & (F.col("week") <= AS_OF_WEEK)).groupBy("species").agg(
        F.sum("catch").alias("catch")
    )


INSEASON = f"""{WEEKLY},
  td AS (SELECT species, sum(catch) AS catch FROM weekly WHERE year = {AS_OF.year} AND week <= {AS_OF_WEEK} GROUP BY 1),
  py AS (SELECT species, year, sum(catch) AS c FROM weekly WHERE week > {AS_OF_WEEK} AND year >= {AS_OF.year - 5} GROUP BY ALL),
  rest AS (SELECT species, avg(c) AS add FROM py GROUP BY 1),
  est AS (SELECT td.species, catch, add, round_even(catch + add, 0) AS predicted, {sql_round_even('(catch + add) / catch', 2)} AS factor FROM td LEFT JOIN rest USING (species))"""


@query(
    "catch_inseason_extrapolate",
    f"""WITH {INSEASON} SELECT species, round(catch, 2) AS catch_to_date, round(add, 4) AS catch_to_add, predicted AS predicted_catch, factor AS expansion_factor FROM est""",
)
def _(t):
    out = catch.inseason_estimate(weekly(t), _to_date(t), AS_OF, by=["species"])
    return out.select(
        "species", r("catch_to_date", 2).alias("catch_to_date"), r("catch_to_add", 4).alias("catch_to_add"), "predicted_catch", "expansion_factor"
    )


@query(
    "catch_projection_vector",
    f"""WITH {INSEASON}, an AS (SELECT species, year, sum(catch) AS catch FROM weekly GROUP BY ALL),
        w AS (SELECT species, avg(catch) FILTER (year BETWEEN 1995 AND 1999) AS m, max(catch) FILTER (year = 1998) AS y0, max(catch) FILTER (year = 1999) AS y1 FROM an GROUP BY 1)
        SELECT species, CAST(1998 + i AS INTEGER) AS year, round(CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN predicted ELSE m END, 2) AS catch,
               CASE WHEN i < 2 THEN 'observed' WHEN i = 2 THEN 'estimated' ELSE 'mean' END AS source
        FROM w JOIN est USING (species), (SELECT unnest(generate_series(0, 4)) AS i)""",
)
def _(t):
    annual = weekly(t).groupBy("species", "year").agg(F.sum("catch").alias("catch"))
    est = catch.inseason_estimate(weekly(t), _to_date(t), AS_OF, by=["species"]).select("species", "predicted_catch")
    out = catch.projection_vector(annual, est, AS_OF.year, by=["species"])
    return out.select("species", "year", r("catch", 2).alias("catch"), "source")


@query(
    "catch_gear_zone_type",
    f"""WITH {LANDINGS} SELECT year, zone, type, gear, sum(tons) AS tons, gear || CASE WHEN type = 'D' THEN ' Discarded' ELSE ' Retained' END AS label
        FROM landings WHERE gear NOT IN ('JIG', 'OTH') GROUP BY ALL""",
)
def _(t):
    c = F.col
    return catch.gear_zone_type(landings(t), c("year"), c("zone"), c("gear"), c("type"), c("tons"), ["JIG", "OTH"])


KINDS = ["OFL", "ABC", "TAC", "Catch"]
LIMITS = f"""limits AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {sql_pick(KINDS, 'l_suppkey % 4')} AS kind, sum(l_quantity) * 3 AS value FROM lineitem GROUP BY ALL)"""


def _limits(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year"), pick(KINDS, F.col("l_suppkey") % 4).alias("kind")).agg(
        (F.sum("l_quantity") * 3).alias("value")
    )


@query(
    "catch_retention_table",
    f"""WITH {LANDINGS}, {LIMITS}, d AS (SELECT year, sum(tons) AS disc FROM landings WHERE type = 'D' GROUP BY 1),
        w AS (SELECT year, max(value) FILTER (kind = 'OFL') AS OFL, max(value) FILTER (kind = 'ABC') AS ABC, max(value) FILTER (kind = 'TAC') AS TAC, max(value) FILTER (kind = 'Catch') AS c FROM limits GROUP BY 1)
        SELECT year, OFL, ABC, TAC, round_even(c, 0) AS total_catch, 100.0::DOUBLE * {sql_round_even('1 - disc / c', 2)} AS percent_retained FROM d JOIN w USING (year)""",
)
def _(t):
    d = landings(t).where("type = 'D'").groupBy("year").agg(F.sum("tons").alias("discarded"))
    return catch.retention_table(d, _limits(t))


@query(
    "catch_vs_limits",
    f"""WITH {LIMITS}, c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS v FROM orders WHERE year(o_orderdate) > 1996 GROUP BY 1),
        p AS (SELECT CAST(year(o_orderdate) AS INTEGER) + 3 AS year, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1),
        w AS (SELECT year, max(value) FILTER (kind = 'TAC') AS TAC, max(value) FILTER (kind = 'ABC') AS ABC FROM limits GROUP BY 1),
        j AS (SELECT coalesce(w.year, p.year) AS year, TAC, ABC, c.v AS catch_model, p.v AS catch_projection FROM w LEFT JOIN c ON w.year = c.year FULL JOIN p ON w.year = p.year)
        SELECT year, variable, value FROM j UNPIVOT INCLUDE NULLS (value FOR variable IN (TAC, ABC, catch_model, catch_projection))""",
)
def _(t):
    printed = _limits(t).where("kind <> 'Catch'").select("year", "kind", F.format_number("value", 0).alias("text"))
    y = F.year("o_orderdate")
    model = t.orders.where(y > 1996).groupBy(y.alias("year")).agg(r(F.sum("o_totalprice"), 2).alias("catch"))
    extra = t.orders.groupBy((y + 3).alias("year")).agg(F.count(F.lit(1)).cast("double").alias("catch"))
    return catch.limits_with_catch(printed, model, extra)


@query(
    "catch_weekly_by_zone",
    """WITH w AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS z, sum(o_totalprice) AS c FROM orders GROUP BY ALL)
        SELECT year, round(sum(c), 2) AS total_catch, round(sum(c) FILTER (z = '1-URGENT'), 2) AS WG, round(sum(c) FILTER (z IN ('2-HIGH', '5-LOW')), 2) AS CG,
               round(sum(c) FILTER (z IN ('3-MEDIUM', '4-NOT SPECIFIED')), 2) AS EG FROM w GROUP BY year""",
)
def _(t):
    label = F.concat("o_orderpriority", F.lit(" orders"))
    w = catch.weekly_from_dates(t.orders, F.col("o_orderdate"), F.col("o_totalprice"), {"species": label})
    zones = {"1-URGENT": "west", "2-HIGH": "central", "3-MEDIUM": "yakutat", "4-NOTSPECIFIED": "southeast", "5-LOW": "central"}
    out = catch.weekly_by_zone(w, None, " orders", zones, "central", "west")
    return out.select("year", *[r(c, 2).alias(c) for c in ("total_catch", "WG", "CG", "EG")])


def _removals(t):
    return t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "A", "ADFG").otherwise("IPHC").alias("agency"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 6).cast("string")).alias("source"),
        F.col("l_linestatus").alias("area"),
        F.col("l_extendedprice").alias("kg"),
    )


REMOVALS = """rem AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_returnflag = 'A' THEN 'ADFG' ELSE 'IPHC' END AS agency, 'S' || (l_suppkey % 6) AS source,
          l_linestatus AS area, l_extendedprice AS kg FROM lineitem),
        top AS (SELECT source FROM (SELECT source, avg(kg) AS m FROM rem WHERE agency = 'ADFG' GROUP BY 1) QUALIFY rank() OVER (ORDER BY m DESC) <= 3),
        lab AS (SELECT year, agency, CASE WHEN agency = 'ADFG' AND source NOT IN (SELECT source FROM top) THEN 'Other' ELSE source END AS source, kg FROM rem WHERE area = 'F')"""


@query(
    "catch_noncommercial_top",
    f"WITH {REMOVALS} SELECT year, agency, source, {sql_round_even('round(sum(kg), 6) / 1000.0', 3)} AS tons FROM lab GROUP BY ALL",
)
def _(t):
    return catch.noncommercial_top(_removals(t), "ADFG", "Other", 3, "F")


# Every source of both agencies, named or gathered as Other.
REMOVAL_LEVELS = [("ADFG", s) for s in ("S0", "S1", "S2", "S3", "S4", "S5", "Other")] + [("IPHC", f"S{k}") for k in range(6)]


@query(
    "catch_noncommercial_wide",
    f"WITH {REMOVALS}, s AS (SELECT year, agency || '_' || source AS k, {sql_round_even('round(sum(kg), 6) / 1000.0', 3)} AS tons FROM lab GROUP BY ALL) SELECT year, "
    + ", ".join(f"max(tons) FILTER (k = '{a}_{s}') AS {a.lower()}_{s.lower()}" for a, s in REMOVAL_LEVELS)
    + " FROM s GROUP BY year",
)
def _(t):
    return catch.noncommercial_top(_removals(t), "ADFG", "Other", 3, "F", REMOVAL_LEVELS)


@query(
    "bycatch_prohibited_table",
    f"WITH s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS grp, {sql_round_even('coalesce(sum(l_extendedprice * 0.001), 0.0)', 3)} AS m, {sql_round_even('coalesce(sum(l_quantity), 0.0)', 3)} AS n FROM lineitem WHERE year(l_shipdate) > 1998 GROUP BY ALL) SELECT grp, "
    + ", ".join(
        f"max(m) FILTER (year = {y}) AS mortality_t_{y}, max(n) FILTER (year = {y}) AS numbers_{y}" for y in (1999, 2000, 2001)
    )
    + " FROM s GROUP BY grp",
)
def _(t):
    rows = t.lineitem.select(
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") * 0.001).alias("m"), F.col("l_quantity").alias("n")
    )
    return catch.prohibited_table(rows, 1998, [1999, 2000, 2001], "grp", "m", "n")


NONTARGET = """f AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_partkey % 997 AS species, round(sum(l_quantity), 2) AS target_wt FROM lineitem WHERE l_discount > 0.095 AND l_suppkey % 10 = 0 GROUP BY ALL),
       g AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_partkey % 997 AS species, round(sum(l_quantity), 2) AS all_wt FROM lineitem GROUP BY ALL),
       j AS (SELECT coalesce(g.year, f.year) AS year, coalesce(g.species, f.species) AS species, target_wt, all_wt, round(target_wt / all_wt, 2) AS prop
             FROM f FULL JOIN g ON f.species = g.species AND f.year = g.year)"""


def _bycatch(t):
    return t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        (F.col("l_partkey") % 997).alias("species"),
        F.col("l_quantity").alias("weight"),
        F.when((F.col("l_discount") > 0.095) & (F.col("l_suppkey") % 10 == 0), "L").otherwise("X").alias("code"),
    )


@query(
    "bycatch_nontarget_share",
    f"WITH {NONTARGET} SELECT * FROM j WHERE species IN (SELECT species FROM j WHERE target_wt IS NOT NULL)",
)
def _(t):
    return catch.nontarget_share(_bycatch(t), F.col("code") == "L", "weight")


@query("bycatch_nontarget_sql", f"WITH {NONTARGET} SELECT * FROM j")
def _(t):
    _bycatch(t).createOrReplaceTempView("bycatch_rows")
    return catch.nontarget_share_sql(t.spark, "bycatch_rows", "L", 1990, 2010)


@query(
    "catch_over_biomass",
    f"""WITH {LANDINGS}, m AS (SELECT year, sum(tons) * 20 AS biomass, sum(tons) AS catch, 'model' AS source FROM landings WHERE year < 1999 GROUP BY 1),
        d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 1000.0 * {sql_round_even('avg(o_totalprice / 1000)', 2)} AS biomass FROM orders WHERE year(o_orderdate) BETWEEN 1999 AND 2001 GROUP BY 1),
        p AS (SELECT d.year, d.biomass, c.catch, 'projection' AS source FROM d JOIN (SELECT year, sum(tons) AS catch FROM landings GROUP BY 1) c ON d.year = c.year)
        SELECT year, biomass, catch, source, round(catch / biomass, 8) AS catch_over_biomass FROM (SELECT * FROM m UNION ALL SELECT * FROM p)""",
)
def _(t):
    c = landings(t).groupBy("year").agg(F.sum("tons").alias("catch"))
    model = c.where("year < 1999").withColumn("biomass", F.col("catch") * 20)
    d = t.orders.select(F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 1000).alias("total_biomass"))
    out = catch.catch_over_biomass(model, d, c, (1999, 2001))
    return out.withColumn("catch_over_biomass", r("catch_over_biomass", 8))
