"""Roles played by the supplied tables, as DataFrames and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .registry import Tables

ZONES = ["WG", "CG", "WY", "EY", "SE"]
GEARS = ["NPT", "PTR", "HAL", "POT", "JIG", "OTH", "NPT"]
AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
YEARS = list(range(1995, 2002))


def pick(values: list[str], index: Column) -> Column:
    """values[index], index from 0."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    body = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{body}], CAST({index} AS INTEGER) + 1)"


def r(c, digits: int = 6) -> Column:
    """Round a floating result so that sums in another order compare equal."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def sql_round_even(x: str, digits: int) -> str:
    """SQL of the rule in functions.rounding.round_even."""
    s = f"1e{digits}"
    low, high = f"(floor(({x}) * {s}) / {s})", f"(ceil(({x}) * {s}) / {s})"
    even = f"floor(({x}) * {s}) % 2 = 0"
    return f"(CASE WHEN ({x}) - {low} < {high} - ({x}) OR (({x}) - {low} = {high} - ({x}) AND {even}) THEN {low} ELSE {high} END)"


# --- catch records: one lineitem is one landing -----------------------------
def landings(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        pick(ZONES, F.col("l_suppkey") % 5).alias("zone"),
        pick(GEARS, F.col("l_linenumber") - 1).alias("gear"),
        F.when(F.col("l_linestatus") == "F", "D").otherwise("R").alias("type"),
        F.col("l_quantity").alias("tons"),
        F.col("l_shipdate").alias("date"),
    )


LANDINGS = f"""landings AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, {sql_pick(ZONES, 'l_suppkey % 5')} AS zone,
         {sql_pick(GEARS, 'l_linenumber - 1')} AS gear,
         CASE WHEN l_linestatus = 'F' THEN 'D' ELSE 'R' END AS type, l_quantity AS tons, l_shipdate AS date
  FROM lineitem)"""


# --- weekly catch: orders by date and priority ------------------------------
def weekly(t: Tables) -> DataFrame:
    from ..plans.catch import weekly_from_dates

    return weekly_from_dates(
        t.orders, F.col("o_orderdate"), F.col("o_totalprice"), {"species": F.col("o_orderpriority")}
    )


WEEK_SQL = "CAST(floor((dayofyear({d}) - 1) / 7) + 1 AS INTEGER)"
WEEKLY = f"""weekly AS (
  SELECT o_orderpriority AS species, CAST(year(o_orderdate) AS INTEGER) AS year,
         {WEEK_SQL.format(d='o_orderdate')} AS week, sum(o_totalprice) AS catch
  FROM orders GROUP BY ALL)"""


# --- survey biomass: order values by year and region ------------------------
def hauls_with_region(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def survey(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return hauls_with_region(t).groupBy(F.year("o_orderdate").alias("year"), F.col("r_name").alias("area")).agg(
        F.sum(price).alias("biomass"), (F.var_samp(price) * F.count(price)).alias("variance")
    )


SURVEY = """survey AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, r_name AS area, sum(o_totalprice) AS biomass,
         var_samp(o_totalprice) * count(o_totalprice) AS variance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


# --- fish: one lineitem is one measured fish --------------------------------
def fish(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.year("l_shipdate").alias("year"),
        F.col("l_orderkey").alias("haul"),
        (F.col("l_linenumber") % 3 + 1).alias("sex"),
        (F.col("l_quantity") * 14.0 + F.col("l_linenumber")).alias("length"),
        F.when(F.col("p_size") % 37 != 0, F.col("p_size") % 37).alias("age"),
        F.when(F.col("l_discount") < 0.095, F.col("l_extendedprice")).alias("weight"),
    )


FISH = """fish AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey AS haul, l_linenumber % 3 + 1 AS sex,
         l_quantity * 14.0 + l_linenumber AS length,
         CASE WHEN p_size % 37 <> 0 THEN p_size % 37 END AS age,
         CASE WHEN l_discount < 0.095 THEN l_extendedprice END AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# --- length samples without the part join -----------------------------------
def lengths(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        F.col("l_orderkey").alias("haul"),
        pick(["F", "M", "U"], F.col("l_linenumber") % 3).alias("sex"),
        (F.col("l_quantity") + F.col("l_linenumber") * 3).alias("length"),
        F.col("l_quantity").alias("number"),
    )


LENGTHS = f"""lengths AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey AS haul,
         {sql_pick(['F', 'M', 'U'], 'l_linenumber % 3')} AS sex,
         l_quantity + l_linenumber * 3 AS length, l_quantity AS number
  FROM lineitem)"""


# --- simulation draws: events ----------------------------------------------
def draws(t: Tables) -> DataFrame:
    return t.events.select(
        (F.dayofmonth("ts") + 2000).alias("year"),
        F.col("event_type").alias("alternative"),
        F.col("value").alias("ssb"),
        (F.col("user_id") / 10.0).alias("tot_biom"),
    )


DRAWS = """draws AS (
  SELECT CAST(dayofmonth(ts) + 2000 AS INTEGER) AS year, event_type AS alternative, value AS ssb,
         user_id / 10.0 AS tot_biom
  FROM events)"""


# --- scenario summary: events by day, alternative 1-7 and metric ------------
SUMMARY_METRICS = ["SSBMean", "F_Mean", "CMean", "SSBF100", "SSBFabc", "SSBFofl", "Fabc", "Fofl"]


def scenario_summary(t: Tables) -> DataFrame:
    return (
        t.events.groupBy(
            (F.col("user_id") % 7 + 1).cast("int").alias("alt"),
            (F.dayofmonth("ts") + 2000).alias("year"),
            pick(SUMMARY_METRICS, F.col("event_id") % 8).alias("metric"),
        )
        .agg(F.round(F.sum("value"), 4).alias("value"))
        .withColumn("stock", F.lit("stock"))
    )


SUMMARY = f"""summary AS (
  SELECT 'stock' AS stock, CAST(user_id % 7 + 1 AS INTEGER) AS alt, CAST(dayofmonth(ts) + 2000 AS INTEGER) AS year,
         {sql_pick(SUMMARY_METRICS, 'event_id % 8')} AS metric, round(sum(value), 4) AS value
  FROM events GROUP BY ALL)"""


def catch_run(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy((F.dayofmonth("ts") + 2000).alias("year")).agg(
        F.round(F.sum(v), 4).alias("Catch"),
        F.round(F.sum(v) * 1.5, 4).alias("ABC"),
        F.round(F.sum(v) * 1.8, 4).alias("OFL"),
        F.round(F.max(v), 4).alias("SSB"),
        F.round(F.max(v) * 2, 4).alias("TotBiom"),
    )


CATCH_RUN = """catch_run AS (
  SELECT CAST(dayofmonth(ts) + 2000 AS INTEGER) AS year, round(sum(value), 4) AS Catch,
         round(sum(value) * 1.5, 4) AS ABC, round(sum(value) * 1.8, 4) AS OFL,
         round(max(value), 4) AS SSB, round(max(value) * 2, 4) AS TotBiom
  FROM events GROUP BY ALL)"""


# --- model runs: one run per order priority ---------------------------------
def run_quantities(t: Tables) -> DataFrame:
    """(model, label, value, sd) with labels SSB_<year> and Recr_<year>, F_<year>, SSB_Virgin."""
    o = t.orders.select(
        F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("p")
    )
    per_year = o.groupBy("model", "year").agg(F.avg("p").alias("m"), F.stddev_samp("p").alias("s"), F.count("p").alias("n"))
    rows = F.array(
        F.struct(F.lit("SSB").alias("q"), F.round("m", 4).alias("value"), F.round("s", 4).alias("sd")),
        F.struct(F.lit("Recr").alias("q"), F.col("n").cast("double").alias("value"), F.round(F.sqrt("n"), 4).alias("sd")),
        F.struct(
            F.lit("F").alias("q"), F.round(F.col("m") / 1e6, 6).alias("value"), F.round(F.col("s") / 1e6, 6).alias("sd")
        ),
    )
    long = per_year.select("model", "year", F.explode(rows).alias("r")).select(
        "model", F.concat_ws("_", F.col("r.q"), F.col("year")).alias("label"), "r.value", "r.sd"
    )
    virgin = o.groupBy("model").agg(F.round(F.max("p"), 4).alias("value"), F.lit(0.0).alias("sd"))
    return long.unionByName(virgin.select("model", F.lit("SSB_Virgin").alias("label"), "value", "sd"))


RUNS = """per_year AS (
  SELECT o_orderpriority AS model, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS m,
         stddev_samp(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY ALL),
runs AS (
  SELECT model, 'SSB_' || year AS label, round(m, 4) AS value, round(s, 4) AS sd FROM per_year
  UNION ALL SELECT model, 'Recr_' || year, CAST(n AS DOUBLE), round(sqrt(n), 4) FROM per_year
  UNION ALL SELECT model, 'F_' || year, round(m / 1e6, 6), round(s / 1e6, 6) FROM per_year
  UNION ALL SELECT o_orderpriority, 'SSB_Virgin', round(max(o_totalprice), 4), 0.0 FROM orders GROUP BY 1)"""
