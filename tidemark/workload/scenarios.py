"""Scenario tables, status, smoothing and apportionment (section 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import cv
from ..plans import apportion, scenarios as sc, smoothing
from .bindings import CATCH_RUN, DRAWS, LANDINGS, SUMMARY, SURVEY, catch_run, draws, landings, r, scenario_summary, sql_round_even, survey
from .registry import query

Y1, Y2 = 2005, 2006


@query(
    "scen_mean_tables",
    f"WITH {SUMMARY} SELECT year, "
    + ", ".join(f"max(round_even(value * 1000, 0)) FILTER (alt = {a}) AS scenario_{a}" for a in range(1, 8))
    + " FROM summary WHERE metric = 'SSBMean' GROUP BY year",
)
def _(t):
    return sc.mean_table(scenario_summary(t), "SSBMean")


@query(
    "scen_mean_table_f",
    f"WITH {SUMMARY} SELECT year, "
    + ", ".join(f"max({sql_round_even('value', 3)}) FILTER (alt = {a}) AS scenario_{a}" for a in range(1, 8))
    + " FROM summary WHERE metric = 'F_Mean' GROUP BY year",
)
def _(t):
    return sc.mean_table(scenario_summary(t), "F_Mean")


@query(
    "scen_mean_table_catch",
    f"WITH {SUMMARY} SELECT year, "
    + ", ".join(f"max(round_even(value * 1000, 0)) FILTER (alt = {a}) AS scenario_{a}" for a in range(1, 8))
    + " FROM summary WHERE metric = 'CMean' GROUP BY year",
)
def _(t):
    return sc.mean_table(scenario_summary(t), "CMean")


@query(
    "scen_fan",
    f"""WITH {DRAWS}, l AS (SELECT year, alternative, 'ssb' AS metric, ssb AS v FROM draws UNION ALL SELECT year, alternative, 'tot_biom', tot_biom FROM draws)
        SELECT year, alternative, metric, round(quantile_cont(v, 0.5), 6) AS med, round(quantile_cont(v, 0.1), 6) AS lwr, round(quantile_cont(v, 0.9), 6) AS upr FROM l GROUP BY ALL""",
)
def _(t):
    out = sc.fan(draws(t), ["year", "alternative"], ["ssb", "tot_biom"])
    return out.select("year", "alternative", "metric", *[r(c).alias(c) for c in ("med", "lwr", "upr")])


REF = f"""{SUMMARY}, {CATCH_RUN}, u AS (
    SELECT metric, year, value FROM summary WHERE alt = 1 AND year IN ({Y1}, {Y2}) AND metric IN ('SSBMean','SSBFofl','SSBFabc','SSBF100','Fofl','Fabc')
    UNION ALL SELECT metric, year, value FROM (SELECT * FROM catch_run WHERE year IN ({Y1}, {Y2})) UNPIVOT (value FOR metric IN (Catch, ABC, OFL, SSB, TotBiom))),
  w AS (SELECT metric, max(value) FILTER (year = {Y1}) AS a, max(value) FILTER (year = {Y2}) AS b FROM u GROUP BY 1),
  items(metric, ord, label, unit, digits) AS (VALUES ('TotBiom', 1, 'Projected total (3+) biomass (t)', 1000, 0), ('SSBMean', 2, 'Projected Female spawning biomass (t)', 1000, 0),
    ('SSBF100', 3, 'B100%', 1000, 0), ('SSBFabc', 4, 'B40%', 1000, 0), ('SSBFofl', 5, 'B35%', 1000, 0), ('Fofl', 6, 'FOFL', 1, 2), ('Fabc', 7, 'maxFABC', 1, 2), ('Fabc', 8, 'FABC', 1, 2),
    ('OFL', 9, 'OFL (t)', 1000, 0), ('ABC', 10, 'maxABC (t)', 1000, 0), ('ABC', 11, 'ABC (t)', 1000, 0)),
  ref AS (SELECT ord, label, metric, CASE WHEN digits = 0 THEN round_even(a * unit, 0) ELSE {sql_round_even('a', 2)} END AS y{Y1}, CASE WHEN digits = 0 THEN round_even(b * unit, 0) ELSE {sql_round_even('b', 2)} END AS y{Y2}
    FROM w JOIN items USING (metric))"""


@query("scen_reference_table", f"WITH {REF} SELECT * FROM ref")
def _(t):
    return sc.reference_table(scenario_summary(t), catch_run(t), (Y1, Y2))


def _printed(c):
    return f"CASE WHEN ord <= 5 OR ord >= 9 THEN printf('%,d', CAST({c} AS BIGINT)) ELSE format('{{:,.2f}}', {c}) END"


@query(
    "scen_safe_table",
    f"""WITH {REF}, body AS (SELECT ord + 2 AS ord, label, {_printed(f'y{Y1}')} AS a, {_printed(f'y{Y2}')} AS b FROM ref)
        SELECT CAST(ord AS INTEGER) AS ord, label, a AS previous_2004, b AS previous_2005, a AS current_{Y1}, b AS current_{Y2} FROM body
        UNION ALL SELECT * FROM (VALUES (1, 'M', '0.2', '0.2', '0.2', '0.2'), (2, 'Tier', '3a', '3a', '3a', '3a'), (14, 'Overfishing', 'no', NULL, 'no', NULL),
          (15, 'Overfished', NULL, 'no', NULL, 'no'), (16, 'Approaching Overfished', NULL, 'no', NULL, 'no'))""",
)
def _(t):
    ref = sc.reference_table(scenario_summary(t), catch_run(t), (Y1, Y2))
    printed = ref.select("ord", F.format_number(f"y{Y1}", 2).alias("y2004"), F.format_number(f"y{Y2}", 2).alias("y2005"))
    return sc.report_table(printed, ref, (2004, 2005), (Y1, Y2))


@query(
    "scen_reference_points",
    f"""WITH {DRAWS}, b AS (SELECT alternative, max(ssb) AS b100, min(ssb) FILTER (year = 2003) AS now FROM draws GROUP BY 1)
        SELECT alternative, b100, round(0.4 * b100, 6) AS b40, round(0.35 * b100, 6) AS b35, round(now / b100, 8) AS depletion, round(now / (0.35 * b100), 8) AS b_over_b35 FROM b""",
)
def _(t):
    b = draws(t).groupBy("alternative").agg(
        F.max("ssb").alias("b100"), F.min(F.when(F.col("year") == 2003, F.col("ssb"))).alias("now")
    )
    out = sc.reference_points(b, "b100", "now", ["alternative"])
    return out.select("alternative", "b100", r("b40").alias("b40"), r("b35").alias("b35"), r("depletion", 8).alias("depletion"), r("b_over_b35", 8).alias("b_over_b35"))


@query(
    "scen_recruit_stats",
    """WITH s AS (SELECT l_suppkey AS stock, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS rec FROM lineitem GROUP BY ALL)
       SELECT stock, round(avg(rec), 6) AS mean_rec, round(count(*) / sum(1 / rec), 6) AS harmonic_rec, round(sqrt(avg(rec) / (count(*) / sum(1 / rec)) - 1), 8) AS cv_rec FROM s GROUP BY 1""",
)
def _(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("stock"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("rec"))
    out = sc.recruit_stats(s, ["stock"], "rec")
    return out.select("stock", r("mean_rec").alias("mean_rec"), r("harmonic_rec").alias("harmonic_rec"), r("cv_rec", 8).alias("cv_rec"))


@query(
    "scen_catch_abc_ratio",
    f"""WITH {LANDINGS}, c AS (SELECT zone, year, sum(tons) AS catch, count(*) * 60.0 AS abc FROM landings GROUP BY ALL)
        SELECT zone, round(avg(catch / abc), 8) AS catch_abc_ratio FROM c WHERE year BETWEEN 1998 AND 2000 GROUP BY 1""",
)
def _(t):
    c = landings(t).groupBy("zone", "year").agg(F.sum("tons").alias("catch"), (F.count(F.lit(1)) * 60.0).alias("abc"))
    out = sc.catch_abc_ratio(c.drop("abc"), c.drop("catch"), (1998, 2000), ["zone"])
    return out.select("zone", r("catch_abc_ratio", 8).alias("catch_abc_ratio"))


PHASE = f"""{LANDINGS}, m AS (SELECT zone, year, sum(tons) AS ssb, sum(tons) / 1000000 AS f, 'model' AS source, 1 AS p FROM landings GROUP BY ALL),
    pr AS (SELECT zone, year + 2 AS year, sum(tons) / 1000 * 1000 AS ssb, avg(tons) / 1000 AS f, 'projection' AS source, 2 AS p FROM landings WHERE year >= 1999 GROUP BY ALL),
    ref AS (SELECT zone, max(tons) / 10 AS b35, avg(tons) / 500 AS f35 FROM landings GROUP BY 1),
    best AS (SELECT * FROM (SELECT * FROM m UNION ALL SELECT * FROM pr) QUALIFY row_number() OVER (PARTITION BY zone, year ORDER BY p DESC) = 1),
    phase AS (SELECT zone, year, ssb, f, ssb / (b35 * 1000) AS b_b35, f / f35 AS f_f35, source FROM best JOIN ref USING (zone))"""


def _phase(t):
    rows = landings(t)
    m = rows.groupBy("zone", "year").agg(F.sum("tons").alias("ssb"), (F.sum("tons") / 1000000).alias("f"))
    p = rows.where("year >= 1999").groupBy("zone", (F.col("year") + 2).alias("year")).agg(
        (F.sum("tons") / 1000).alias("ssb"), (F.avg("tons") / 1000).alias("f")
    )
    ref = rows.groupBy("zone").agg((F.max("tons") / 10).alias("b35"), (F.avg("tons") / 500).alias("f35"))
    return sc.phase_series(m, p, ref, by=["zone"])


@query(
    "status_phase",
    f"WITH {PHASE} SELECT zone, year, round(ssb, 4) AS ssb, round(f, 8) AS f, round(b_b35, 8) AS b_b35, round(f_f35, 8) AS f_f35, source FROM phase",
)
def _(t):
    out = _phase(t)
    return out.select("zone", "year", r("ssb", 4).alias("ssb"), *[r(c, 8).alias(c) for c in ("f", "b_b35", "f_f35")], "source")


@query(
    "status_control_rule",
    f"""WITH {DRAWS}, x AS (SELECT year, alternative, min(ssb) AS lo, avg(ssb) / 40 AS ratio FROM draws GROUP BY ALL),
        y AS (SELECT year, alternative, CASE WHEN year % 2 = 0 THEN ratio ELSE lo / 4 END AS ratio FROM x)
        SELECT year, alternative, round(ratio, 8) AS ratio, round(least(1.0, greatest(0.0, (ratio - 0.05) / (0.4 / 0.35 - 0.05))), 8) AS ofl_rule,
               round(least(0.8, greatest(0.0, 0.8 * (ratio - 0.05) / (0.4 / 0.35 - 0.05))), 8) AS abc_rule FROM y""",
)
def _(t):
    x = draws(t).groupBy("year", "alternative").agg(F.min("ssb").alias("lo"), (F.avg("ssb") / 40).alias("ratio"))
    x = x.withColumn("ratio", F.when(F.col("year") % 2 == 0, F.col("ratio")).otherwise(F.col("lo") / 4)).drop("lo")
    out = sc.with_control_rules(x, "ratio")
    return out.select("year", "alternative", *[r(c, 8).alias(c) for c in ("ratio", "ofl_rule", "abc_rule")])


@query(
    "status_flags",
    """WITH s AS (SELECT event_type AS stock, CAST(user_id % 2 + 6 AS INTEGER) AS alt, CAST(dayofmonth(ts) + 2000 AS INTEGER) AS year, avg(value) AS ssb FROM events GROUP BY ALL),
            b AS (SELECT event_type AS stock, avg(value) AS b35 FROM events GROUP BY 1),
            w AS (SELECT stock, max(ssb) FILTER (alt = 6 AND year = 2010) AS a, max(ssb) FILTER (alt = 6 AND year = 2020) AS b, max(ssb) FILTER (alt = 7 AND year = 2012) AS c, max(ssb) FILTER (alt = 7 AND year = 2022) AS d FROM s GROUP BY 1)
       SELECT stock, round(b35, 6) AS b35, round(a, 6) AS s6_now, round(b, 6) AS s6_later, round(c, 6) AS s7_now, round(d, 6) AS s7_later,
              NOT (a > b35 OR (a > b35 / 2 AND b > b35)) AS overfished, NOT (c > b35 OR (c > b35 / 2 AND d > b35)) AS approaching FROM w JOIN b USING (stock)""",
)
def _(t):
    s = t.events.groupBy(
        F.col("event_type").alias("stock"), (F.col("user_id") % 2 + 6).cast("int").alias("alt"), (F.dayofmonth("ts") + 2000).alias("year")
    ).agg(F.avg("value").alias("ssb"))
    b = t.events.groupBy(F.col("event_type").alias("stock")).agg(F.avg("value").alias("b35"))
    out = sc.status_flags(s, b, 2010, ["stock"])
    return out.select("stock", *[r(c).alias(c) for c in ("b35", "s6_now", "s6_later", "s7_now", "s7_later")], "overfished", "approaching")


def _smoothed(t):
    s = survey(t).select("area", "year", "biomass", cv("variance", "biomass").alias("cv"))
    return smoothing.smooth_random_walk(s.withColumnRenamed("area", "strata"), ["strata"], end_year=2003)


# The same search in SQL: per round a filter over the years for every point of the grid, then the best point.
def _filter_sql(name: str, points: str) -> str:
    """Filter states per area and point s of the table `points`."""
    return f"""{name} AS (
    SELECT p.area, p.s, o.year, o.y AS a, o.v AS p, 0.0::DOUBLE AS ap, 0.0::DOUBLE AS pp, 0.0::DOUBLE AS nll FROM {points} p JOIN obs o ON o.area = p.area AND o.year = p.y0
    UNION ALL
    SELECT area, s, year, ap + coalesce(g * (y - ap), 0), (1 - coalesce(g, 0)) * pp, ap, pp, nll + coalesce(0.5 * (ln(2 * pi() * (pp + v)) + (y - ap) * (y - ap) / (pp + v)), 0)
    FROM (SELECT f.area, f.s, f.year + 1 AS year, f.a AS ap, f.p + exp(2 * f.s) AS pp, f.nll, o.y, o.v, (f.p + exp(2 * f.s)) / (f.p + exp(2 * f.s) + o.v) AS g
          FROM {name} f LEFT JOIN obs o ON o.area = f.area AND o.year = f.year + 1 WHERE f.year < 2003))"""


def _search_sql() -> str:
    n, low, high = smoothing.GRID - 1, smoothing.LOW, smoothing.HIGH
    parts = [f"b0 AS (SELECT area, min(year) AS y0, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi, 0.0::DOUBLE AS best FROM obs GROUP BY 1)"]
    for k in range(smoothing.ROUNDS):
        parts.append(f"g{k} AS (SELECT area, y0, lo, hi, lo + (hi - lo) / {n} * i AS s FROM b{k}, range({n + 1}) t(i))")
        parts.append(_filter_sql(f"f{k}", f"g{k}"))
        parts.append(
            f"""b{k + 1} AS (SELECT area, y0, greatest({low}, s - (hi - lo) / {n}) AS lo, least({high}, s + (hi - lo) / {n}) AS hi, s AS best
            FROM (SELECT g.*, f.nll FROM g{k} g JOIN f{k} f ON g.area = f.area AND g.s = f.s WHERE f.year = 2003) QUALIFY row_number() OVER (PARTITION BY area ORDER BY nll, s) = 1)"""
        )
    return ",\n  ".join(parts)


_LAST = f"b{smoothing.ROUNDS}"
SEARCH_SQL = f"""WITH RECURSIVE {SURVEY},
  obs AS (SELECT area, year, ln(biomass) AS y, ln(1 + variance / (biomass * biomass)) AS v FROM survey),
  {_search_sql()},
  around AS (SELECT area, y0, best, k, best + {smoothing.H} * (k - 1) AS s FROM {_LAST}, range(3) t(k)),
  {_filter_sql("fwd", "around")},
  bwd AS (
    SELECT f.area, f.s, f.year, f.a AS m, f.p AS c FROM fwd f WHERE f.year = 2003
    UNION ALL
    SELECT f.area, f.s, f.year, f.a + f.p / n.pp * (b.m - n.ap), f.p + (f.p / n.pp) * (f.p / n.pp) * (b.c - n.pp)
    FROM bwd b JOIN fwd n ON n.area = b.area AND n.s = b.s AND n.year = b.year JOIN fwd f ON f.area = b.area AND f.s = b.s AND f.year = b.year - 1),
  three AS (SELECT a.area, a.best, b.year, max(m) FILTER (k = 0) AS m0, max(m) FILTER (k = 1) AS m1, max(m) FILTER (k = 2) AS m2, max(c) FILTER (k = 1) AS c1
            FROM around a JOIN bwd b ON a.area = b.area AND a.s = b.s GROUP BY ALL),
  cost AS (SELECT a.area, max(nll) FILTER (k = 1) AS nll, (max(nll) FILTER (k = 2) - 2 * max(nll) FILTER (k = 1) + max(nll) FILTER (k = 0)) / ({smoothing.H} * {smoothing.H}) AS curve
           FROM around a JOIN fwd f ON a.area = f.area AND a.s = f.s WHERE f.year = 2003 GROUP BY 1)
  SELECT t.area AS strata, CAST(t.year AS INTEGER) AS year, round(biomass, 2) AS obs, round(m1, 4) AS log_est, round(sqrt(c1), 4) AS sd_conditional,
         round(sqrt(c1 + CASE WHEN curve > 1e-8 THEN power((m2 - m0) / (2 * {smoothing.H}), 2) / curve ELSE 0 END), 3) AS log_sd, round(best, 3) AS log_sigma, round(nll, 5) AS nll,
         CASE WHEN best <= {smoothing.LOW} THEN 'low bound' WHEN best >= {smoothing.HIGH} THEN 'high bound' ELSE 'inside' END AS fit
  FROM three t JOIN cost USING (area) LEFT JOIN survey ON survey.area = t.area AND survey.year = t.year"""


@query("smooth_random_walk", SEARCH_SQL)
def _(t):
    digits = {"obs": 2, "log_est": 4, "sd_conditional": 4, "log_sd": 3, "log_sigma": 3, "nll": 5}
    return _smoothed(t).select("strata", "year", *[r(c, d).alias(c) for c, d in digits.items()], "fit")


# Filter forward, then smooth backward, as two recursions over the years. Three
# years count as not surveyed, so the gaps are filled by the model.
FIXED = -1.5
SMOOTH_SQL = f"""WITH RECURSIVE {SURVEY},
  obs AS (SELECT area, year, ln(biomass) AS y, ln(1 + variance / (biomass * biomass)) AS v FROM survey WHERE year NOT IN (1995, 1998, 2001)),
  span AS (SELECT area, min(year) AS y0, 2003 AS y1 FROM obs GROUP BY 1),
  fwd AS (
    SELECT s.area, s.y0 AS year, o.y AS a, o.v AS p, 0.0::DOUBLE AS ap, 0.0::DOUBLE AS pp, 0.0::DOUBLE AS nll
    FROM span s JOIN obs o ON o.area = s.area AND o.year = s.y0
    UNION ALL
    SELECT area, year, ap + coalesce(g * (y - ap), 0), (1 - coalesce(g, 0)) * pp, ap, pp,
           nll + coalesce(0.5 * (ln(2 * pi() * (pp + v)) + (y - ap) * (y - ap) / (pp + v)), 0)
    FROM (SELECT f.area, f.year + 1 AS year, f.a AS ap, f.p + exp(2 * {FIXED}::DOUBLE) AS pp, f.nll, o.y, o.v, (f.p + exp(2 * {FIXED}::DOUBLE)) / (f.p + exp(2 * {FIXED}::DOUBLE) + o.v) AS g
          FROM fwd f JOIN span s ON f.area = s.area AND f.year < s.y1 LEFT JOIN obs o ON o.area = f.area AND o.year = f.year + 1)),
  bwd AS (
    SELECT f.area, f.year, f.a AS m, f.p AS c FROM fwd f WHERE f.year = 2003
    UNION ALL
    SELECT f.area, f.year, f.a + f.p / n.pp * (b.m - n.ap), f.p + (f.p / n.pp) * (f.p / n.pp) * (b.c - n.pp)
    FROM bwd b JOIN fwd n ON n.area = b.area AND n.year = b.year JOIN fwd f ON f.area = b.area AND f.year = b.year - 1)
  SELECT b.area AS strata, CAST(b.year AS INTEGER) AS year, round(b.m, 6) AS log_est, round(sqrt(b.c), 6) AS log_sd, round(t.nll, 5) AS nll
  FROM bwd b JOIN (SELECT area, nll FROM fwd WHERE year = 2003) t USING (area)"""


@query("smooth_fixed_sigma", SMOOTH_SQL)
def _(t):
    s = survey(t).where("year NOT IN (1995, 1998, 2001)").select(F.col("area").alias("strata"), "year", "biomass", cv("variance", "biomass").alias("cv"))
    out = smoothing.smooth_random_walk(s, ["strata"], end_year=2003, log_sigma=FIXED)
    return out.select("strata", "year", r("log_est").alias("log_est"), r("log_sd").alias("log_sd"), r("nll", 5).alias("nll"))


SHARES = f"""{SURVEY}, sh AS (SELECT year, area AS strata, biomass / sum(biomass) OVER (PARTITION BY year) AS share FROM survey WHERE year = 2000),
   fr AS (SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) AS w FROM orders),
   parts AS (SELECT year, strata, share FROM sh WHERE strata <> 'ASIA' UNION ALL SELECT year, 'West ASIA', share * w FROM sh, fr WHERE strata = 'ASIA'
             UNION ALL SELECT year, 'East ASIA', share * (1 - w) FROM sh, fr WHERE strata = 'ASIA')"""


def _shares(t):
    s = survey(t).select(F.col("area").alias("strata"), "year", F.col("biomass").alias("estimate"))
    frac = t.orders.agg((F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("west"))
    frac = frac.withColumn("east", 1 - F.col("west"))
    return apportion.split_area(apportion.area_shares(s, 2000), "ASIA", frac, {"West ASIA": "west", "East ASIA": "east"})


@query("apportion_shares", f"WITH {SHARES} SELECT year, strata, round(share, 8) AS share FROM parts")
def _(t):
    return _shares(t).select("year", "strata", r("share", 8).alias("share"))


@query(
    "apportion_round_remainder",
    f"""WITH {SHARES}, a AS (SELECT year, strata, y AS year_limit, abc, share, round_even(share * abc, 0) AS part FROM parts, (VALUES (2001, 40503.0::DOUBLE), (2002, 41258.0::DOUBLE)) v(y, abc))
        SELECT CAST(year_limit AS INTEGER) AS year_limit, strata, abc, {sql_round_even('share * 100', 2)} AS percent,
               part + CASE WHEN row_number() OVER (PARTITION BY year_limit ORDER BY share DESC, strata) = 1 THEN abc - sum(part) OVER (PARTITION BY year_limit) ELSE 0 END AS area_abc FROM a""",
)
def _(t):
    return apportion.rounded_parts(_shares(t).drop("year"), {2001: 40503.0, 2002: 41258.0})
