"""Model comparison, profiles, retrospectives and gridding (section 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import PROFILE_CUT
from ..operators import joins
from ..operators.reshape import pivot_wide
from ..plans import models as md, spatial
from .bindings import PRIORITIES, RUNS, r, run_quantities, sql_round_even
from .registry import query

TWO = PRIORITIES[:2]


@query(
    "model_compare_wide",
    f"WITH {RUNS} SELECT label, "
    + ", ".join(f"max(value) FILTER (model = '{p}') AS \"{p}\"" for p in PRIORITIES)
    + " FROM runs WHERE abs(value) > 0.01 GROUP BY label",
)
def _(t):
    return md.compare_wide(run_quantities(t), "label", "value", PRIORITIES, threshold=0.01)


def _parameters(t):
    return t.lineitem.groupBy(
        F.col("l_returnflag").alias("model"), F.concat(F.lit("Par_"), F.col("l_suppkey").cast("string")).alias("label")
    ).agg(F.avg("l_quantity").alias("value"), (F.count(F.lit(1)) % 4 - 1).cast("int").alias("phase"))


PARAMS = """params AS (SELECT l_returnflag AS model, 'Par_' || l_suppkey AS label, avg(l_quantity) AS value, count(*) % 4 - 1 AS phase FROM lineitem GROUP BY ALL)"""


@query(
    "model_param_counts",
    f"""WITH {PARAMS} SELECT model, count(*) FILTER (phase > 0) AS estimated, count(*) FILTER (phase > 0 AND regexp_matches(label, '_1')) AS ones,
        count(*) FILTER (phase > 0 AND regexp_matches(label, '[5-9]$')) AS high FROM params GROUP BY 1""",
)
def _(t):
    return md.parameter_counts(_parameters(t), {"ones": "_1", "high": "[5-9]$"})


LABELS = {"Par_7": "Natural mortality", "Par_3": "Length at age 2", "Par_11": "Growth rate"}


@query(
    "model_param_table",
    f"""WITH {PARAMS}, n(label, parameter, ord) AS (VALUES ('Par_7', 'Natural mortality', 1), ('Par_3', 'Length at age 2', 2), ('Par_11', 'Growth rate', 3))
        SELECT ord, parameter, """
    + ", ".join(f"{sql_round_even(f"max(value) FILTER (model = '{m}')", 3)} AS {m}" for m in "ANR")
    + " FROM params JOIN n USING (label) GROUP BY ALL",
)
def _(t):
    return md.parameter_table(_parameters(t), LABELS, ["A", "N", "R"])


def _num(c):
    return (
        f"CASE WHEN {c} IS NULL THEN '' WHEN {c} < 1 THEN format('{{:,.4f}}', {sql_round_even(c, 4)}) WHEN {c} > 1 THEN printf('%,d', CAST(round_even({c}, 0) AS BIGINT)) ELSE '1' END"
    )


QUANTITIES = {"Spawning Biomass": "SSB", "Recruitment": "Recr", "Apical F": "F"}
QUANT_SQL = """s AS (SELECT model, CASE regexp_extract(label, '^(.*)_[^_]*$', 1) WHEN 'SSB' THEN 'Spawning Biomass' WHEN 'Recr' THEN 'Recruitment' WHEN 'F' THEN 'Apical F' END AS quantity,
   TRY_CAST(regexp_extract(label, '_([^_]*)$', 1) AS INTEGER) AS year, value, sd FROM runs)"""


@query(
    "model_timeseries_table",
    f"WITH {RUNS}, {QUANT_SQL}, c AS (SELECT year, model || ' | ' || quantity AS k, {_num('value')} || ' (' || {_num('sd')} || ')' AS cell FROM s WHERE year > 1996) SELECT year, "
    + ", ".join(f"max(cell) FILTER (k = '{m} | {q}') AS \"{m} | {q}\"" for q in QUANTITIES for m in TWO)
    + " FROM c GROUP BY year",
)
def _(t):
    series = md.labelled_series(run_quantities(t), QUANTITIES)
    return md.timeseries_table(series, TWO, list(QUANTITIES), after=1996)


@query(
    "model_labelled_series",
    f"WITH {RUNS}, {QUANT_SQL} SELECT * FROM s WHERE year IS NOT NULL",
)
def _(t):
    return md.labelled_series(run_quantities(t), QUANTITIES)


@query(
    "model_bratio",
    f"""WITH {RUNS}, b AS (SELECT model, 0.35 * value AS b35 FROM runs WHERE label = 'SSB_Virgin')
        SELECT model, 'SSB' AS quantity, TRY_CAST(split_part(label, '_', 2) AS INTEGER) AS year, value, round(value - sd, 4) AS lci, round(value + sd, 4) AS uci, round(value / b35, 8) AS b_over_b35
        FROM runs JOIN b USING (model) WHERE label LIKE 'SSB!_%' ESCAPE '!' AND label <> 'SSB_Virgin' AND CAST(split_part(label, '_', 2) AS INTEGER) < 2001""",
)
def _(t):
    out = md.biomass_ratio(run_quantities(t), before=2001)
    return out.select("model", "quantity", "year", "value", r("lci", 4).alias("lci"), r("uci", 4).alias("uci"), r("b_over_b35", 8).alias("b_over_b35"))


@query(
    "model_index_fit",
    """WITH c AS (SELECT o_orderstatus AS model, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS obs, median(o_totalprice) AS exp, stddev_samp(o_totalprice) / avg(o_totalprice) AS se FROM orders GROUP BY ALL),
       l AS (SELECT model, year, se, 'obs' AS variable, obs AS value FROM c UNION ALL SELECT model, year, se, 'exp', exp FROM c)
       SELECT model, year, round(se, 8) AS se, variable, round(value, 4) AS value, round(value - value * se, 4) AS lwr, round(value + value * se, 4) AS upr FROM l""",
)
def _(t):
    from ..operators.aggregates import exact_quantiles

    o = t.orders.select(F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("p"))
    by = ["model", "year"]
    means = o.groupBy(*by).agg(F.avg("p").alias("obs"), (F.stddev_samp("p") / F.avg("p")).alias("se"))
    c = means.join(exact_quantiles(o, by, "p", {"exp": 0.5}), by)
    out = md.index_fit(c)
    return out.select("model", "year", r("se", 8).alias("se"), "variable", *[r(x, 4).alias(x) for x in ("value", "lwr", "upr")])


@query(
    "model_selex_long",
    """WITH l AS (SELECT l_returnflag AS model, CAST(l_suppkey % 2 + 1 AS INTEGER) AS fleet, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sex, l_linenumber AS age, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) / 50 AS v FROM lineitem GROUP BY ALL),
       m AS (SELECT model, max(year) AS year FROM l GROUP BY 1)
       SELECT model, CASE WHEN fleet = 1 THEN 'Fishery' ELSE 'Survey' END AS fleet, CASE WHEN sex = 1 THEN 'Females' ELSE 'Males' END AS sex, age, round(v, 8) AS value FROM l JOIN m USING (model, year)""",
)
def _(t):
    ages = [str(a) for a in range(1, 8)]
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("model"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_suppkey") % 2 + 1).cast("int").alias("fleet"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("sex"),
        F.col("l_linenumber").cast("string").alias("age"),
        (F.col("l_quantity") / 50).alias("v"),
    )
    wide = pivot_wide(rows, ["model", "year", "fleet", "sex"], "age", "v", ages, combine="mean").withColumn("factor", F.lit("Asel2"))
    out = md.selectivity_long(wide, ages, "Asel2")
    return out.select("model", "fleet", "sex", "age", r("value", 8).alias("value"))


RUN_IDS = [f"replist{i}" for i in range(1, 8)]


def _likelihoods(t):
    """One likelihood row per component with one column per run."""
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("s"), F.concat(F.lit("replist"), F.col("l_linenumber").cast("string")).alias("run"), F.col("l_extendedprice").alias("v")
    ).withColumn("label", F.concat(F.lit("Comp_"), F.col("s").cast("string")))
    sums = rows.groupBy("label", "run").agg(F.round(F.sum("v"), 4).alias("v"))
    return pivot_wide(sums, ["label"], "run", "v", RUN_IDS)


@query(
    "profile_1d",
    """WITH l AS (SELECT 'Comp_' || l_suppkey AS label, 'replist' || l_linenumber AS run, 0.1 * l_linenumber AS at_value, round(sum(l_extendedprice), 4) AS value FROM lineitem GROUP BY ALL)
       SELECT label, run, CAST(round(at_value, 6) AS DOUBLE) AS "at", value FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY value, run) = 1""",
)
def _(t):
    out = md.profile_best(_likelihoods(t), RUN_IDS, {f"replist{i}": 0.1 * i for i in range(1, 8)})
    return out.withColumn("at", r("at"))


SURFACE = """m AS (SELECT avg(o_totalprice) / 50000 AS a, stddev_samp(o_totalprice) / 50000 AS b FROM orders),
       g AS (SELECT i AS q, j AS m, (a - i) * (a - i) * 0.7 + (b - j) * (b - j) AS v FROM m, (SELECT unnest(generate_series(1, 10)) AS i), (SELECT unnest(generate_series(1, 10)) AS j)),
       s AS (SELECT q, m, round(v - min(v) OVER (), 6) AS delta, v = min(v) OVER () AS best, v - min(v) OVER () <= 1.920729 AS inside FROM g)"""


def _surface(t):
    base = t.orders.agg((F.avg("o_totalprice") / 50000).alias("a"), (F.stddev_samp("o_totalprice") / 50000).alias("b"))
    steps = F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))
    g = joins.expand_grid(base, q=steps, m=steps)
    da, db = F.col("a") - F.col("q"), F.col("b") - F.col("m")
    like = g.select(F.lit("TOTAL").alias("label"), "q", "m", (da * da * 0.7 + db * db).alias("value"))
    return md.profile_surface(like, "q", "m", PROFILE_CUT).withColumn("delta", r("delta"))


query("profile_2d", f"WITH {SURFACE} SELECT * FROM s")(_surface)


@query(
    "profile_2d_matrix",
    f"WITH {SURFACE} SELECT q, {', '.join(f'max(delta) FILTER (m = {k}) AS m_{k}' for k in range(1, 11))} FROM s GROUP BY q",
)
def _(t):
    return md.profile_matrix(_surface(t), "q", "m", list(range(1, 11)))


@query(
    "profile_2d_contour",
    f"""WITH {SURFACE}, i AS (SELECT q, m FROM s WHERE inside),
        n AS (SELECT a.q, a.m, count(b.q) AS near FROM i a LEFT JOIN i b ON abs(a.q - b.q) <= 1 AND abs(a.m - b.m) <= 1 AND (a.q <> b.q OR a.m <> b.m) GROUP BY ALL)
        SELECT q, m, near, q IN (1, 10) OR m IN (1, 10) AS at_border FROM n WHERE near < 8""",
)
def _(t):
    return md.profile_contour(_surface(t), "q", "m")


@query(
    "retro_mohns_rho",
    """WITH b AS (SELECT l_returnflag AS quantity, CAST(l_suppkey % 6 AS INTEGER) AS peel, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
       e AS (SELECT *, 2001 - peel AS end_year FROM b), f AS (SELECT quantity, year, value AS full_value FROM e WHERE peel = 0)
       SELECT quantity, round(avg(value / full_value - 1), 8) AS rho, count(*) AS peels FROM e JOIN f USING (quantity, year) WHERE peel <> 0 AND year = end_year GROUP BY 1""",
)
def _(t):
    b = t.lineitem.groupBy(
        F.col("l_returnflag").alias("quantity"), (F.col("l_suppkey") % 6).cast("int").alias("peel"), F.year("l_shipdate").alias("year")
    ).agg(F.avg("l_extendedprice").alias("value"))
    out = md.mohns_rho(b.withColumn("end_year", 2001 - F.col("peel")))
    return out.select("quantity", r("rho", 8).alias("rho"), "peels")


CELL, RADIUS = 0.05, 0.12


@query(
    "spatial_idw_grid",
    f"""WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS DOUBLE) * 1000 AS z FROM embeddings),
        c AS (SELECT x, y, z, CAST(floor(x / {CELL}::DOUBLE) + i AS BIGINT) AS cell_x, CAST(floor(y / {CELL}::DOUBLE) + j AS BIGINT) AS cell_y
              FROM p, (SELECT unnest(generate_series(-4, 4)) AS i), (SELECT unnest(generate_series(-4, 4)) AS j)),
        d AS (SELECT *, pow((cell_x + 0.5) * {CELL}::DOUBLE - x, 2) + pow((cell_y + 0.5) * {CELL}::DOUBLE - y, 2) AS d2 FROM c),
        v AS (SELECT cell_x, cell_y, count(*) AS points, sum(z / d2) / sum(1 / d2) AS value FROM d WHERE d2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE GROUP BY ALL)
        SELECT cell_x, cell_y, points, round(value, 4) AS value, CAST(CASE WHEN v9 <= 0 THEN 0 WHEN v9 <= 500 THEN 1 WHEN v9 <= 2000 THEN 2 WHEN v9 <= 5000 THEN 3
          WHEN v9 <= 7500 THEN 4 WHEN v9 <= 16000 THEN 5 ELSE 6 END AS INTEGER) AS class FROM (SELECT *, round(value, 9) AS v9 FROM v)""",
)
def _(t):
    out = spatial.idw_grid(
        t.embeddings, F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)), F.col("label") * 1000, CELL, RADIUS
    )
    return out.select("cell_x", "cell_y", "points", r("value", 4).alias("value"), "class")
