"""Survey indices and compositions (section 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import age_bins, length_bins
from ..plans import ageing, comps, survey as sv
from .bindings import AREAS, FISH, LENGTHS, PRIORITIES, SURVEY, fish, hauls_with_region, lengths, pick, r, sql_pick, survey
from .registry import query

LB, AB = length_bins(), age_bins()
ALL_LB = f"(SELECT CAST(unnest(generate_series({LB[0]}, {LB[-1]}, {LB[1] - LB[0]})) AS INTEGER) AS bin)"
ALL_AB = f"(SELECT CAST(unnest(generate_series({AB[0]}, {AB[-1]})) AS INTEGER) AS bin)"
SEXES = "(SELECT unnest([1, 2]) AS sex)"


@query(
    "index_total_cv",
    """WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS b, var_samp(o_totalprice) * count(*) AS v FROM orders GROUP BY 1)
       SELECT year, 1 AS month, 2 AS fleet, round(b, 2) AS obs, round(sqrt(v) / b, 8) AS cv, round(b - sqrt(v), 2) AS lci, round(b + sqrt(v), 2) AS uci FROM s""",
)
def _(t):
    p = F.col("o_totalprice")
    s = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.sum(p).alias("biomass"), (F.var_samp(p) * F.count(p)).alias("variance")
    )
    out = sv.index_with_limits(s)
    return out.select("year", "month", "fleet", r("obs", 2).alias("obs"), r("cv", 8).alias("cv"), r("lci", 2).alias("lci"), r("uci", 2).alias("uci"))


@query(
    "index_area_wide",
    f"WITH {SURVEY} SELECT year, round(sum(biomass), 2) AS total_biomass, round(sqrt(sum(variance)) / sum(biomass), 8) AS total_cv, "
    + ", ".join(
        f"round(max(biomass) FILTER (area = '{a}'), 2) AS \"biomass_{a}\", round(max(sqrt(variance) / biomass) FILTER (area = '{a}'), 8) AS \"cv_{a}\""
        for a in AREAS
    )
    + " FROM survey GROUP BY year",
)
def _(t):
    out = sv.index_by_area_wide(survey(t), AREAS)
    return out.select("year", *[r(F.col(f"`{c}`"), 8 if "cv" in c else 2).alias(c) for c in out.columns if c != "year"])


@query(
    "index_area_long",
    f"""WITH {SURVEY}, o AS (SELECT o_orderpriority AS strata, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS b, 0.2::DOUBLE AS cv FROM orders GROUP BY ALL),
        u AS (SELECT CASE area WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE area END AS strata, year, biomass, sqrt(variance) / biomass AS cv FROM survey
              UNION ALL SELECT strata, year, b, cv FROM o WHERE year < 1997)
        SELECT strata, year, round(biomass, 2) AS biomass, round(cv, 8) AS cv FROM u WHERE year <> 2001""",
)
def _(t):
    old = t.orders.groupBy(F.col("o_orderpriority").alias("strata"), F.year("o_orderdate").alias("year")).agg(
        F.sum("o_totalprice").alias("biomass"), F.lit(0.2).alias("cv")
    )
    out = sv.index_by_area_long(survey(t), old, 1997, {"ASIA": "Asia", "EUROPE": "Europe"}, drop_year=2001)
    return out.select("strata", "year", r("biomass", 2).alias("biomass"), r("cv", 8).alias("cv"))


BANDS = ["1-100", "100-200", "200-300", "300-500", "500-700"]


@query(
    "index_area_depth",
    f"""WITH s AS (SELECT r_name AS area, CAST(year(o_orderdate) AS INTEGER) AS year, {sql_pick(BANDS, 'n_nationkey // 5')} AS band, sum(o_totalprice) AS b
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
       SELECT area, year, """
    + ", ".join(f"round(max(b) FILTER (band = '{b}'), 2) AS \"{b}\"" for b in BANDS)
    + " FROM s GROUP BY ALL",
)
def _(t):
    s = hauls_with_region(t).groupBy(
        F.col("r_name").alias("area"), F.year("o_orderdate").alias("year"), pick(BANDS, F.floor(F.col("n_nationkey") / 5)).alias("band")
    ).agg(r(F.sum("o_totalprice"), 2).alias("biomass"))
    return sv.index_by_depth(s, BANDS)


@query(
    "index_source_compare",
    """WITH d AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS value, stddev_samp(o_totalprice) / avg(o_totalprice) AS cv FROM orders GROUP BY 1),
            m AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_extendedprice) - 1 AS value, avg(l_discount) AS se FROM lineitem GROUP BY 1)
       SELECT year, round(value, 2) AS value, round(value - cv * value, 2) AS lci, round(value + cv * value, 2) AS uci, 'design-based' AS src FROM d WHERE value > 0
       UNION ALL SELECT year, round(value, 2), round(value - 1.96 * se * value, 2), round(value + 1.96 * se * value, 2), 'model-based' FROM m WHERE value > 0""",
)
def _(t):
    p = F.col("o_totalprice")
    d = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.sum(p).alias("value"), (F.stddev_samp(p) / F.avg(p)).alias("cv"))
    m = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(
        (F.sum("l_extendedprice") - 1).alias("value"), F.avg("l_discount").alias("se")
    )
    out = sv.stack_sources(d, m, k_model=1.96)
    return out.select("year", *[r(c, 2).alias(c) for c in ("value", "lci", "uci")], "src")


@query(
    "hauls_per_year",
    """WITH a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_suppkey NOT IN (7, 9) GROUP BY 1),
            b AS (SELECT CAST(year(o_orderdate) + 1 AS INTEGER) AS year, count(DISTINCT o_orderkey || ':' || o_custkey) AS n FROM orders WHERE o_custkey NOT IN (7, 9) GROUP BY 1)
       SELECT coalesce(a.year, b.year) AS year, a.n AS hauls_foreign, b.n AS hauls_domestic FROM a FULL JOIN b ON a.year = b.year""",
)
def _(t):
    a = t.lineitem.select(
        F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("haul"), F.col("l_suppkey").alias("area")
    )
    b = t.orders.select(
        (F.year("o_orderdate") + 1).alias("year"), sv.haul_key(F.col("o_orderkey"), F.lit(":"), F.col("o_custkey")).alias("haul"), F.col("o_custkey").alias("area")
    )
    return sv.hauls_per_year({"foreign": a, "domestic": b}, drop_areas=[7, 9])


@query(
    "hauls_by_span",
    """WITH h AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS year, l_orderkey FROM lineitem WHERE l_suppkey NOT IN (7, 9)),
            y AS (SELECT CAST(unnest(generate_series((SELECT min(year) FROM h), (SELECT max(year) FROM h))) AS INTEGER) AS year)
       SELECT a.year AS first, b.year AS last, count(DISTINCT l_orderkey) AS hauls FROM y a JOIN y b ON a.year <= b.year JOIN h ON h.year BETWEEN a.year AND b.year GROUP BY ALL""",
)
def _(t):
    rows = t.lineitem.select(F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("haul"), F.col("l_suppkey").alias("area"))
    return sv.hauls_by_span(rows, drop_areas=[7, 9])


# --- compositions -----------------------------------------------------------
FISHERY = f"""{LENGTHS}, c AS (SELECT year, CASE WHEN sex = 'F' THEN 1 ELSE 2 END AS sex, CAST(least(greatest(floor(length / 2) * 2, 6), 70) AS INTEGER) AS bin, sum(number) AS n FROM lengths GROUP BY ALL),
  s AS (SELECT year, sex, bin, n / sum(n) OVER (PARTITION BY year) AS f FROM c),
  freq AS (SELECT y.year, x.sex, b.bin, coalesce(f, 0.0) AS freq FROM (SELECT DISTINCT year FROM c) y, {SEXES} x, {ALL_LB} b LEFT JOIN s ON s.year = y.year AND s.sex = x.sex AND s.bin = b.bin),
  h AS (SELECT year, count(DISTINCT haul) AS hauls FROM lengths GROUP BY 1)"""


def _wide_bins(bins):
    return ", ".join(
        f"round(max(freq) FILTER (sex = {k} AND bin = {b}), 8) AS {p}{b}" for k, p in ((1, "f"), (2, "m")) for b in bins
    )


def _fishery(t):
    c = F.col
    return comps.length_frequencies(lengths(t), c("year"), c("sex"), c("length"), c("number"))


def _round_bins(df, digits=8):
    return df.selectExpr(*[f"round({c}, {digits}) AS {c}" if k == "double" else c for c, k in df.dtypes])


@query(
    "comp_length_fishery",
    f"""WITH {FISHERY}, w AS (SELECT year, {_wide_bins(LB)} FROM freq GROUP BY year)
        SELECT w.year AS yr, 7 AS month, CASE WHEN hauls < 15 THEN -1 ELSE 1 END AS fleet, 3 AS sex, 0 AS part, hauls AS nsamp, w.* EXCLUDE (year) FROM w LEFT JOIN h ON w.year = h.year""",
)
def _(t):
    hauls = comps.haul_counts(lengths(t), F.col("year"), F.col("haul"))
    return _round_bins(comps.with_front_matter(_fishery(t), hauls, LB, fleet=1))


@query("comp_length_long", f"WITH {FISHERY} SELECT year, sex, bin, round(freq, 8) AS freq FROM freq")
def _(t):
    return _round_bins(_fishery(t))


def _sizecomp(t):
    return t.lineitem.select(
        F.year("l_shipdate").alias("YEAR"),
        (F.col("l_quantity") * 10 + F.col("l_linenumber") * 20).alias("LENGTH"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("FEMALES"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") + 1).alias("MALES"),
    )


@query(
    "comp_length_survey",
    f"""WITH z AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(least(greatest(floor((l_quantity * 10 + l_linenumber * 20) / 10 / 2) * 2, 6), 70) AS INTEGER) AS bin,
              CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sex, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE l_quantity + 1 END AS n FROM lineitem),
        c AS (SELECT year, sex, bin, sum(n) AS n FROM z GROUP BY ALL), s AS (SELECT year, sex, bin, n / sum(n) OVER (PARTITION BY year) AS f FROM c)
        SELECT y.year, x.sex, b.bin, round(coalesce(f, 0.0), 8) AS freq FROM (SELECT DISTINCT year FROM c) y, {SEXES} x, {ALL_LB} b
        LEFT JOIN s ON s.year = y.year AND s.sex = x.sex AND s.bin = b.bin""",
)
def _(t):
    return _round_bins(comps.length_frequencies_wide_source(_sizecomp(t), "YEAR", "LENGTH", "MALES", "FEMALES"))


CAAL = f"""{FISH}, c AS (SELECT year, CASE WHEN sex = 2 THEN 1 ELSE 2 END AS sex, CAST(least(greatest(floor(round_even(length / 10.0, 0) / 2) * 2, 6), 70) AS INTEGER) AS lbin,
  CAST(least(greatest(age, 1), 29) AS INTEGER) AS abin, count(*) AS n FROM fish WHERE sex <> 3 AND age IS NOT NULL AND weight IS NOT NULL GROUP BY ALL)"""


def _caal(t):
    c = F.col
    return comps.caal_long(fish(t), c("year"), c("sex"), c("length"), c("age"), c("weight"))


@query(
    "comp_caal",
    f"WITH {CAAL} SELECT year AS yr, 7 AS month, CASE WHEN year < 1996 THEN -2 ELSE 2 END AS fleet, sex, 0 AS part, 1 AS ageerr, lbin AS lbin_lo, lbin AS lbin_hi, CAST(sum(n) AS BIGINT) AS nsamp, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (abin = {a}), 0) AS BIGINT) AS {p}{a}" for p in ("f", "m") for a in AB)
    + " FROM c GROUP BY year, sex, lbin",
)
def _(t):
    return comps.caal_rows(_caal(t), first_year=1996)


@query(
    "comp_caal_long",
    f"""WITH {CAAL} SELECT g.year, g.sex, g.lbin, b.bin AS abin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT year, sex, lbin FROM c) g, {ALL_AB} b
        LEFT JOIN c ON c.year = g.year AND c.sex = g.sex AND c.lbin = g.lbin AND c.abin = b.bin""",
)
def _(t):
    return _caal(t)


MARGINAL = f"""m AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_linenumber % 3 + 1 = 1 THEN 2 ELSE 1 END AS sex, CAST(least(greatest(p_size, 1), 29) AS INTEGER) AS bin, sum(l_quantity) AS n
   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  s AS (SELECT year, sex, bin, n / sum(n) OVER (PARTITION BY year) AS freq FROM m), h AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(DISTINCT l_orderkey) AS hauls FROM lineitem GROUP BY 1)"""


@query(
    "comp_age_marginal",
    f"WITH {MARGINAL}, w AS (SELECT year, "
    + ", ".join(
        f"round(coalesce(sum(freq) FILTER (sex = {k} AND bin = {a}), 0.0), 8) AS p{p}{a}" for k, p in ((1, ""), (2, "10")) for a in AB
    )
    + " FROM s GROUP BY year) SELECT w.year AS yr, 7 AS month, -2 AS fleet, 3 AS sex, 0 AS part, 1 AS ageerr, -1 AS lbin_lo, -1 AS lbin_hi, hauls AS nsamp, w.* EXCLUDE (year) FROM w JOIN h USING (year)",
)
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    y = F.year("l_shipdate")
    freq = comps.age_marginal(rows, y, F.col("l_linenumber") % 3 + 1, F.col("p_size"), F.col("l_quantity"))
    return _round_bins(comps.age_marginal_rows(freq, comps.haul_counts(t.lineitem, y, F.col("l_orderkey"))))


@query(
    "comp_sample_sizes",
    """WITH a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_suppkey % 3 = 0 THEN -2 ELSE CAST(l_suppkey % 3 AS INTEGER) END AS fleet, l_linenumber % 2 + 1 AS sex, l_quantity AS nsamp, 'base' AS src FROM lineitem
       UNION ALL SELECT CAST(year(o_orderdate) AS INTEGER), CAST(o_custkey % 2 + 1 AS INTEGER), 1, CAST(o_custkey % 10 AS DOUBLE), 'old' FROM orders)
       SELECT year, CASE WHEN fleet = 1 THEN 'Fishery' ELSE 'Survey' END AS fleet, CASE WHEN sex = 1 THEN 'Female' ELSE 'Male' END AS sex, src, sum(nsamp) AS total_nsamp FROM a WHERE fleet <> -2 GROUP BY ALL""",
)
def _(t):
    a = t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_suppkey") % 3 == 0, -2).otherwise((F.col("l_suppkey") % 3).cast("int")).alias("fleet"),
        (F.col("l_linenumber") % 2 + 1).alias("sex"),
        F.col("l_quantity").alias("nsamp"),
    )
    b = t.orders.select(
        F.year("o_orderdate").alias("year"),
        (F.col("o_custkey") % 2 + 1).cast("int").alias("fleet"),
        F.lit(1).alias("sex"),
        (F.col("o_custkey") % 10).cast("double").alias("nsamp"),
    )
    return comps.sample_sizes({"base": a, "old": b})


# Observed and expected proportions: two ways of weighting the same fish.
OBSEXP = """raw AS (SELECT l_returnflag AS fleet, CAST(year(l_shipdate) AS INTEGER) AS year, l_linenumber AS bin, sum(l_quantity) AS q, CAST(count(*) AS DOUBLE) AS k FROM lineitem GROUP BY ALL),
  oe AS (SELECT fleet, year, bin, q / sum(q) OVER w AS obs, k / sum(k) OVER w AS exp, sum(k) OVER w AS n FROM raw WINDOW w AS (PARTITION BY fleet, year))"""


def _obs_exp(t):
    from ..operators.windows import group_value

    raw = t.lineitem.groupBy(
        F.col("l_returnflag").alias("fleet"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("bin")
    ).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("k"))
    by = ["fleet", "year"]
    w = group_value(group_value(raw, by, F.sum("q"), "tq", raw=False), by, F.sum("k"), "n", raw=False)
    return w.select("fleet", "year", "bin", (F.col("q") / F.col("tq")).alias("obs"), (F.col("k") / F.col("n")).alias("exp"), "n")


@query(
    "comp_reweight_mi",
    f"""WITH {OBSEXP}, e AS (SELECT fleet, year, max(n) AS n, sum(exp * (1 - exp)) / sum((obs - exp) * (obs - exp)) AS eff FROM oe GROUP BY ALL)
        SELECT fleet, round(avg(eff), 4) AS mean_eff_n, round(avg(n), 4) AS mean_input_n, round(avg(eff / n), 6) AS mi_mult FROM e GROUP BY fleet""",
)
def _(t):
    out = comps.reweight_harmonic(_obs_exp(t), ["fleet"], ["year"])
    return out.select("fleet", r("mean_eff_n", 4).alias("mean_eff_n"), r("mean_input_n", 4).alias("mean_input_n"), r("mi_mult").alias("mi_mult"))


@query(
    "comp_reweight_francis",
    f"""WITH {OBSEXP}, m AS (SELECT fleet, year, max(n) AS n, sum(obs * bin) / sum(obs) AS mo, sum(exp * bin) / sum(exp) AS me, sum(exp * bin * bin) / sum(exp) AS m2 FROM oe GROUP BY ALL)
        SELECT fleet, round(1 / var_samp((mo - me) / sqrt((m2 - me * me) / n)), 6) AS francis_mult FROM m GROUP BY fleet""",
)
def _(t):
    out = comps.reweight_francis(_obs_exp(t), ["fleet"], ["year"])
    return out.select("fleet", r("francis_mult").alias("francis_mult"))


@query(
    "comp_mean_bin",
    """WITH m AS (SELECT l_returnflag AS fleet, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS t, sum(l_quantity * l_linenumber) AS s1, sum(l_quantity * l_linenumber * l_linenumber) AS s2 FROM lineitem GROUP BY ALL)
       SELECT fleet, year, t AS n, round(s1 / t, 6) AS mean_bin, round(s1 / t - 1.96 * sqrt((s2 / t - (s1 / t) * (s1 / t)) / t), 6) AS lower, round(s1 / t + 1.96 * sqrt((s2 / t - (s1 / t) * (s1 / t)) / t), 6) AS upper FROM m""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("fleet"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("bin"), F.col("l_quantity").alias("number")
    )
    out = comps.mean_bin(rows, ["fleet", "year"])
    return out.select("fleet", "year", "n", *[r(c).alias(c) for c in ("mean_bin", "lower", "upper")])


@query("comp_pearson_resid", f"WITH {OBSEXP} SELECT fleet, year, bin, round((obs - exp) / sqrt(exp * (1 - exp) / n), 6) AS pearson FROM oe")
def _(t):
    return comps.pearson(_obs_exp(t)).select("fleet", "year", "bin", r("pearson").alias("pearson"))


@query(
    "comp_loglik",
    f"WITH {OBSEXP} SELECT fleet, year, round(sum(n * (obs + 0.00001) * ln(exp + 0.00001)), 4) AS loglik FROM oe GROUP BY ALL",
)
def _(t):
    return comps.multinomial_fit(_obs_exp(t), ["fleet", "year"]).select("fleet", "year", r("loglik", 4).alias("loglik"))


# --- double reads -----------------------------------------------------------
def _reads(t):
    return t.orders.select(
        F.col("o_orderkey").alias("fish_id"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey") % 6).alias("read_age"),
        F.when(F.col("o_custkey") % 13 != 0, (F.col("o_custkey") + F.col("o_orderkey") % 2) % 6).alias("test_age"),
        F.col("o_orderpriority").alias("reader_name"),
        pick(PRIORITIES, (F.substring("o_orderpriority", 1, 1).cast("int") + F.col("o_orderkey") % 3) % 5).alias("tester_name"),
    )


READS = f"""reads AS (SELECT * FROM (SELECT o_orderkey AS fish_id, CASE WHEN o_custkey % 11 <> 0 THEN o_custkey % 6 END AS read_age,
   CASE WHEN o_custkey % 13 <> 0 THEN (o_custkey + o_orderkey % 2) % 6 END AS test_age, o_orderpriority AS reader_name,
   {sql_pick(PRIORITIES, "(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + o_orderkey % 3) % 5")} AS tester_name FROM orders)
   WHERE read_age IS NOT NULL AND test_age IS NOT NULL AND fish_id <> 55)"""


@query(
    "age_reads_prepare",
    f"WITH {READS}, l AS (SELECT fish_id, read_age AS age, reader_name AS name FROM reads UNION ALL SELECT fish_id, test_age, tester_name FROM reads), w AS (SELECT fish_id, "
    + ", ".join(f"coalesce(max(age) FILTER (name = '{p}'), -999) AS \"{p}\"" for p in PRIORITIES)
    + " FROM l GROUP BY 1) SELECT * EXCLUDE (fish_id), count(*) AS dupe_count FROM w GROUP BY ALL HAVING count(*) >= 2",
)
def _(t):
    return ageing.reads_by_reader(_reads(t), PRIORITIES, bad_ids=[55])


@query(
    "age_reads_pooled",
    f"WITH {READS} SELECT read_age AS reader1, test_age AS reader2, count(*) AS dupe_count FROM reads GROUP BY ALL HAVING count(*) >= 2",
)
def _(t):
    return ageing.reads_by_reader(_reads(t), [], bad_ids=[55], pooled=True)


@query(
    "age_reads_and_tests",
    f"""WITH {READS} SELECT name, CAST(sum(r) AS BIGINT) AS reads, CAST(sum(1 - r) AS BIGINT) AS tests
        FROM (SELECT reader_name AS name, 1 AS r FROM reads UNION ALL SELECT tester_name, 0 FROM reads) GROUP BY 1""",
)
def _(t):
    return ageing.reads_and_tests(_reads(t), [55])


@query(
    "age_reader_crosstab",
    f"WITH {READS} SELECT reader_name, "
    + ", ".join(f"count(*) FILTER (tester_name = '{p}') AS \"{p}\"" for p in PRIORITIES)
    + " FROM reads GROUP BY 1",
)
def _(t):
    return ageing.reader_tester_crosstab(_reads(t), PRIORITIES, [55])


@query(
    "age_reads_agreement",
    f"""WITH {READS} SELECT reader_name, count(*) AS reads, round(avg(read_age - test_age), 6) AS mean_offset, round(stddev_samp(read_age - test_age), 6) AS sd_offset,
        round(avg(CASE WHEN read_age = test_age THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM reads GROUP BY 1""",
)
def _(t):
    out = ageing.read_offsets(_reads(t), [55])
    return out.select("reader_name", "reads", *[r(c).alias(c) for c in ("mean_offset", "sd_offset", "agreement")])
