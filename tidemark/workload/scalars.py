"""Scalar functions (section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, nulls, rounding, stats, text
from ..operators.windows import rescale_min
from .bindings import LANDINGS, SURVEY, WEEK_SQL, landings, r, sql_round_even, survey
from .registry import query

URGENCY = {"1-URGENT": "now", "2-HIGH": "now", "3-MEDIUM": "later", "5-LOW": "later"}


@query(
    "fn_case_recode",
    """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'now' WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'later' END AS urgency,
        CASE o_orderstatus WHEN 'F' THEN 'Filled' ELSE o_orderstatus END AS status, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL""",
)
def _(t):
    rows = t.orders.select(
        nulls.recode("o_orderpriority", URGENCY).alias("urgency"),
        nulls.recode("o_orderstatus", {"F": "Filled"}, keep_unmapped=True).alias("status"),
        "o_totalprice",
    )
    return rows.groupBy("urgency", "status").agg(r(F.sum("o_totalprice"), 2).alias("price"))


@query(
    "fn_ifelse",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
       SELECT o_orderkey, CASE WHEN v IS NULL THEN NULL WHEN v > 200000 THEN 'big' ELSE 'small' END AS size FROM x""",
)
def _(t):
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.select("o_orderkey", nulls.if_else(v > 200000, "big", "small").alias("size"))


@query(
    "fn_coalesce",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, 0.0) AS value FROM orders""",
)
def _(t):
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return t.orders.select("o_orderkey", nulls.coalesce_value(v, 0.0).alias("value"))


@query(
    "fn_substr",
    "SELECT o_orderkey, CAST(substr(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 1, 4) AS INTEGER) AS year, substr(CAST(o_orderkey AS VARCHAR), 2, 3) AS digits FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        text.fixed_slice("o_orderdate", 1, 4).cast("int").alias("year"),
        text.fixed_slice("o_orderkey", 2, 3).alias("digits"),
    )


@query(
    "fn_concat",
    """SELECT l_orderkey, l_linenumber, l_returnflag || '-' || coalesce(CASE WHEN l_linestatus = 'F' THEN 'F' END, 'NA') AS label,
              'replist' || l_linenumber AS run FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        text.paste("l_returnflag", F.when(F.col("l_linestatus") == "F", "F"), sep="-").alias("label"),
        text.paste(F.lit("replist"), "l_linenumber").alias("run"),
    )


@query(
    "fn_regex_replace",
    """SELECT p_partkey, regexp_replace(p_name, '[aeiou ]', '', 'g') AS consonants,
              TRY_CAST(replace(printf('%,d', CAST(p_partkey * 1000 AS BIGINT)), ',', '') AS DOUBLE) AS back FROM part""",
)
def _(t):
    printed = F.format_number(F.col("p_partkey") * 1000, 0)
    return t.part.select(
        "p_partkey", text.strip_pattern("p_name", "[aeiou ]").alias("consonants"), text.comma_number(printed).alias("back")
    )


@query(
    "fn_split_index",
    """SELECT o_orderkey, split_part(l, '_', 3) AS year_text, split_part(o_orderpriority, '-', 2) AS name, split_part(o_orderpriority, '-', 1) AS rank
       FROM (SELECT *, 'Main_RecrDev_' || year(o_orderdate) AS l FROM orders)""",
)
def _(t):
    label = F.concat(F.lit("Main_RecrDev_"), F.year("o_orderdate").cast("string"))
    return t.orders.select(
        "o_orderkey",
        text.part_of(label, 3, "_", 3).alias("year_text"),
        text.part_of("o_orderpriority", 2, "-").alias("name"),
        text.part_of("o_orderpriority", 1, "-").alias("rank"),
    )


@query(
    "fn_basename",
    "SELECT page_id, string_split(url, '/')[-1] AS base, string_split(url, '/')[-2] AS parent FROM pages",
)
def _(t):
    return t.pages.select("page_id", text.base_name("url").alias("base"), text.parent_name("url").alias("parent"))


@query(
    "fn_upper_title",
    """SELECT p_partkey, upper(p_name) AS up, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""",
)
def _(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), text.title_case("p_name").alias("title"))


@query(
    "fn_format_number",
    "SELECT o_orderkey, printf('%,d', CAST(round_even(o_totalprice, 0) AS BIGINT)) AS whole, format('{:,.2f}', o_totalprice) AS two FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        rounding.with_commas(F.bround("o_totalprice", 0), 0).alias("whole"),
        rounding.with_commas("o_totalprice", 2).alias("two"),
    )


@query(
    "fn_value_sd_text",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS VARCHAR) END, '') || ' (' ||
              coalesce(CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END, '') || ')' AS cell FROM orders""",
)
def _(t):
    v = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string"))
    s = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", rounding.value_sd_text(v, s).alias("cell"))


@query(
    "fn_small_value_mask",
    """SELECT event_id, CASE WHEN round_even(value, 0) = 0 THEN '<1' ELSE CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) END AS shown,
              CASE WHEN user_id % 5 = 0 THEN '' ELSE CAST(user_id % 5 AS VARCHAR) END AS blank FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", rounding.mask_small("value").alias("shown"), rounding.blank_zero(F.col("user_id") % 5).alias("blank")
    )


@query(
    "fn_parse_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS date FROM orders""",
)
def _(t):
    d = F.col("o_orderdate")
    written = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "MMM d, yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "M/d/yy"))
        .otherwise(F.lit("no date"))
    )
    return t.orders.select("o_orderkey", dates.parse_month_first(written).alias("date"))


@query(
    "fn_year_week",
    f"SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, {WEEK_SQL.format(d='o_orderdate')} AS week FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey", F.year("o_orderdate").alias("year"), dates.week_of_year("o_orderdate").alias("week")
    )


@query(
    "fn_month_quarter",
    "SELECT monthname(o_orderdate) AS month, 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY ALL",
)
def _(t):
    return t.orders.groupBy(
        dates.month_name("o_orderdate").alias("month"), dates.quarter_name("o_orderdate").alias("quarter")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_cohort",
    """SELECT CAST(year(l_shipdate) - p_size AS INTEGER) AS cohort, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy((F.year("l_shipdate") - F.col("p_size")).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_cv", f"WITH {SURVEY} SELECT year, area, round(sqrt(variance) / nullif(biomass, 0), 8) AS cv FROM survey")
def _(t):
    return survey(t).select("year", "area", r(stats.cv("variance", "biomass"), 8).alias("cv"))


@query(
    "fn_log_se",
    f"WITH {SURVEY} SELECT year, area, round(sqrt(ln(1 + variance / (biomass * biomass))), 8) AS log_se FROM survey",
)
def _(t):
    return survey(t).select("year", "area", r(stats.log_se(stats.cv("variance", "biomass")), 8).alias("log_se"))


@query(
    "fn_ci",
    f"""WITH {SURVEY} SELECT year, area, round(biomass - sqrt(variance), 2) AS lci, round(biomass + sqrt(variance), 2) AS uci,
        round(biomass - 1.96 * sqrt(variance), 2) AS lci95, round(biomass + 1.96 * sqrt(variance), 2) AS uci95 FROM survey""",
)
def _(t):
    s = survey(t).withColumn("cv", stats.cv("variance", "biomass"))
    lo, hi = stats.limits("biomass", "cv")
    lo95, hi95 = stats.limits("biomass", "cv", stats.Z95)
    return s.select("year", "area", r(lo, 2).alias("lci"), r(hi, 2).alias("uci"), r(lo95, 2).alias("lci95"), r(hi95, 2).alias("uci95"))


@query(
    "fn_ratio_pct",
    f"""WITH {LANDINGS} SELECT year, zone, 100.0::DOUBLE * {sql_round_even("1 - sum(CASE WHEN type = 'D' THEN tons ELSE 0 END) / sum(tons)", 2)} AS pct,
        round(sum(CASE WHEN type = 'D' THEN tons ELSE 0 END) / sum(tons), 2) AS prop FROM landings GROUP BY ALL""",
)
def _(t):
    s = landings(t).groupBy("year", "zone").agg(
        F.sum(F.when(F.col("type") == "D", F.col("tons")).otherwise(0.0)).alias("d"), F.sum("tons").alias("c")
    )
    return s.select(
        "year",
        "zone",
        rounding.retained_percent("d", "c").alias("pct"),
        rounding.round_away(F.try_divide(F.col("d"), F.col("c")), 2).alias("prop"),
    )


@query(
    "fn_round_by_size",
    f"""SELECT event_id, CASE WHEN v < 1 THEN {sql_round_even('v', 2)} WHEN v > 1 THEN round_even(v, 0) ELSE v END AS shown
       FROM (SELECT event_id, value / 50 AS v FROM events)""",
)
def _(t):
    return t.events.select("event_id", rounding.round_by_size(F.col("value") / 50).alias("shown"))


@query(
    "fn_exp_log_seq",
    """WITH m AS (SELECT o_orderpriority AS model, avg(o_totalprice) / 100000 AS base FROM orders GROUP BY 1)
       SELECT model, CAST(i AS INTEGER) AS step, round(base * (0.6 + i * (9.4 / 9)), 6) AS scaled, round(ln(0.6 + i * (9.4 / 9)), 8) AS log_q
       FROM m, (SELECT unnest(generate_series(0, 9)) AS i)""",
)
def _(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg((F.avg("o_totalprice") / 100000).alias("base"))
    g = m.select("model", "base", F.posexplode(stats.log_steps(0.6, 10.0, 10)).alias("step", "log_q"))
    return g.select("model", "step", r(F.col("base") * F.exp("log_q")).alias("scaled"), r("log_q", 8).alias("log_q"))


@query(
    "fn_bin_length",
    """SELECT CAST(least(greatest(floor(x / 2) * 2, 6), 70) AS INTEGER) AS bin, count(*) AS n
       FROM (SELECT l_quantity * 1.4 + l_linenumber AS x FROM lineitem) GROUP BY 1""",
)
def _(t):
    x = F.col("l_quantity") * 1.4 + F.col("l_linenumber")
    return t.lineitem.groupBy(stats.length_bin(x).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_bin_age_plus",
    "SELECT CAST(least(greatest(p_size - 3, 1), 29) AS INTEGER) AS abin, count(*) AS n FROM part GROUP BY 1",
)
def _(t):
    return t.part.groupBy(stats.age_bin(F.col("p_size") - 3).alias("abin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fn_class_breaks",
    """SELECT CAST(CASE WHEN v <= 0 THEN 0 WHEN v <= 500 THEN 1 WHEN v <= 2000 THEN 2 WHEN v <= 5000 THEN 3 WHEN v <= 7500 THEN 4
              WHEN v <= 16000 THEN 5 ELSE 6 END AS INTEGER) AS class, count(*) AS n FROM (SELECT c_acctbal * 2 AS v FROM customer) GROUP BY 1""",
)
def _(t):
    return t.customer.groupBy(stats.class_of(F.col("c_acctbal") * 2).alias("class")).agg(F.count(F.lit(1)).alias("n"))


AIC_SQL = """m AS (SELECT o_orderpriority AS model, stddev_samp(o_totalprice) / 1000 AS nll, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 3 AS k, count(*) AS n FROM orders GROUP BY 1),
       a AS (SELECT model, 2 * nll + 2.0 * k + 2.0 * k * (k + 1) / (n - k - 1) AS aicc FROM m)"""


@query(
    "fn_aicc",
    f"WITH {AIC_SQL} SELECT model, round(aicc, 6) AS aicc, round(aicc - min(aicc) OVER (), 6) AS delta FROM a",
)
def _(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(
        (F.stddev_samp("o_totalprice") / 1000).alias("nll"), F.count(F.lit(1)).alias("n")
    )
    k = F.substring("model", 1, 1).cast("int") + 3
    a = m.select("model", stats.aicc("nll", k, "n").alias("aicc"))
    d = rescale_min(a, [], "aicc", "delta")
    return d.select("model", r("aicc").alias("aicc"), r("delta").alias("delta"))


@query(
    "fn_chisq_cut",
    f"WITH {AIC_SQL} SELECT model, (aicc - min(aicc) OVER ()) / 100 <= 1.920729 AS inside FROM a",
)
def _(t):
    m = t.orders.groupBy(F.col("o_orderpriority").alias("model")).agg(
        (F.stddev_samp("o_totalprice") / 1000).alias("nll"), F.count(F.lit(1)).alias("n")
    )
    k = F.substring("model", 1, 1).cast("int") + 3
    a = m.select("model", stats.aicc("nll", k, "n").alias("aicc"))
    d = rescale_min(a, [], "aicc", "delta")
    return d.select("model", (F.col("delta") / 100 <= stats.PROFILE_CUT).alias("inside"))
