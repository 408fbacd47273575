"""Projections, renames and filters (sections 2.3 and 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nulls
from ..operators import columns as cols, filters as flt
from .bindings import FISH, GEARS, LANDINGS, YEARS, fish, landings
from .registry import query


@query("proj_select_rename", "SELECT o_orderkey AS haul, o_custkey AS vessel, o_totalprice AS tons FROM orders")
def _(t):
    return cols.select_rename(t.orders, haul="o_orderkey", vessel="o_custkey", tons="o_totalprice")


@query(
    "proj_transmute_cast",
    """SELECT CAST(o_orderkey AS INTEGER) AS id, CAST(o_totalprice AS VARCHAR) AS price_text,
              TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS rank, TRY_CAST(o_orderpriority AS DOUBLE) AS bad
       FROM orders""",
)
def _(t):
    return cols.transmute(
        t.orders,
        id=F.col("o_orderkey").cast("int"),
        price_text=F.col("o_totalprice").cast("string"),
        rank=nulls.to_number(F.substring("o_orderpriority", 1, 1)),
        bad=nulls.to_number("o_orderpriority"),
    )


@query(
    "proj_constants",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS catch_mt, 1 AS seas, 1 AS fleet, 0.01::DOUBLE AS catch_se
       FROM lineitem GROUP BY 1""",
)
def _(t):
    catch = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("catch_mt"))
    return cols.add_constants(catch, seas=1, fleet=1, catch_se=0.01)


@query(
    "proj_select_by_pattern",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem",
)
def _(t):
    return cols.select_by_patterns(
        t.lineitem, ["l_orderkey"], ["number$", "quantity", "flag$|status$", "discount|tax"]
    )


@query("proj_names_upper_lower", "SELECT n_nationkey AS N_NATIONKEY, n_name AS N_NAME, c_custkey AS C_CUSTKEY FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return cols.upper_names(cols.lower_names(j).select("n_nationkey", "n_name", "c_custkey"))


@query(
    "proj_clean_names",
    "SELECT p_partkey AS collection_year, p_size AS adf_g_weight_kg, p_retailprice AS mean_price FROM part",
)
def _(t):
    raw = t.part.select(
        F.col("p_size").alias("ADF&G Weight (kg)"),
        F.col("p_partkey").alias("Collection.Year"),
        F.col("p_retailprice").alias("meanPrice"),
    )
    return cols.clean_names(raw, first=("collection_year",), sort=True)


@query("proj_drop", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return cols.drop_columns(t.supplier, "s_acctbal", "s_nationkey")


@query(
    "proj_add_missing_cols",
    f"WITH {LANDINGS} SELECT year, "
    + ", ".join(f"sum(CASE WHEN gear = '{g}' THEN tons END) AS {g}" for g in sorted(set(GEARS)))
    + ", 0.0::DOUBLE AS DIV FROM landings GROUP BY year",
)
def _(t):
    from ..operators.reshape import pivot_wide

    gears = sorted(set(GEARS))
    wide = pivot_wide(landings(t), ["year"], "gear", "tons", gears, combine="sum")
    return cols.with_expected_columns(wide, [*gears, "DIV"], ["year"])


@query(
    "proj_distinct_values",
    """SELECT l_returnflag, string_agg(DISTINCT CAST(year(l_shipdate) AS VARCHAR), ', ' ORDER BY CAST(year(l_shipdate) AS VARCHAR)) AS years
       FROM lineitem GROUP BY 1""",
)
def _(t):
    return cols.distinct_text(t.lineitem.withColumn("y", F.year("l_shipdate")), "y", ["l_returnflag"], "years")


# --- filters ----------------------------------------------------------------
@query(
    "flt_compare_range",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
       WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus <> 'P' AND o_custkey > 10 AND o_custkey < 1000""",
)
def _(t):
    mid = flt.in_range(t.orders, "o_totalprice", 100000, 200000)
    mid = flt.in_range(mid.where(F.col("o_orderstatus") != "P"), "o_custkey", 10, 1000, open_ends=True)
    return mid.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query(
    "flt_in_list",
    f"WITH {LANDINGS} SELECT year, gear, sum(tons) AS tons FROM landings WHERE gear IN ('NPT','HAL','JIG') AND gear NOT IN ('JIG') GROUP BY ALL",
)
def _(t):
    kept = flt.keep_members(landings(t), "gear", ["NPT", "HAL", "JIG"], exclude=["JIG"])
    return kept.groupBy("year", "gear").agg(F.sum("tons").alias("tons"))


@query("flt_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|small) .*g')")
def _(t):
    return flt.keep_matching(t.part, "p_name", "^(red|small) .*g").select("p_partkey", "p_name")


@query(
    "flt_not_null",
    f"WITH {FISH} SELECT year, count(*) AS n FROM fish WHERE age IS NOT NULL AND weight IS NOT NULL GROUP BY year",
)
def _(t):
    return flt.require_values(fish(t), "age", "weight").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_outlier_key",
    """SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (67, 13)
         AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1""",
)
def _(t):
    known = flt.drop_known(t.lineitem, "l_suppkey", [67, 13])
    bad = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return flt.drop_listed(known, bad, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_group_having",
    """WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 400000 THEN o_totalprice END AS big FROM orders)
       SELECT * FROM x WHERE o_custkey IN (SELECT o_custkey FROM x WHERE big IS NOT NULL)""",
)
def _(t):
    x = t.orders.select(
        "o_custkey", "o_orderkey", F.when(F.col("o_totalprice") > 400000, F.col("o_totalprice")).alias("big")
    )
    return flt.groups_with_a_value(x, ["o_custkey"], "big")


@query(
    "flt_group_min",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
       QUALIFY l_quantity = min(l_quantity) OVER (PARTITION BY l_suppkey)""",
)
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return flt.group_minimum(rows, ["l_suppkey"], "l_quantity")


@query("flt_abs_threshold", "SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal) > 5000")
def _(t):
    return flt.beyond(t.customer, "c_acctbal", 5000.0).select("c_custkey", "c_acctbal")


@query(
    "flt_all_null_row",
    """SELECT o_orderkey, a, b FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a,
       CASE WHEN o_totalprice > 450000 THEN o_custkey END AS b FROM orders) WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def _(t):
    x = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("a"),
        F.when(F.col("o_totalprice") > 450000, F.col("o_custkey")).alias("b"),
    )
    return flt.drop_empty_vectors(x, ["a", "b"])


@query(
    "flt_exclude_flag",
    f"""WITH {LANDINGS}, h AS (SELECT year, zone, count(DISTINCT date) AS nsamp FROM landings GROUP BY ALL)
        SELECT year, zone, nsamp, CASE WHEN year < 1996 THEN -2 WHEN nsamp < 300 THEN -1 ELSE 1 END AS fleet FROM h""",
)
def _(t):
    h = landings(t).groupBy("year", "zone").agg(F.count_distinct("date").alias("nsamp"))
    flag = flt.fleet_flag(F.lit(1), (F.col("nsamp") < 300, -1), (F.col("year") < YEARS[1], -2))
    return h.withColumn("fleet", flag)
