"""Sources and sinks (sections 2.1 and 2.2).

The text files are written by Spark from the supplied tables into the shared
scratch folder, then read back through the readers under test. A report file
holds summary rows only (years x zones), so one file is small by construction
while the number of files grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import cv
from ..plans import comps
from ..session import scratch_dir
from ..sources import schemas, sinks, tables, text
from .bindings import CATCH_RUN, LANDINGS, SUMMARY, SURVEY, WEEK_SQL, catch_run, lengths, landings, r, scenario_summary, survey
from .registry import Tables, query
from .survey import FISHERY, LB, _fishery


def _report_files(t: Tables, lines: DataFrame, label: str, key: str = "file") -> str:
    """Write (file, part, place, value) as one ordered text file per key."""
    path = scratch_dir(t.spark, label)
    ordered = lines.repartition(key).sortWithinPartitions(key, "part", "place").select(key, "value")
    ordered.write.partitionBy(key).text(path)
    return path


def _fixed_lines(keys: DataFrame, key: str, part: int, texts: list[str]) -> DataFrame:
    """The same lines in every file."""
    arr = F.array(*[F.lit(x) for x in texts])
    return keys.select(key, F.lit(part).alias("part"), F.posexplode(arr).alias("place", "value")).select(
        key, "part", F.col("place").cast("double").alias("place"), "value"
    )


# --- tables -----------------------------------------------------------------
@query(
    "src_jdbc_query",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS biom, count(*) AS numhauls FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 ORDER BY 1""",
)
def _(t):
    # The SQL text of a remote pull, run over a registered view in place of the remote table.
    return tables.sql(
        t.spark,
        "SELECT year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS biom, count(*) AS numhauls FROM biomass_total "
        "WHERE o_orderstatus IN (:a, :b) GROUP BY 1 ORDER BY 1",
        views={"biomass_total": t.orders},
        a="F",
        b="O",
    )


@query(
    "src_jdbc_lazy",
    """SELECT c_custkey AS area_id, c_mktsegment AS area_type, o_orderkey, o_totalprice FROM customer
       LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 20""",
)
def _(t):
    area = t.customer.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") < 20))
    biomass = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    j = area.join(biomass, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(F.col("c_custkey").alias("area_id"), F.col("c_mktsegment").alias("area_type"), "o_orderkey", "o_totalprice")


SEARCHED = {"orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "events": ["user_id"]}


@query(
    "src_catalog_search",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, lower(any_value(typeof({c}))) AS data_type, count({c}) AS n_values FROM {t}"
        for t, cs in SEARCHED.items()
        for c in cs
    ),
)
def _(t):
    found = tables.footer_search(t.spark, {name: f"{t.folder}/{name}.parquet" for name in SEARCHED}, "key$|^user")
    return found.select("table_name", "column_name", "data_type", "n_values")


@query("src_table_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1")
def _(t):
    return tables.preview(t.orders, 1, ["o_orderkey"])


@query("src_csv", f"WITH {LANDINGS} SELECT year AS YEAR, zone AS ZONE, gear AS GEAR, gear AS GEAR1, type AS TYPE, sum(tons) AS TONS FROM landings GROUP BY ALL")
def _(t):
    path = scratch_dir(t.spark, "csv")
    rows = landings(t).groupBy("year", "zone", "gear", "type").agg(F.sum("tons").alias("tons"))
    out = rows.select(
        F.col("year").alias("YEAR"), F.col("zone").alias("ZONE"), F.col("gear").alias("GEAR"), F.col("gear").alias("GEAR1"),
        F.col("type").alias("TYPE"), F.col("tons").alias("TONS"),
    )
    out.write.option("header", True).option("sep", "\t").csv(path)
    return tables.delimited(t.spark, path, schemas.CATCH_RAW, sep="\t")


def _weekly_files(t: Tables) -> str:
    d = F.to_date("o_orderdate")
    week_end = F.date_add(F.trunc(d, "year"), (F.floor((F.dayofyear(d) - 1) / 7) * 7 + 6).cast("int"))
    week_end = F.least(week_end, F.last_day(F.make_date(F.year(d), F.lit(12), F.lit(1))))
    sums = t.orders.groupBy(
        F.year(d).alias("file"), week_end.alias("end"), F.col("o_orderpriority").alias("species")
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("c"))
    body = sums.select(
        "file",
        F.lit(1).alias("part"),
        (F.dayofyear("end") * 10 + F.substring("species", 1, 1).cast("int")).cast("double").alias("place"),
        F.concat(
            F.lit('"Sole, '), "species", F.lit('",'), F.date_format("end", "MM/dd/yyyy"), F.lit(","), F.col("c").cast("string")
        ).alias("value"),
    )
    head = _fixed_lines(
        sums.select("file").distinct(), "file", 0,
        ["Weekly production report", "Printed for inspection, not final", "", "ACCOUNT.NAME,WEEK.END.DATE,METRIC.TONS"],
    )
    return _report_files(t, head.unionByName(body), "weekly")


@query(
    "src_multi_csv_preamble",
    f"""SELECT 'Sole, ' || o_orderpriority AS species, CAST(year(o_orderdate) AS INTEGER) AS year, {WEEK_SQL.format(d='o_orderdate')} AS week, round(sum(o_totalprice), 2) AS catch FROM orders GROUP BY ALL""",
)
def _(t):
    w = text.weekly_catch(t.spark, _weekly_files(t))
    return w.where(F.col("species").rlike("^Sole")).select("species", "year", "week", "catch")


@query(
    "src_file_select",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, CAST(4 + count(DISTINCT CAST(least(floor((dayofyear(o_orderdate) - 1) / 7), 60) AS VARCHAR) || o_orderpriority) AS BIGINT) AS lines FROM orders WHERE year(o_orderdate) NOT IN (1995, 2001) GROUP BY 1""",
)
def _(t):
    lines = text.read_lines(t.spark, _weekly_files(t), glob="part-*")
    chosen = text.select_files(lines, keep=r"file=\d{4}", drop="1995|2001")
    year = F.regexp_extract("path", r"file=(\d{4})", 1)
    return chosen.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("lines"))


@query("src_whitespace_table", f"WITH {SUMMARY} SELECT stock, alt, year, metric, value FROM summary")
def _(t):
    path = scratch_dir(t.spark, "blank")
    rows = scenario_summary(t).select("stock", "alt", "year", "metric", "value")
    rows.select(F.concat_ws("  ", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.text(path)
    return text.whitespace_table(t.spark, path, schemas.SCENARIO_LONG)


@query(
    "src_whitespace_header",
    f"WITH {CATCH_RUN} SELECT 'stock' AS stock, year, Catch AS catch, ABC AS abc, OFL AS ofl, SSB AS ssb, TotBiom AS totbiom FROM catch_run",
)
def _(t):
    run = catch_run(t)
    body = run.select(
        (F.col("year") % 3).alias("file"),
        F.lit(1).alias("part"),
        F.col("year").cast("double").alias("place"),
        F.concat_ws(" ", F.lit("stock"), *[F.col(c).cast("string") for c in ("year", "Catch", "ABC", "OFL", "SSB", "TotBiom")]).alias("value"),
    )
    head = _fixed_lines(body.select("file").distinct(), "file", 0, ["Stock Year Catch ABC OFL SSB TotBiom"])
    path = _report_files(t, head.unionByName(body), "header")
    return text.whitespace_table(t.spark, f"{path}/*", schemas.SCENARIO_WIDE, header=True)


SETUP = [
    "settings", "# how many", "3", "# how often", "1", "1999 note before the marker",
    "#\there\tbegin\tthe\trows",
]


def _catch_files(t: Tables) -> str:
    sums = landings(t).groupBy(F.col("zone").alias("file"), "year").agg(F.sum("tons").alias("c"))
    body = sums.select("file", F.lit(1).alias("part"), F.col("year").cast("double").alias("place"), F.concat_ws(" ", "year", F.col("c").cast("string")).alias("value"))
    head = _fixed_lines(sums.select("file").distinct(), "file", 0, SETUP)
    return _report_files(t, head.unionByName(body), "setup")


@query("src_skip_lines", f"WITH {LANDINGS}, s AS (SELECT zone, year, sum(tons) AS catch FROM landings GROUP BY ALL) SELECT year, catch FROM s")
def _(t):
    return text.rows_after_marker(
        t.spark, f"{_catch_files(t)}/*", r"begin\s+the", r"^\d{4}\s+\S+$", "year int, catch double"
    )


def _vector_files(t: Tables, labels: list[tuple[str, str]], prefix: str = "") -> str:
    """Per area: label lines, each followed by a line with the values of all years."""
    s = survey(t).withColumn("cv", cv("variance", "biomass")).select(
        F.col("area").alias("file"), "year", r("biomass", 2).alias("biomass"), r("cv", 6).alias("cv")
    )
    # A vector is one value per calendar year of one area; all vectors come from one grouping.
    values = F.struct("year", *[F.col(col).cast("string").alias(f"v{i}") for i, (_, col) in enumerate(labels)])
    rows = s.groupBy("file").agg(F.array_sort(F.collect_list(values)).alias("_v"))
    lines = []
    for i, (label, _) in enumerate(labels):
        joined = F.concat(F.lit(" "), F.array_join(F.col(f"_v.v{i}"), " "))
        for part, value in ((2 * i, F.lit(prefix + label)), (2 * i + 1, joined)):
            lines.append(F.struct(F.lit(part).alias("part"), F.lit(0.0).alias("place"), value.alias("value")))
    out = rows.select("file", F.inline(F.array(*lines)))
    return _report_files(t, out, "vectors")


@query(
    "src_tagged_sections",
    f"""WITH {SURVEY}, s AS (SELECT area, year, round(biomass, 2) AS b, round(sqrt(variance) / biomass, 6) AS c FROM survey)
        SELECT area, year AS yrs, 'srv_est' AS tag, b AS value FROM s UNION ALL SELECT area, year, 'srv_cv', c FROM s""",
)
def _(t):
    path = _vector_files(t, [("yrs", "year"), ("srv_est", "biomass"), ("srv_cv", "cv")])
    v = text.report_vectors(t.spark, f"{path}/*")
    area = F.replace(F.regexp_extract("path", "file=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return v.select(area.alias("area"), "yrs", "tag", "value")


@query(
    "src_section_between",
    f"WITH {SURVEY} SELECT area, year, round(biomass, 2) AS biomass FROM survey",
)
def _(t):
    s = survey(t).select(F.col("area").alias("file"), "year", r("biomass", 2).alias("b"))
    keys = s.select("file").distinct()
    body = s.select("file", F.lit(1).alias("part"), F.col("year").cast("double").alias("place"), F.concat_ws(" ", "year", F.col("b").cast("string")).alias("value"))
    pre = _fixed_lines(keys, "file", 0, ["Preface 1 2", "columns year value"])
    post = _fixed_lines(keys, "file", 2, ["end of columns", "2001 99999", "1999 5"])
    path = _report_files(t, pre.unionByName(body).unionByName(post), "between")
    lines = text.lines_between(t.spark, f"{path}/*", "^columns year", "^end of columns")
    w = text.words("value")
    area = F.replace(F.regexp_extract("path", "file=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return lines.select(
        area.alias("area"), F.get(w, F.lit(0)).try_cast("int").alias("year"), F.get(w, F.lit(1)).try_cast("double").alias("biomass")
    )


CATCH_FIELDS, COMP_FRONT = ["yr", "seas", "fleet", "catch", "catch_se"], ["yr", "month", "fleet", "sex", "part", "nsamp"]


@query(
    "src_terminated_blocks",
    f"""WITH {LANDINGS}, {FISHERY}, k AS (SELECT CAST(year AS DOUBLE) AS yr, sum(tons) AS catch FROM landings GROUP BY 1), y AS (SELECT DISTINCT CAST(year AS DOUBLE) AS yr FROM freq)
        SELECT 0 AS block, yr, unnest(['seas', 'fleet', 'catch', 'catch_se']) AS field, unnest([1.0::DOUBLE, 1.0, catch, 0.01]) AS value FROM k
        UNION ALL SELECT 1, yr, unnest(['month', 'fleet', 'sex', 'part', 'nsamp']), unnest([7.0::DOUBLE, 1.0, 3.0, 0.0, 100.0]) FROM y
        UNION ALL SELECT 1, CAST(year AS DOUBLE), (CASE WHEN sex = 1 THEN 'F' ELSE 'M' END) || bin, round(freq, 8) FROM freq""",
)
def _(t):
    blocks = _data_blocks(t)

    def long(df, block, fields):
        each = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields]))
        return df.select(F.lit(block).alias("block"), "yr", each)

    catch = text.numeric_rows(blocks, 0, CATCH_FIELDS)
    cells = text.composition_block(blocks, 1, COMP_FRONT, LB)
    bins = cells.select(F.lit(1).alias("block"), "yr", F.concat("bin_sex", F.col("bin").cast("string")).alias("field"), r("freq", 8).alias("value"))
    return long(catch, 0, CATCH_FIELDS[1:]).unionByName(long(cells.select(COMP_FRONT).distinct(), 1, COMP_FRONT[1:])).unionByName(bins)


def _data_blocks(t: Tables) -> DataFrame:
    """A data file of a catch block and a composition block, read back as blocks."""
    freq = _fishery(t).withColumn("freq", F.format_string("%.12f", "freq"))
    wide = freq.groupBy("year").agg(
        *[F.max(F.when((F.col("sex") == s) & (F.col("bin") == b), F.col("freq"))).alias(f"{p}{b}") for s, p in ((1, "f"), (2, "m")) for b in LB]
    )
    rows = wide.select(
        F.lit("data").alias("file"), F.lit(3).alias("part"), F.col("year").cast("double").alias("place"),
        F.concat(
            F.concat_ws("\t", F.col("year").cast("string"), F.lit("7\t1\t3\t0\t100"), *[F.col(f"{p}{b}") for p in "fm" for b in LB]), F.lit(" # note")
        ).alias("value"),
    )
    catch = landings(t).groupBy("year").agg(F.sum("tons").alias("c")).select(
        F.lit("data").alias("file"), F.lit(1).alias("part"), F.col("year").cast("double").alias("place"),
        F.concat_ws("\t", F.col("year").cast("string"), F.lit("1\t1"), F.col("c").cast("string"), F.lit("0.01")).alias("value"),
    )
    keys = rows.select("file").distinct()
    out = (
        _fixed_lines(keys, "file", 0, ["#_Catch data: yr, seas, fleet, catch, catch_se"])
        .unionByName(catch)
        .unionByName(_fixed_lines(keys, "file", 2, ["-9999 0 0 0 0", "#", "# lengths"]))
        .unionByName(rows)
        .unionByName(_fixed_lines(keys, "file", 4, ["-9999 0 0 0"]))
    )
    path = _report_files(t, out, "blocks")
    return text.terminated_blocks(t.spark, f"{path}/*")


@query(
    "src_kv_report",
    f"""WITH {SURVEY}, s AS (SELECT area, year, round(biomass, 2) AS b, CAST(row_number() OVER (PARTITION BY area ORDER BY year) - 1 AS BIGINT) AS pos FROM survey)
        SELECT area, 'YEAR' AS tag, pos, CAST(year AS DOUBLE) AS value FROM s UNION ALL SELECT area, 'SURVEYBIOMASS', pos, b FROM s""",
)
def _(t):
    return _survey_report(t)


def _survey_report(t: Tables) -> DataFrame:
    path = _vector_files(t, [("YEAR - years of survey", "year"), ("SURVEYBIOMASS - biomass by year", "biomass")], prefix="#")
    kv = text.key_value_report(t.spark, f"{path}/*")
    area = F.replace(F.regexp_extract("path", "file=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return kv.select(area.alias("area"), "tag", "pos", F.col("value").try_cast("double").alias("value"))


@query(
    "src_many_runs",
    "SELECT o_orderpriority AS model, CAST(year(o_orderdate) AS INTEGER) AS Yr, round(sum(o_totalprice), 2) AS Bio_smry, count(*) AS n FROM orders GROUP BY ALL",
)
def _(t):
    path = scratch_dir(t.spark, "runs")
    runs = t.orders.groupBy(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("Yr")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("Bio_smry"), F.count(F.lit(1)).alias("n")
    )
    runs.write.partitionBy("model").option("header", True).csv(path)
    out = text.many_runs(t.spark, f"{path}/*/*.csv", "Yr int, Bio_smry double, n bigint")
    return out.withColumn("model", F.replace("model", F.lit("%20"), F.lit(" ")))


# --- sinks ------------------------------------------------------------------
@query("sink_csv_dated", f"WITH {LANDINGS} SELECT year, zone, sum(tons) AS tons, DATE '2022-10-13' AS pull_date FROM landings GROUP BY ALL")
def _(t):
    rows = landings(t).groupBy("year", "zone").agg(F.sum("tons").alias("tons"))
    path = sinks.snapshot(rows, scratch_dir(t.spark, "snapshot"), "2022-10-13", fmt="csv")
    back = t.spark.read.option("header", True).schema("year int, zone string, tons double, pull_date date").csv(path)
    return back


@query("sink_split_by_key", f"WITH {SURVEY} SELECT area, year, round(biomass, 2) AS biomass FROM survey")
def _(t):
    return _split_areas(t)


def _split_areas(t: Tables) -> DataFrame:
    s = survey(t).select("area", "year", r("biomass", 2).alias("biomass"))
    path = sinks.split_by_key(s, scratch_dir(t.spark, "split"), ["area"])
    return t.spark.read.schema("year int, biomass double, area string").parquet(path)


@query(
    "sink_tagged_sections",
    f"""WITH {SURVEY}, s AS (SELECT area, CAST(row_number() OVER (PARTITION BY area ORDER BY year) - 1 AS BIGINT) AS pos, year, round(biomass, 2) AS b, round(sqrt(variance) / biomass, 6) AS c, count(*) OVER (PARTITION BY area) AS n FROM survey)
        SELECT area, 'years of surveys' AS tag, pos, CAST(year AS DOUBLE) AS value FROM s UNION ALL SELECT area, 'survey estimates', pos, b FROM s
        UNION ALL SELECT area, 'survey stdev (or cvs)', pos, c FROM s UNION ALL SELECT DISTINCT area, 'number of surveys', CAST(0 AS BIGINT), CAST(n AS DOUBLE) FROM s
        UNION ALL SELECT area, 'sty endy', pos, v FROM (SELECT area, CAST(0 AS BIGINT) AS pos, CAST(min(year) AS DOUBLE) AS v FROM s GROUP BY 1 UNION ALL SELECT area, CAST(1 AS BIGINT), CAST(max(year) AS DOUBLE) FROM s GROUP BY 1)""",
)
def _(t):
    s = survey(t).select("area", "year", r("biomass", 2).alias("b"), r(cv("variance", "biomass")).alias("c"))
    lines = sinks.tagged_lines(
        s, ["area"], "year",
        [("# years of surveys", "year"), ("# survey estimates", "b"), ("# survey stdev (or cvs)", "c")],
        heads=[
            ("# sty endy", F.concat_ws("\t", F.min("year").cast("string"), F.max("year").cast("string"))),
            ("## number of surveys", F.count(F.lit(1)).cast("string")),
        ],
    )
    path = _report_files(t, lines.withColumnRenamed("area", "file"), "tagged")
    back = text.comment_sections(t.spark, f"{path}/*")
    area = F.replace(F.regexp_extract("path", "file=([^/]*)/", 1), F.lit("%20"), F.lit(" "))
    return back.select(area.alias("area"), "tag", "pos", F.col("value").try_cast("double").alias("value"))


_HEAD_SQL = ", ".join(f"({n}, '{'4' if n == 3 else line}')" for n, line in enumerate(SETUP, 1))


@query(
    "sink_template_replace",
    f"""WITH {LANDINGS}, s AS (SELECT zone, year + 1 AS year, sum(tons) AS c FROM landings GROUP BY ALL)
        SELECT zone, CAST(n AS BIGINT) AS n, value FROM (SELECT DISTINCT zone FROM s), (VALUES {_HEAD_SQL}) h(n, value)
        UNION ALL SELECT zone, CAST({len(SETUP)} + row_number() OVER (PARTITION BY zone ORDER BY year) AS BIGINT), year || ' ' || CAST(c AS VARCHAR) FROM s""",
)
def _(t):
    zone = F.regexp_extract("path", "file=([^/]*)/", 1).alias("file")
    lines = text.running_count(text.read_lines(t.spark, f"{_catch_files(t)}/*"), F.lit(True), "n").select(zone, "n", "value")
    new = landings(t).groupBy(F.col("zone").alias("file"), (F.col("year") + 1).cast("long").alias("n")).agg(F.sum("tons").alias("c"))
    new = new.select("file", "n", F.concat_ws(" ", F.col("n").cast("string"), F.col("c").cast("string")).alias("value"))
    out = sinks.replace_after_marker(lines, new, r"begin\s+the", count_line=3, by=["file"])
    path = _report_files(t, out.withColumnRenamed("n", "place"), "template")
    back = text.running_count(text.read_lines(t.spark, f"{path}/*"), F.lit(True), "n")
    return back.select(zone.alias("zone"), "n", "value")


def _comp_file(t: Tables) -> str:
    hauls = comps.haul_counts(lengths(t), F.col("year"), F.col("haul"))
    wide = comps.with_front_matter(_fishery(t), hauls, LB, fleet=1)
    lines = sinks.composition_lines(wide, COMP_FRONT, [f"{p}{b}" for p in "fm" for b in LB])
    return sinks.ordered_text(lines.select("yr", "value"), scratch_dir(t.spark, "comp"), ["yr"])


@query(
    "sink_comp_rows",
    f"""WITH {FISHERY} SELECT freq.year AS yr, 7 AS month, CASE WHEN hauls < 15 THEN -1 ELSE 1 END AS fleet, 3 AS sex, 0 AS part, hauls AS nsamp, CAST(6 + {2 * len(LB)} AS BIGINT) AS fields,
          (CASE WHEN freq.sex = 1 THEN 'f' ELSE 'm' END) || bin AS bin, round(freq, 8) AS freq FROM freq LEFT JOIN h ON freq.year = h.year""",
)
def _(t):
    w = text.words("value")
    front = [F.get(w, F.lit(i)).try_cast("bigint" if c == "nsamp" else "int").alias(c) for i, c in enumerate(COMP_FRONT)]
    names = F.array(*[F.lit(f"{p}{b}") for p in "fm" for b in LB])
    cells = t.spark.read.text(_comp_file(t)).select(
        *front, F.size(w).cast("long").alias("fields"), F.posexplode(F.slice(w, len(COMP_FRONT) + 1, F.size(w))).alias("_i", "_v")
    )
    return cells.select(*COMP_FRONT, "fields", F.get(names, F.col("_i")).alias("bin"), r(F.col("_v").try_cast("double"), 8).alias("freq"))


@query(
    "sink_kv_report",
    f"""WITH {LANDINGS}, s0 AS (SELECT zone, year, sum(tons) AS c FROM landings GROUP BY ALL), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY zone ORDER BY year) - 1 AS BIGINT) AS pos FROM s0)
        SELECT zone, 'FISHERYYEAR' AS tag, pos, CAST(year AS DOUBLE) AS value FROM s UNION ALL SELECT zone, 'TOTALCATCH', pos, c FROM s""",
)
def _(t):
    s = landings(t).groupBy("zone", "year").agg(F.sum("tons").alias("c"))
    lines = sinks.vector_lines(
        s, ["zone"], "year",
        [("FISHERYYEAR", "list years used in model", "year"), ("TOTALCATCH", "Total catch by year in metric tons", "c")],
        chunk=4,
    )
    path = sinks.ordered_text(lines, scratch_dir(t.spark, "kv"), ["part", "place"], by=["zone"])
    kv = text.key_value_report(t.spark, f"{path}/*")
    return kv.select(
        F.regexp_extract("path", "zone=([^/]*)/", 1).alias("zone"), "tag", "pos", F.col("value").try_cast("double").alias("value")
    )

