"""Reading, repairing and labelling raw extracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from episcope.functions import expr
from episcope.operators import clean, joins, rules, windows
from episcope.plans import surveillance
from episcope.session import shared_folder
from episcope.sources import tables as src
from workbook.registry import query, table
from workbook.tables import events

# The same raw text in SQL: season years are moved from 1995.. to 2009.. so that phases and denominators apply.
RAW = """raw AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN ' ' ELSE yr || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') END AS season,
    yr AS year, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CASE WHEN o_orderpriority = '1-URGENT' THEN '5-11 yr' ELSE o_orderpriority END AS age_cat,
    CASE WHEN o_orderstatus = 'F' THEN 'Overall' ELSE o_orderstatus END AS race_cat,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN round(o_totalprice / 1000, 1) END AS weekly_rate,
    round(o_totalprice / 500, 1) AS cum_rate
  FROM (SELECT *, year(o_orderdate) + 14 AS yr FROM orders) WHERE o_orderkey % 3 <> 0)"""


def _raw(spark, sf):
    """Orders written out the way a raw extract looks: text cells, padded, with markers and footer rows."""
    o = table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate") + 14)
    key = F.col("o_orderkey")
    season = F.concat(F.col("yr").cast("string"), F.lit("-"), F.lpad(((F.col("yr") + 1) % 100).cast("string"), 2, "0"))
    rate = F.round(F.col("o_totalprice") / 1000, 1).cast("string")
    return o.select(
        key,
        F.lit("Entire Network").alias("CATCHMENT"),
        F.when(key % 3 == 0, "State A").otherwise(" Entire network ").alias("NETWORK"),
        F.when(key % 50 == 0, " ").otherwise(season).alias("YEAR"),
        F.concat(F.col("yr").cast("string"), F.lit(".0")).alias("YEAR.1"),
        F.weekofyear("o_orderdate").cast("string").alias("WEEK"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "5-11  yr").otherwise(F.col("o_orderpriority")).alias("AGE CATEGORY"),
        F.when(F.col("o_orderstatus") == "F", "Overall").otherwise(F.col("o_orderstatus")).alias("RACE CATEGORY"),
        F.when(key % 7 == 0, "X").when(key % 11 == 0, " null ").otherwise(F.concat(F.lit(" "), rate)).alias("WEEKLY RATE"),
        F.round(F.col("o_totalprice") / 500, 1).cast("string").alias("CUMULATIVE RATE"))


EXTRACT = f"""WITH {RAW},
j AS (SELECT *, make_date(year, 1, 4) AS jan4 FROM raw WHERE trim(season) <> '')
SELECT o_orderkey, season, year, week, age_cat, race_cat, weekly_rate, cum_rate,
  CASE WHEN year <= 2018 THEN 'pre_pandemic' WHEN year <= 2021 THEN 'disruption' WHEN year <= 2025 THEN 'recovery'
    ELSE 'unknown' END AS phase,
  CASE WHEN year < 2020 THEN 'bridged' WHEN year <= 2025 THEN 'unbridged' ELSE 'unknown' END AS denom_version,
  year AS season_year, CASE WHEN season = '2009-10' THEN 1 ELSE 0 END AS h1n1_flag,
  CASE WHEN season = '2020-21' AND race_cat <> 'Overall' AND weekly_rate IS NULL THEN 1 ELSE 0 END AS race_gap_flag,
  CAST(jan4 - CAST(isodow(jan4) AS INTEGER) + (week - 1) * 7 AS DATE) AS epiweek_date FROM j"""
EXTRACT_COLUMNS = ["o_orderkey", "season", "year", "week", "age_cat", "race_cat", "weekly_rate", "cum_rate", "phase",
                   "denom_version", "season_year", "h1n1_flag", "race_gap_flag", "epiweek_date"]


@query("clean_extract", EXTRACT)
def clean_extract(spark, sf):
    return surveillance.clean_extract(_raw(spark, sf)).select(*EXTRACT_COLUMNS)


@query("text_scan", EXTRACT)
def text_scan(spark, sf):
    """The same extract written as pipe-separated text, read back without a schema and cleaned."""
    folder = f"{shared_folder(spark)}/extract-{uuid.uuid4().hex}"
    raw = _raw(spark, sf)
    src.write_table(raw, folder, sep="|")
    back = src.read_table(spark, folder, sep="|").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))
    return surveillance.clean_extract(back).select(*EXTRACT_COLUMNS)


@query("correction_counts", """SELECT k.value, k.corrected, count(o_orderkey) AS n_rows
FROM (VALUES ('1-URGENT', 'urgent'), ('5-LOW', 'low'), ('9-NONE', 'none')) k(value, corrected)
LEFT JOIN orders ON o_orderpriority = k.value GROUP BY 1, 2""")
def correction_counts(spark, sf):
    return clean.correction_counts(table(spark, sf, "orders"), "o_orderpriority",
                                   {"1-URGENT": "urgent", "5-LOW": "low", "9-NONE": "none"})


@query("repeated_headers", """SELECT c_custkey, c_name, c_name AS "c_name.1", c_acctbal, c_name AS "c_name.2" FROM customer""")
def repeated_headers(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_name", "c_acctbal", "c_name")
    return src.dedupe_headers(df)


@query("required_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def required_columns(spark, sf):
    """The wanted columns are checked, the others dropped whether or not they are there."""
    df = table(spark, sf, "customer")
    src.require_columns(df, ["c_custkey", "c_mktsegment"])
    return clean.drop_if_present(df, [*[c for c in df.columns if c not in ("c_custkey", "c_mktsegment")], "c_unknown"])


@query("side_by_side", """SELECT * FROM (SELECT o_orderpriority, count(*) AS n_orders FROM orders GROUP BY 1)
JOIN (SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (o_orderpriority)""")
def side_by_side(spark, sf):
    o = table(spark, sf, "orders")
    left = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    right = o.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return joins.side_by_side(left, right, "o_orderpriority")


@query("csv_round_trip", """SELECT c_custkey, c_name, c_acctbal, CAST(DATE '2020-01-01' + CAST(c_custkey % 365 AS INTEGER) AS DATE)
  AS seen FROM customer WHERE c_custkey % 10 <> 3""")
def csv_round_trip(spark, sf):
    folder = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
    text = F.when(F.col("c_custkey") % 10 == 3, "not a date").otherwise(F.date_format(day, "yyyy-MM-dd"))
    src.write_table(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", text.alias("seen")), folder)
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    schema = StructType([StructField("c_custkey", LongType()), StructField("c_name", StringType()),
                         StructField("c_acctbal", DoubleType()), StructField("seen", StringType())])
    return src.read_table(spark, folder, schema, dates={"seen": "yyyy-MM-dd"}, drop_bad_dates=True)


@query("tagged_union", """SELECT source, count(*) AS n, count(segment) AS n_segment FROM (
  SELECT 'customer' AS source, c_nationkey AS nation, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_nationkey, NULL FROM supplier) GROUP BY 1""")
def tagged_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return src.tagged_union({"customer": a, "supplier": b}, "source").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("segment").alias("n_segment"))


@query("epiweek_dates", """SELECT year, week, CAST(jan4 - CAST(isodow(jan4) AS INTEGER) + (week - 1) * 7 AS DATE) AS start,
  CAST(jan4 - CAST(isodow(jan4) % 7 AS INTEGER) + (week - 1) * 7 AS DATE) AS exact_start, n FROM (
    SELECT year(o_orderdate) + 14 AS year, CAST(weekofyear(o_orderdate) AS INTEGER) AS week, count(*) AS n,
      make_date(year(o_orderdate) + 14, 1, 4) AS jan4 FROM orders GROUP BY ALL)""")
def epiweek_dates(spark, sf):
    weeks = table(spark, sf, "orders").groupBy((F.year("o_orderdate") + 14).alias("year"),
                                               F.weekofyear("o_orderdate").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.select("year", "week", expr.epiweek_date("year", "week").alias("start"),
                        expr.epiweek_date("year", "week", mmwr_exact=True).alias("exact_start"), "n")


@query("treatment_flags", """WITH p AS (SELECT c_custkey, c_nationkey AS month,
  CASE WHEN c_custkey % 4 = 0 THEN 999 ELSE CAST(c_custkey % 20 AS INTEGER) END AS start FROM customer)
SELECT c_custkey, nullif(start, 999) AS start_month, CASE WHEN start <> 999 THEN 1 ELSE 0 END AS treated_group,
  CASE WHEN start <> 999 AND month >= start THEN 1 ELSE 0 END AS post_treatment, month - nullif(start, 999) AS time_since_tx
FROM p""")
def treatment_flags(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("month"), F.when(
        F.col("c_custkey") % 4 == 0, 999).otherwise((F.col("c_custkey") % 20).cast("int")).alias("start_month"))
    out = clean.treatment_flags(c, "month", "start_month")
    return clean.sentinel_to_null(out, "start_month").drop("month")


@query("normalized_binary", """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' YES ' WHEN 1 THEN 'usual care'
  WHEN 2 THEN 'arm a' WHEN 3 THEN 'Arm B' END AS w FROM customer)
SELECT c_custkey, CASE lower(trim(w)) WHEN 'yes' THEN 1 WHEN 'usual care' THEN 0 WHEN 'arm a' THEN 0 WHEN 'arm b' THEN 1 END AS v
FROM t""")
def normalized_binary(spark, sf):
    m = F.col("c_custkey") % 5
    words = F.when(m == 0, " YES ").when(m == 1, "usual care").when(m == 2, "arm a").when(m == 3, "Arm B")
    return clean.normalize_binary(table(spark, sf, "customer").select("c_custkey", words.alias("v")), "v")


@query("ordinal_codes", """SELECT p_partkey, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 30 THEN 4 END AS education_code,
  least(greatest(p_retailprice, 950.0), 1500.0) AS clipped, coalesce(CASE WHEN p_size > 5 THEN p_size END, 0) AS filled FROM part""")
def ordinal_codes(spark, sf):
    p = table(spark, sf, "part")
    word = expr.ladder("p_size", [(30, "unknown"), (20, "Bachelor"), (10, "HS Grad")], "<HS")
    out = clean.lookup(p.withColumn("education", word), "education", clean.EDUCATION_CODES, "education_code")
    out = out.select("p_partkey", "education_code", expr.clip("p_retailprice", 950.0, 1500.0).alias("clipped"),
                     F.when(F.col("p_size") > 5, F.col("p_size")).alias("filled"))
    return clean.fill_zero(out, ["filled"])


@query("suffixed_join", """SELECT o_orderkey, o_custkey, o_totalprice AS notes_x, c_acctbal AS notes_y FROM orders
LEFT JOIN customer ON o_custkey = c_custkey""")
def suffixed_join(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("notes"))
    right = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("notes"))
    return joins.enrich(clean.suffix_columns(left, ["notes"], "_x"), clean.suffix_columns(right, ["notes"], "_y"), "o_custkey")


@query("skewed_enrich", """SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS k, o_totalprice FROM orders)
LEFT JOIN customer ON k = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
GROUP BY 1""")
def skewed_enrich(spark, sf):
    """A third of the orders belong to one customer; the shuffle form of the join is forced."""
    from workbook.tables import claims
    key = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("c_custkey")
    orders = table(spark, sf, "orders").select(key, F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    joined = joins.enrich(orders, claims(spark, sf).select("c_custkey", "r_name"), "c_custkey", rows=10)
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("total"))


@query("panel_files", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_pos FROM events GROUP BY 1""")
def panel_files(spark, sf):
    """Two panels cut from one table, written to the shared folder and read back."""
    folder = f"{shared_folder(spark)}/panels-{uuid.uuid4().hex}"
    ev = events(spark, sf).select("event_type", "value")
    src.write_panels({"low": ev.where("NOT value > 50"), "high": ev.where("value > 50")}, folder, partition_by=["event_type"])
    back = src.tagged_union({n: spark.read.parquet(f"{folder}/{n}") for n in ("low", "high")}, "panel")
    return back.groupBy(F.col("event_type").cast("string").alias("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("panel") == "high").alias("n_pos"))


@query("ranked_summary", """SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS rank FROM (
  SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def ranked_summary(spark, sf):
    summary = events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.rank_by(summary, "n", descending=True, tie=["event_type"])


@query("decision_prefixes", """SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%'
GROUP BY 1""")
def decision_prefixes(spark, sf):
    return table(spark, sf, "orders").where(rules.starts_with_any("o_orderpriority", ["1", "5"])).groupBy(
        "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
