"""The given tables in the shapes the operators expect, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.plans.surveillance import TOTAL, cumulative_rate
from workbook.registry import table

def positive():
    return F.col("value") > 50


POPULATION = 250_000.0
AS_OF = "2001-11-04"
PANEL_DIMS = ("age_cat", "virus_cat")
SUPPRESSED = ("1998-99",)
PHASES = {1995: "pre_pandemic", 1996: "pre_pandemic", 1997: "pre_pandemic", 1998: "disruption", 1999: "disruption",
          2000: "recovery", 2001: "recovery"}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as claims with their area names; the code tables are 25 and 5 rows by definition of the data."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    areas = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, sf, "customer").join(F.broadcast(areas), "c_nationkey", "left")


CLAIMS = """claims AS (
  SELECT c.*, n.n_name, r.r_name FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a registry of arrivals with test results, temperature and symptoms."""
    li = table(spark, sf, "lineitem")
    status = lambda c: F.when(c, "positive").otherwise("negative")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.col("l_shipdate").cast("date").alias("arrival_date"),
        (F.lit(97.0) + F.col("l_quantity") / 12.0).alias("temp"),
        F.when(F.col("l_tax") >= 0.04, "fever, cough").otherwise(" None ").alias("symptoms"),
        status((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R")).alias("lice_status"),
        status((F.col("l_linenumber") == 6) & (F.col("l_linestatus") == "O")).alias("varicella_status"),
        status((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("covid_status"),
        status((F.col("l_returnflag") == "N") & (F.col("l_discount") > 0.045)).alias("flu_status"))


REGISTRY = """registry AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS arrival_date,
    97.0 + l_quantity / 12.0 AS temp,
    CASE WHEN l_tax >= 0.04 THEN 'fever, cough' ELSE ' None ' END AS symptoms,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN 'positive' ELSE 'negative' END AS lice_status,
    CASE WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN 'positive' ELSE 'negative' END AS varicella_status,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'positive' ELSE 'negative' END AS covid_status,
    CASE WHEN l_returnflag = 'N' AND l_discount > 0.045 THEN 'positive' ELSE 'negative' END AS flu_status
  FROM lineitem)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a pre-cubed weekly table: season, week, priority (age) and status (virus), with totals as rows.

    Row data is reduced to week x priority x status first; the totals come from those few cells.
    """
    orders = table(spark, sf, "orders")
    day = F.date_trunc("week", F.col("o_orderdate")).cast("date")
    cells = orders.groupBy(day.alias("epiweek_date"), F.col("o_orderpriority").alias("age_cat"),
                           F.col("o_orderstatus").alias("virus_cat")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    cube = cells.groupingSets([["epiweek_date", "age_cat", "virus_cat"], ["epiweek_date", "age_cat"],
                               ["epiweek_date", "virus_cat"], ["epiweek_date"]],
                              "epiweek_date", "age_cat", "virus_cat").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    start = F.year("epiweek_date") - F.when(F.month("epiweek_date") < 10, 1).otherwise(0)
    phase = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    weekly = cube.select(
        F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")).alias("season"),
        F.coalesce(F.try_element_at(phase, start), F.lit("unknown")).alias("phase"),
        "epiweek_date", F.weekofyear("epiweek_date").cast("long").alias("week"),
        F.coalesce("age_cat", F.lit(TOTAL)).alias("age_cat"), F.coalesce("virus_cat", F.lit(TOTAL)).alias("virus_cat"),
        F.when(F.col("n") % 7 != 0, F.floor(F.col("amount").cast("double") / 1000.0) / 100.0).alias("weekly_rate"))
    return cumulative_rate(weekly, ["season", *PANEL_DIMS], "epiweek_date", "weekly_rate")


PANEL = """cells AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS epiweek_date, o_orderpriority AS age_cat,
    o_orderstatus AS virus_cat, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
  FROM orders GROUP BY 1, 2, 3),
cube AS (
  SELECT epiweek_date, coalesce(age_cat, 'Overall') AS age_cat, coalesce(virus_cat, 'Overall') AS virus_cat,
    sum(n) AS n, sum(amount) AS amount
  FROM cells GROUP BY GROUPING SETS ((epiweek_date, age_cat, virus_cat), (epiweek_date, age_cat),
    (epiweek_date, virus_cat), (epiweek_date))),
weekly AS (
  SELECT *, year(epiweek_date) - CASE WHEN month(epiweek_date) < 10 THEN 1 ELSE 0 END AS start_year FROM cube),
panel AS (
  SELECT start_year || '-' || lpad(CAST((start_year + 1) % 100 AS VARCHAR), 2, '0') AS season,
    CASE WHEN start_year IN (1995, 1996, 1997) THEN 'pre_pandemic' WHEN start_year IN (1998, 1999) THEN 'disruption'
      WHEN start_year IN (2000, 2001) THEN 'recovery' ELSE 'unknown' END AS phase,
    epiweek_date, CAST(weekofyear(epiweek_date) AS BIGINT) AS week, age_cat, virus_cat, weekly_rate,
    sum(weekly_rate) OVER (PARTITION BY start_year, age_cat, virus_cat ORDER BY epiweek_date) AS cum_rate
  FROM (SELECT *, CASE WHEN n % 7 <> 0 THEN floor(CAST(amount AS DOUBLE) / 1e3) / 1e2 END AS weekly_rate
        FROM weekly))"""


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as scored cases: label = returned, score = a fixed blend with many ties."""
    li = table(spark, sf, "lineitem")
    score = F.round(F.lit(0.02) + F.col("l_quantity") / 100.0 + F.col("l_discount") * 2.0
                    + F.when(F.col("l_returnflag") == "R", 0.15).otherwise(0.0), 4)
    return li.select(flag_of(F.col("l_returnflag") == "R").alias("label"), score.alias("score"), "l_linestatus",
                     F.when(score >= 0.45, 1).otherwise(0).alias("pred"))


def flag_of(condition):
    return F.when(condition, 1).otherwise(0)


SCORED = """scored AS (
  SELECT label, score, l_linestatus, CASE WHEN score >= 0.45 THEN 1 ELSE 0 END AS pred FROM (
    SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus,
      round(0.02 + l_quantity / 100.0 + l_discount * 2.0
        + CASE WHEN l_returnflag = 'R' THEN 0.15 ELSE 0.0 END, 4) AS score
    FROM lineitem))"""
