"""Season panels, audits, reshaping and publication tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episcope.functions.expr import flag, leading_number, parse_interval, percent_cell
from episcope.operators import clean, filters, tabulate, windows
from episcope.operators.ordered import positions, quantiles
from episcope.plans import surveillance
from workbook.registry import query, table
from workbook.tables import PANEL, PANEL_DIMS, SUPPRESSED, claims, panel

KEYS = ["season", "age_cat", "virus_cat"]


def rounded(df, digits: int = 6, skip=()):
    """Round the double columns, so that both engines agree on the printed digits."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


@query("season_panel", f"""WITH {PANEL}
SELECT season, phase, epiweek_date, week, age_cat, virus_cat, weekly_rate, round(cum_rate, 4) AS cum_rate
FROM panel""")
def season_panel(spark, sf):
    return panel(spark, sf).withColumn("cum_rate", F.round("cum_rate", 4))


@query("season_summary", f"""WITH {PANEL}
SELECT season, age_cat, virus_cat, count(DISTINCT week) AS n_weeks, max(weekly_rate) AS peak_rate,
  arg_min(week, ROW(-coalesce(weekly_rate, 0), week)) AS peak_week, round(avg(weekly_rate), 9) AS mean_rate,
  round(max(cum_rate), 4) AS max_cum_rate FROM panel GROUP BY 1, 2, 3""")
def season_summary(spark, sf):
    out = tabulate.season_summary(panel(spark, sf), KEYS)
    return out.withColumns({"mean_rate": F.round("mean_rate", 9), "max_cum_rate": F.round("max_cum_rate", 4)})


@query("season_peaks", f"""WITH {PANEL}
SELECT season, virus_cat, arg_min(week, ROW(-coalesce(weekly_rate, 0), week)) AS peak_week,
  max(weekly_rate) AS peak_weekly_rate FROM panel WHERE age_cat = 'Overall' GROUP BY 1, 2""")
def season_peaks(spark, sf):
    return tabulate.peak(filters.stratum(panel(spark, sf), PANEL_DIMS, ["virus_cat"]), ["season", "virus_cat"],
                         "week", "weekly_rate")


@query("season_detail", f"""WITH {PANEL}
SELECT season, count(DISTINCT week) AS n_weeks, count(weekly_rate) AS n_obs,
  count(*) FILTER (WHERE weekly_rate IS NULL) AS n_missing, round(avg(weekly_rate), 9) AS mean_rate,
  round(stddev_samp(weekly_rate), 9) AS sd_rate, round(quantile_cont(weekly_rate, 0.25), 9) AS q1_rate,
  round(quantile_cont(weekly_rate, 0.5), 9) AS median_rate, round(quantile_cont(weekly_rate, 0.75), 9) AS q3_rate,
  round(min(weekly_rate), 9) AS min_rate, round(max(weekly_rate), 9) AS peak_rate,
  arg_min(week, ROW(-coalesce(weekly_rate, 0), week)) AS peak_week, round(max(cum_rate), 9) AS max_cum_rate,
  count(*) FILTER (WHERE weekly_rate >= 60) AS active_weeks
FROM panel WHERE age_cat = 'Overall' AND virus_cat = 'Overall' GROUP BY 1""")
def season_detail(spark, sf):
    return tabulate.season_detail(filters.stratum(panel(spark, sf), PANEL_DIMS), ["season"], active=60.0, digits=9)


@query("week_features", f"""WITH {PANEL},
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY season ORDER BY week) AS season_week_num FROM panel),
weeks AS (SELECT season, count(DISTINCT week) AS n_weeks_in_season FROM panel GROUP BY 1)
SELECT season, age_cat, virus_cat, epiweek_date, week, season_week_num, n_weeks_in_season,
  round(ln(1 + coalesce(weekly_rate, 0)), 6) AS log1p_weekly_rate,
  lag(weekly_rate, 1) OVER w AS lag1_weekly_rate, lag(weekly_rate, 2) OVER w AS lag2_weekly_rate,
  lag(weekly_rate, 4) OVER w AS lag4_weekly_rate,
  round(avg(weekly_rate) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS roll4_weekly_rate,
  CASE WHEN phase = 'recovery' THEN 1 ELSE 0 END AS phase_recovery,
  CAST(round_even(date_diff('day', DATE '2020-09-27', epiweek_date) / 7.0, 0) AS INTEGER) AS weeks_since_pandemic
FROM ranked JOIN weeks USING (season)
WINDOW w AS (PARTITION BY season, age_cat, virus_cat ORDER BY week, epiweek_date)""")
def week_features(spark, sf):
    out = surveillance.add_features(panel(spark, sf), PANEL_DIMS)
    return out.select("season", "age_cat", "virus_cat", "epiweek_date", "week", "season_week_num", "n_weeks_in_season",
                      F.round("log1p_weekly_rate", 6).alias("log1p_weekly_rate"), "lag1_weekly_rate",
                      "lag2_weekly_rate", "lag4_weekly_rate", F.round("roll4_weekly_rate", 6).alias("roll4_weekly_rate"),
                      "phase_recovery", "weeks_since_pandemic")


@query("row_lags", """SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  lag(l_quantity, 1) OVER w AS lag1_l_quantity, lag(l_quantity, 4) OVER w AS lag4_l_quantity
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_quantity, l_extendedprice)""")
def row_lags(spark, sf):
    li = table(spark, sf, "lineitem")
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return windows.lags(li, ["l_returnflag"], "l_shipdate", "l_quantity", (1, 4), tie=tie).select(
        "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "lag1_l_quantity", "lag4_l_quantity")


@query("row_rolling_mean", """SELECT event_type, event_id,
  round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5)
    AS roll4 FROM events""")
def row_rolling_mean(spark, sf):
    return windows.rolling_mean(table(spark, sf, "events"), ["event_type"], "ts", "value", 4, "roll4",
                                tie=["event_id"]).select("event_type", "event_id", F.round("roll4", 5).alias("roll4"))


@query("row_positions", """SELECT l_returnflag, pos, CAST(l_quantity AS BIGINT) AS qty FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber,
    l_partkey) AS pos FROM lineitem)""")
def row_positions(spark, sf):
    return positions(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice",
                     tie=["l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_returnflag", "pos", F.col("l_quantity").cast("long").alias("qty"))


@query("dedup_peak", """SELECT o_orderkey, o_orderstatus, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn
  FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def dedup_peak(spark, sf):
    return windows.resolve_duplicates(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", ["o_orderdate"],
                                      "o_totalprice", ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "o_totalprice")


@query("weekly_series", f"""WITH {PANEL}
SELECT epiweek_date, season, week, weekly_rate FROM panel
WHERE age_cat = 'Overall' AND virus_cat = 'Overall' AND season <> '2000-01'""")
def weekly_series(spark, sf):
    return surveillance.weekly_series(panel(spark, sf), PANEL_DIMS, ["2000-01"]).select(
        "epiweek_date", "season", "week", "weekly_rate")


TABLE_ONE = f"""WITH {PANEL},
strata AS (
  SELECT 'Overall' AS stratum_variable, 'Overall' AS stratum_value, * FROM panel
  WHERE age_cat = 'Overall' AND virus_cat = 'Overall'
  UNION ALL SELECT 'Age group', age_cat, * FROM panel
  WHERE virus_cat = 'Overall' AND age_cat IN ('1-URGENT', '2-HIGH', '5-LOW')
  UNION ALL SELECT 'Virus type', virus_cat, * FROM panel WHERE age_cat = 'Overall' AND virus_cat IN ('F', 'O')),
open AS (SELECT *, CASE WHEN season <> '1998-99' THEN weekly_rate END AS w, season <> '1998-99' AS is_open FROM strata),
seasons AS (
  SELECT phase, stratum_variable, stratum_value, season, max(w) AS peak, max(cum_rate) AS cum,
    CASE WHEN bool_or(is_open) THEN arg_min(week, ROW(-coalesce(w, 0), week)) END AS peak_week,
    CASE WHEN bool_or(is_open) THEN count(*) FILTER (WHERE w >= 10) END AS duration FROM open GROUP BY 1, 2, 3, 4),
s AS (
  SELECT phase, stratum_variable, stratum_value, count(*) AS n_seasons, avg(peak) AS peak_mean,
    stddev_samp(peak) AS peak_sd, avg(cum) AS cum_mean, stddev_samp(cum) AS cum_sd,
    quantile_cont(peak_week, 0.25) AS peak_week_q1, quantile_cont(peak_week, 0.5) AS peak_week_median,
    quantile_cont(peak_week, 0.75) AS peak_week_q3, quantile_cont(duration, 0.25) AS duration_q1,
    quantile_cont(duration, 0.5) AS duration_median, quantile_cont(duration, 0.75) AS duration_q3
  FROM seasons GROUP BY 1, 2, 3),
o AS (
  SELECT phase, stratum_variable, stratum_value, count(w) AS n_weeks_obs, quantile_cont(w, 0.25) AS weekly_q1,
    quantile_cont(w, 0.5) AS weekly_median, quantile_cont(w, 0.75) AS weekly_q3, avg(w) AS weekly_mean,
    stddev_samp(w) AS weekly_sd FROM open GROUP BY 1, 2, 3)"""
STRATA = {"Overall": (None, ["Overall"]), "Age group": ("age_cat", ["1-URGENT", "2-HIGH", "5-LOW"]),
          "Virus type": ("virus_cat", ["F", "O"])}


def _table_one(spark, sf):
    return surveillance.table_one(panel(spark, sf), STRATA, dims=PANEL_DIMS, suppressed=SUPPRESSED, active=10.0)


@query("table_one", TABLE_ONE + """
SELECT phase, stratum_variable, stratum_value, n_seasons, n_weeks_obs, round(peak_mean, 9) AS peak_mean,
  round(peak_sd, 9) AS peak_sd, round(cum_mean, 9) AS cum_mean, round(cum_sd, 9) AS cum_sd, peak_week_q1,
  peak_week_median, peak_week_q3, duration_q1, duration_median, duration_q3, round(weekly_q1, 9) AS weekly_q1,
  round(weekly_median, 9) AS weekly_median, round(weekly_q3, 9) AS weekly_q3, round(weekly_mean, 9) AS weekly_mean,
  round(weekly_sd, 9) AS weekly_sd FROM s JOIN o USING (phase, stratum_variable, stratum_value)""")
def table_one(spark, sf):
    return rounded(_table_one(spark, sf), 9)


CELL_ROWS = """
SELECT stratum_variable, stratum_value, phase, n_seasons, n_weeks_obs,
  CASE WHEN weekly_median IS NULL THEN '—' ELSE printf('%.1f (%.1f–%.1f)', round(round(weekly_median, 9), 1), round(round(weekly_q1, 9), 1), round(round(weekly_q3, 9), 1)) END
    AS weekly_median_iqr,
  CASE WHEN weekly_mean IS NULL THEN '—' WHEN weekly_sd IS NULL THEN printf('%.1f (nan)', round(round(weekly_mean, 9), 1))
    ELSE printf('%.1f (%.1f)', round(round(weekly_mean, 9), 1), round(round(weekly_sd, 9), 1)) END AS weekly_mean_sd,
  CASE WHEN peak_mean IS NULL THEN '—' WHEN peak_sd IS NULL THEN printf('%.1f (nan)', round(round(peak_mean, 9), 1))
    ELSE printf('%.1f (%.1f)', round(round(peak_mean, 9), 1), round(round(peak_sd, 9), 1)) END AS peak_rate_mean_sd,
  CASE WHEN cum_mean IS NULL THEN '—' WHEN cum_sd IS NULL THEN printf('%.1f (nan)', round(round(cum_mean, 9), 1))
    ELSE printf('%.1f (%.1f)', round(round(cum_mean, 9), 1), round(round(cum_sd, 9), 1)) END AS cum_rate_mean_sd
FROM s JOIN o USING (phase, stratum_variable, stratum_value)"""


@query("table_one_cells", TABLE_ONE + CELL_ROWS)
def table_one_cells(spark, sf):
    return surveillance.table_one_cells(_table_one(spark, sf)).drop("peak_week_median_iqr", "season_dur_median_iqr")


@query("table_one_layout", TABLE_ONE.rstrip().rstrip(",") + ", shown AS (" + CELL_ROWS + """),
wide AS (SELECT stratum_variable, stratum_value, """ + ", ".join(
    f"""max({m}) FILTER (WHERE phase = '{p}') AS "{t} {a}\"""" for m, t in (
        ("weekly_median_iqr", "Median Weekly Rate"), ("peak_rate_mean_sd", "Mean Peak Rate"))
    for p, a in (("pre_pandemic", "PRE"), ("disruption", "DISR"), ("recovery", "REC"))) + """ FROM shown GROUP BY 1, 2),
k(position, "Group", stratum_variable, stratum_value) AS (VALUES (0, 'Panel A. Overall', NULL, NULL), (1, 'Overall', 'Overall', 'Overall'),
  (999, '', NULL, NULL), (1000, 'Panel B. Age group', NULL, NULL), (1001, '1-URGENT', 'Age group', '1-URGENT'),
  (1002, '2-HIGH', 'Age group', '2-HIGH'), (1003, '5-LOW', 'Age group', '5-LOW'), (1999, '', NULL, NULL),
  (2000, 'Panel C. Virus type', NULL, NULL), (2001, 'F', 'Virus type', 'F'), (2002, 'O', 'Virus type', 'O'), (2003, 'X', 'Virus type', 'X'),
  (2999, '', NULL, NULL))
SELECT CAST(position AS BIGINT) AS position, "Group", """ + ", ".join(
    f"""CASE WHEN k.stratum_variable IS NULL THEN '' ELSE coalesce("{t} {a}", '—') END AS "{t} {a}\""""
    for t in ("Median Weekly Rate", "Mean Peak Rate") for a in ("PRE", "DISR", "REC")) + """
FROM k LEFT JOIN wide USING (stratum_variable, stratum_value) WHERE k.stratum_variable IS NULL OR wide.stratum_value IS NOT NULL""")
def table_one_layout(spark, sf):
    cells = surveillance.table_one_cells(_table_one(spark, sf))
    panels = [("Panel A. Overall", "Overall", ["Overall"]),
              ("Panel B. Age group", "Age group", ["1-URGENT", "2-HIGH", "5-LOW"]),
              ("Panel C. Virus type", "Virus type", ["F", "O", "X"])]
    return surveillance.layout(cells, panels, {"weekly_median_iqr": "Median Weekly Rate",
                                               "peak_rate_mean_sd": "Mean Peak Rate"},
                               {"pre_pandemic": "PRE", "disruption": "DISR", "recovery": "REC"})


@query("parsed_cells", TABLE_ONE + """
SELECT stratum_variable, stratum_value, phase, CAST(printf('%.1f', round(round(weekly_median, 9), 1)) AS DOUBLE) AS median,
  CAST(printf('%.1f', round(round(weekly_q1, 9), 1)) AS DOUBLE) AS low, CAST(printf('%.1f', round(round(weekly_q3, 9), 1)) AS DOUBLE) AS high,
  printf('%.1f%%', round(round(n_weeks_obs / 200e0 * 100, 9), 1)) AS share_cell
FROM s JOIN o USING (phase, stratum_variable, stratum_value)""")
def parsed_cells(spark, sf):
    cells = surveillance.table_one_cells(_table_one(spark, sf))
    inner = F.regexp_extract("weekly_median_iqr", r"\((.*)\)", 1)
    return cells.withColumn("i", parse_interval(inner)).select(
        "stratum_variable", "stratum_value", "phase", leading_number("weekly_median_iqr").alias("median"),
        F.col("i.low").alias("low"), F.col("i.high").alias("high"),
        percent_cell(F.col("n_weeks_obs") / 200.0).alias("share_cell"))


@query("dispersion", f"""WITH {PANEL},
strata AS (
  SELECT 'Overall' AS stratum, weekly_rate AS x FROM panel WHERE age_cat = 'Overall' AND virus_cat = 'Overall'
  UNION ALL SELECT 'Age', weekly_rate FROM panel WHERE virus_cat = 'Overall'
  UNION ALL SELECT 'Virus', weekly_rate FROM panel WHERE age_cat = 'Overall'),
m AS (SELECT stratum, avg(x) AS mu FROM strata GROUP BY 1),
c AS (
  SELECT stratum, count(x) AS n_obs, any_value(mu) AS mean, var_samp(x) AS variance,
    avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS skewness
  FROM strata JOIN m USING (stratum) GROUP BY 1)
SELECT stratum, n_obs, round(mean, 8) AS mean, round(variance, 8) AS variance, round(skewness, 8) AS skewness,
  round(variance / mean, 8) AS vmr, CASE WHEN variance / mean > 2 THEN 'overdispersed — NB appropriate'
    ELSE 'near-equidispersion — Poisson acceptable' END AS interpretation
FROM c WHERE n_obs >= 10""")
def dispersion(spark, sf):
    total = {d: F.col(d) == "Overall" for d in PANEL_DIMS}
    strata = {"Overall": total["age_cat"] & total["virus_cat"], "Age": total["virus_cat"], "Virus": total["age_cat"]}
    return rounded(tabulate.dispersion(panel(spark, sf), strata, "weekly_rate"), 8)


@query("coverage", f"""WITH {PANEL}
SELECT season, virus_cat, count(DISTINCT week) AS n_index, count(weekly_rate) AS n_obs,
  count(*) FILTER (WHERE weekly_rate IS NULL) AS n_null,
  round(count(weekly_rate) * 100.0 / count(*), 1) AS pct_available, count(DISTINCT week) < 20 AS short,
  count(weekly_rate) < 10 AS sparse FROM panel GROUP BY 1, 2""")
def coverage(spark, sf):
    return tabulate.coverage(panel(spark, sf), ["season", "virus_cat"], "week", "weekly_rate")


@query("missingness", f"""WITH {PANEL},
m AS (
  SELECT season, age_cat, avg(CASE WHEN weekly_rate IS NULL THEN 1 ELSE 0 END) AS weekly_rate,
    avg(CASE WHEN cum_rate IS NULL THEN 1 ELSE 0 END) AS cum_rate FROM panel GROUP BY 1, 2),
long AS (
  SELECT season, age_cat, 'weekly_rate' AS variable, weekly_rate AS miss_frac FROM m
  UNION ALL SELECT season, age_cat, 'cum_rate', cum_rate FROM m)
SELECT season, age_cat, variable, round(miss_frac, 6) AS miss_frac,
  miss_frac > 0.1 AND variable <> 'cum_rate' AND season <> '1998-99' AS flagged FROM long""")
def missingness(spark, sf):
    return rounded(tabulate.missingness(panel(spark, sf), ["season", "age_cat"], ["weekly_rate", "cum_rate"], 0.1,
                                        exempt=["cum_rate"], exempt_rows=F.col("season").isin(*SUPPRESSED)))


@query("missingness_audit", """WITH c AS (
  SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer),
a AS (
  SELECT 'seg' AS "column", count(*) AS t, count(*) FILTER (WHERE seg IS NULL) AS m,
    count(*) FILTER (WHERE seg IS NULL AND c_nationkey < 25) AS s FROM c
  UNION ALL SELECT 'bal', count(*), count(*) FILTER (WHERE bal IS NULL),
    count(*) FILTER (WHERE bal IS NULL AND c_nationkey < 12) FROM c
  UNION ALL SELECT 'c_name', count(*), count(*) FILTER (WHERE c_name IS NULL), 0 FROM c)
SELECT "column", t AS total_rows, m AS n_missing, s AS n_structural, m - s AS n_unexpected,
  round(m * 100.0 / t, 1) AS pct_missing, m > 0 AND m = s AS structural,
  CASE WHEN m = 0 THEN 'complete' WHEN m = s THEN 'all structural' ELSE (m - s) || ' unexpected' END AS note FROM a""")
def missingness_audit(spark, sf):
    df = table(spark, sf, "customer").withColumns({
        "seg": F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")),
        "bal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))})
    return tabulate.missingness_audit(df, {"seg": F.col("c_nationkey") < 25, "bal": F.col("c_nationkey") < 12,
                                           "c_name": F.lit(False)})


@query("domain_audit", """SELECT o_orderpriority, count(*) AS n,
  o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS known FROM orders GROUP BY 1""")
def domain_audit(spark, sf):
    return tabulate.domain_audit(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("unexpected_values", """SELECT o_orderpriority, count(*) AS n FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def unexpected_values(spark, sf):
    return tabulate.unexpected_values(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("levels_present", """SELECT CAST(position AS BIGINT) AS position, level FROM (VALUES (0, 'P'), (1, 'Z'), (2, 'F'))
  AS t(position, level) WHERE level IN (SELECT o_orderstatus FROM orders)""")
def levels_present(spark, sf):
    return tabulate.level_order(table(spark, sf, "orders"), "o_orderstatus", ["P", "Z", "F"])


@query("levels_subset", """SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) = 0 AS is_subset
FROM orders""")
def levels_subset(spark, sf):
    return tabulate.is_subset(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"])


@query("plausibility", """SELECT 'negative' AS rule, count(*) AS n_violations FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'too_high', count(*) FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'weekly_above_cumulative', count(*) FROM customer WHERE c_acctbal > c_nationkey * 300""")
def plausibility(spark, sf):
    df = table(spark, sf, "customer").withColumn("limit", F.col("c_nationkey") * 300)
    return filters.plausibility(df, filters.rate_rules("c_acctbal", "limit", 9000.0))


@query("coercion", """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN ' X ' WHEN o_orderkey % 13 = 0
  THEN 'n.a.' WHEN o_orderkey % 17 = 0 THEN 'NA' ELSE ' ' || CAST(o_orderkey % 1000 AS VARCHAR) || '.5 ' END AS raw
  FROM orders)
SELECT o_orderkey, TRY_CAST(CASE WHEN trim(raw) NOT IN ('X', 'NA') THEN trim(raw) END AS DOUBLE) AS raw,
  TRY_CAST(TRY_CAST(CASE WHEN trim(raw) NOT IN ('X', 'NA') THEN trim(raw) END AS DOUBLE) - 0.5 AS INTEGER) AS whole
FROM t""")
def coercion(spark, sf):
    return clean.coerce_int(clean.coerce_rate(_dirty(spark, sf), "raw").withColumn("whole", F.col("raw") - 0.5),
                            "whole").select("o_orderkey", "raw", "whole")


@query("coercion_failures", """SELECT 'raw' AS "column", count(*) AS n_failed FROM orders
WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0""")
def coercion_failures(spark, sf):
    return clean.coercion_failures(_dirty(spark, sf), ["raw"])


def _dirty(spark, sf):
    key = F.col("o_orderkey")
    raw = (F.when(key % 11 == 0, " X ").when(key % 13 == 0, "n.a.").when(key % 17 == 0, "NA")
           .otherwise(F.concat(F.lit(" "), (key % 1000).cast("string"), F.lit(".5 "))))
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (
  SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicate_keys(spark, sf):
    return tabulate.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("index_quality", """SELECT event_type, count(*) AS n_rows, count(*) - count(DISTINCT day) AS n_duplicates,
  count(*) FILTER (WHERE day < prev) = 0 AS monotonic FROM (
    SELECT event_type, day, lag(day) OVER (PARTITION BY event_type ORDER BY event_id) AS prev
    FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)) GROUP BY 1""")
def index_quality(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    return tabulate.index_quality(ev, ["event_type"], "event_id", "day")


@query("audit_log", """SELECT CAST(0 AS BIGINT) AS position, 'C01' AS step, 'trim' AS operation,
  (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS n_affected, 'negative balance' AS note
UNION ALL SELECT 1, 'C02', 'duplicates', (SELECT count(*) - count(DISTINCT o_custkey) FROM orders), 'orders'""")
def audit_log(spark, sf):
    steps = [("C01", "trim", table(spark, sf, "customer").agg(F.count_if(F.col("c_acctbal") < 0)), "negative balance"),
             ("C02", "duplicates", table(spark, sf, "orders").agg(
                 F.count(F.lit(1)) - F.countDistinct("o_custkey")), "orders")]
    return tabulate.audit_log(spark, steps)


REGIONAL = """regional AS (
  SELECT year(o_orderdate) AS yr, r_name, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def regional(spark, sf):
    """Order totals by year and region. Orders are first reduced to customer and year, so the join carries sums."""
    from episcope.operators.joins import enrich
    per_customer = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("yr")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("amount"))
    areas = claims(spark, sf).select("c_custkey", "r_name")
    return enrich(per_customer, areas, "c_custkey", how="inner").groupBy("yr", "r_name").agg(
        F.sum("amount").alias("revenue"))


@query("pivot_regions", f"""WITH {REGIONAL}
SELECT yr, """ + ", ".join(f"""CAST(sum(revenue) FILTER (WHERE r_name = '{r}') AS DOUBLE) AS "{r}\"""" for r in REGIONS)
       + " FROM regional GROUP BY 1")
def pivot_regions(spark, sf):
    wide = tabulate.to_wide(regional(spark, sf), ["yr"], "r_name", "revenue", REGIONS, agg="sum")
    return wide.select("yr", *[F.col(f"`{r}`").cast("double").alias(r) for r in REGIONS])


@query("unpivot_measures", """SELECT l_returnflag, 'quantity' AS variable, round(avg(l_quantity), 5) AS value
FROM lineitem GROUP BY 1 UNION ALL
SELECT l_returnflag, 'discount', round(avg(l_discount), 5) FROM lineitem GROUP BY 1""")
def unpivot_measures(spark, sf):
    wide = tabulate.means(table(spark, sf, "lineitem"), {"quantity": "l_quantity", "discount": "l_discount"},
                          ["l_returnflag"], digits=5)
    return tabulate.to_long(wide, ["l_returnflag"], ["quantity", "discount"])


@query("rate_ratio_preview", f"""WITH {REGIONAL},
r AS (SELECT a.r_name AS level, CAST(a.revenue AS DOUBLE) / CAST(b.revenue AS DOUBLE) AS x
  FROM regional a JOIN regional b ON a.yr = b.yr AND b.r_name = 'EUROPE' WHERE a.r_name <> 'EUROPE')
SELECT level, count(x) AS n, round(avg(x), 6) AS mean_ratio, round(min(x), 6) AS min_ratio,
  round(max(x), 6) AS max_ratio FROM r GROUP BY 1""")
def rate_ratio_preview(spark, sf):
    wide = tabulate.to_wide(regional(spark, sf).withColumn("revenue", F.col("revenue").cast("double")), ["yr"],
                            "r_name", "revenue", REGIONS)
    return rounded(tabulate.rate_ratio_preview(wide, REGIONS, "EUROPE"))


@query("phase_grid", f"""WITH {PANEL},
m AS (SELECT virus_cat, phase, avg(weekly_rate) AS x FROM panel WHERE age_cat = 'Overall' GROUP BY 1, 2),
grid AS (SELECT * FROM (VALUES ('F'), ('O'), ('X')) AS a(virus_cat),
  (VALUES ('pre_pandemic'), ('disruption'), ('recovery')) AS b(phase))
SELECT virus_cat, phase, round(coalesce(x, 0), 9) AS mean_rate FROM grid LEFT JOIN m USING (virus_cat, phase)""")
def phase_grid(spark, sf):
    rows = filters.stratum(panel(spark, sf), PANEL_DIMS, ["virus_cat"])
    cells = tabulate.means(rows, {"mean_rate": "weekly_rate"}, ["virus_cat", "phase"])
    return rounded(tabulate.full_grid(cells, {"virus_cat": ["F", "O", "X"],
                                              "phase": ["pre_pandemic", "disruption", "recovery"]}, "mean_rate"), 9)


@query("mean_of_season_peaks", f"""WITH {PANEL},
p AS (SELECT phase, age_cat, season, max(weekly_rate) AS peak FROM panel WHERE virus_cat = 'Overall' GROUP BY 1, 2, 3)
SELECT phase, age_cat, round(avg(peak), 9) AS mean_peak FROM p GROUP BY 1, 2""")
def mean_of_season_peaks(spark, sf):
    rows = filters.stratum(panel(spark, sf), PANEL_DIMS, ["age_cat"])
    peaks = rows.groupBy("phase", "age_cat", "season").agg(F.max("weekly_rate").alias("peak"))
    return tabulate.means(peaks, {"mean_peak": "peak"}, ["phase", "age_cat"], digits=9)


@query("describe", " UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 5) AS mean,
  round(stddev_samp({c}), 5) AS sd, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(quantile_cont({c}, 0.25), 5) AS q1, round(quantile_cont({c}, 0.5), 5) AS median,
  round(quantile_cont({c}, 0.75), 5) AS q3 FROM lineitem"""
                                      for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe(spark, sf):
    return rounded(tabulate.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 5)


@query("quantiles_by_group", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.025), 6) AS low,
  round(quantile_cont(o_totalprice, 0.5), 6) AS mid, round(quantile_cont(o_totalprice, 0.975), 6) AS high
FROM orders GROUP BY 1""")
def quantiles_by_group(spark, sf):
    return rounded(quantiles(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice",
                             {"low": 0.025, "mid": 0.5, "high": 0.975}), 6)


@query("stat_grid", """SELECT event_type, round(avg(value), 8) AS value_mean, round(stddev_samp(value), 8) AS value_sd,
  round(quantile_cont(value, 0.5), 8) AS value_median, count(value) AS value_n FROM events GROUP BY 1""")
def stat_grid(spark, sf):
    return tabulate.stat_grid(table(spark, sf, "events"), ["event_type"], ["value"], ("mean", "sd", "median", "n"), 8)


@query("mean_all_columns", """SELECT l_returnflag, round(avg(l_linenumber), 5) AS l_linenumber,
  round(avg(l_quantity), 5) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice,
  round(avg(l_discount), 5) AS l_discount, round(avg(l_tax), 5) AS l_tax FROM lineitem GROUP BY 1""")
def mean_all_columns(spark, sf):
    out = tabulate.mean_all(table(spark, sf, "lineitem").drop("l_orderkey", "l_partkey", "l_suppkey"), ["l_returnflag"])
    return rounded(out.withColumn("l_extendedprice", F.round("l_extendedprice", 4)), 5)


@query("mean_sd_curve", """SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 8) AS mean,
  round(stddev_samp(value), 8) AS sd, round(avg(value) - stddev_samp(value), 8) AS low,
  round(avg(value) + stddev_samp(value), 8) AS high FROM events GROUP BY 1, 2""")
def mean_sd_curve(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    return rounded(tabulate.mean_sd_curve(ev, ["event_type"], "day", "value"), 8)


@query("mean_ci", """SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n,
  round(avg(o_totalprice), 6) AS mean,
  round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS ci_low,
  round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 6) AS ci_high
FROM orders GROUP BY 1, 2""")
def mean_ci(spark, sf):
    df = table(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(tabulate.mean_ci(df, ["o_orderstatus", "month"], "o_totalprice"), 6)


@query("box_stats", """WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT e.event_type, value, q1, median, q3,
  value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM events e JOIN q USING (event_type))
SELECT event_type, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, count(*) AS n,
  min(value) FILTER (WHERE inside) AS whisker_low, max(value) FILTER (WHERE inside) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS n_outliers FROM f GROUP BY 1, 2, 3, 4""")
def box_stats(spark, sf):
    return rounded(tabulate.box_stats(table(spark, sf, "events"), ["event_type"], "value"), 5)


@query("trapezoid_auc", """WITH d AS (
  SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS cycle, avg(value) AS y
  FROM events GROUP BY 1, 2),
s AS (SELECT *, lag(y) OVER w AS py, lag(cycle) OVER w AS pc FROM d
  WINDOW w AS (PARTITION BY user_id ORDER BY cycle))
SELECT user_id, round(coalesce(sum((y + py) / 2 * (cycle - pc)), 0), 8) AS auc FROM s GROUP BY 1""")
def trapezoid_auc(spark, sf):
    return rounded(tabulate.trapezoid_auc(_episodes(spark, sf), ["user_id"], "cycle", "y", bounded=True), 8)


def _episodes(spark, sf):
    """Event values as one episode per user with a cycle per day."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("cycle")
    return table(spark, sf, "events").groupBy("user_id", day).agg(
        F.avg("value").alias("y"), F.sum("value").alias("dose"))


@query("row_auc", """WITH s AS (
  SELECT event_type, value, event_id, lag(value) OVER w AS pv, lag(event_id) OVER w AS pe FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, round(sum((value + pv) / 2), 4) AS unit_auc FROM s GROUP BY 1""")
def row_auc(spark, sf):
    out = tabulate.trapezoid_auc(table(spark, sf, "events"), ["event_type"], "event_id", {"unit_auc": "value"},
                                 unit_spacing=True)
    return rounded(out, 4)


@query("episode_metrics", """WITH d AS (
  SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS cycle, avg(value) AS y, sum(value) AS dose
  FROM events GROUP BY 1, 2),
s AS (SELECT *, lag(y) OVER w AS py, lag(dose) OVER w AS pd, lag(cycle) OVER w AS pc FROM d
  WINDOW w AS (PARTITION BY user_id ORDER BY cycle))
SELECT user_id, round(coalesce(sum((y + py) / 2 * (cycle - pc)), 0), 8) AS "AUC_y",
  round(coalesce(sum((dose + pd) / 2 * (cycle - pc)), 0), 8) AS "AUC_dose", round(sum(dose), 8) AS dose_burden,
  round(avg(y), 8) AS mean_y FROM s GROUP BY 1""")
def episode_metrics(spark, sf):
    out = tabulate.episode_metrics(_episodes(spark, sf), ["user_id"], "cycle", ["y", "dose"], "dose", "y", bounded=True)
    return out.select("user_id", F.round("AUC_y", 8).alias("AUC_y"), F.round("AUC_dose", 8).alias("AUC_dose"),
                      F.round("dose_burden", 8).alias("dose_burden"), F.round("mean_y", 8).alias("mean_y"))


@query("signature", """WITH c AS (
  SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS cycle, avg(value) AS dose,
    avg(user_id) AS response FROM events GROUP BY 1, 2)
SELECT event_type, round(corr(dose, response), 8) AS correlation,
  round(CASE WHEN count(*) >= 5 THEN regr_slope(dose, cycle) END, 8) AS dose_slope,
  round(CASE WHEN count(*) >= 5 THEN regr_slope(response, cycle) END, 8) AS response_slope,
  round(avg(dose), 8) AS mean_dose FROM c GROUP BY 1""")
def signature(spark, sf):
    ev = table(spark, sf, "events").withColumn(
        "cycle", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    return rounded(tabulate.signature(ev, "event_type", "cycle", "value", "user_id"), 8)


@query("correlations", """SELECT 'l_quantity' AS variable, 'l_extendedprice' AS other,
  round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL
SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL
SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem UNION ALL
SELECT c, c, 1.0 FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) AS t(c)""")
def correlations(spark, sf):
    return rounded(tabulate.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("target_correlations", " UNION ALL ".join(f"""SELECT '{c}' AS variable, 'l_extendedprice' AS other,
  round(corr({c}, l_extendedprice), 6) AS r, CASE WHEN abs(corr({c}, l_extendedprice)) > 0.5 THEN 'Strong'
  WHEN abs(corr({c}, l_extendedprice)) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength FROM lineitem"""
                                                 for c in ("l_quantity", "l_discount", "l_tax")))
def target_correlations(spark, sf):
    return rounded(tabulate.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"],
                                         "l_extendedprice"))


@query("slopes", """SELECT l_suppkey, round(CASE WHEN count(*) >= 5 THEN regr_slope(l_extendedprice, l_quantity) END, 4)
  AS slope FROM lineitem GROUP BY 1""")
def slopes(spark, sf):
    return rounded(tabulate.slope(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), 4)


@query("contingency", """SELECT l_returnflag, l_linestatus, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2""")
def contingency(spark, sf):
    return rounded(tabulate.contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("class_balance", """SELECT l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_pos,
  count(*) FILTER (WHERE l_returnflag <> 'R') AS n_neg,
  round(count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*), 6) AS pct_pos,
  round(greatest(count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag <> 'R'))
    / least(count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag <> 'R')), 6)
    AS imbalance_ratio FROM lineitem GROUP BY 1""")
def class_balance(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("target", flag(F.col("l_returnflag") == "R"))
    return rounded(tabulate.class_balance(df, "target", ["l_linestatus"]))


@query("profile", """WITH c AS (
  SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal,
    CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS debt, CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS target
  FROM customer)
SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_features, count(*) FILTER (WHERE segment IS NULL) AS n_missing,
  round(count(*) FILTER (WHERE segment IS NULL) * 100.0 / (count(*) * 5), 6) AS pct_missing,
  count(segment) AS n_complete, CAST(1 AS BIGINT) AS n_binary, CAST(3 AS BIGINT) AS n_numeric FROM c""")
def profile(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), "c_acctbal",
        flag(F.col("c_acctbal") < 0).alias("debt"), flag(F.col("c_nationkey") == 3).alias("target"))
    return rounded(tabulate.profile(df, "target"))


@query("nearest_rows", """WITH t AS (SELECT unnest([1000.0, 1500.0, 1900.0]) AS target),
r AS (SELECT p_partkey, p_retailprice, row_number() OVER (
  PARTITION BY target ORDER BY abs(p_retailprice - target), p_partkey) AS rn FROM part, t)
SELECT DISTINCT p_partkey, p_retailprice FROM r WHERE rn = 1""")
def nearest_rows(spark, sf):
    return tabulate.nearest(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice",
                            [1000.0, 1500.0, 1900.0], ["p_partkey"])


@query("best_row", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def best_row(spark, sf):
    return tabulate.best_row(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", ["s_suppkey"])


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_k(spark, sf):
    return tabulate.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15,
                          ["o_orderkey"])


@query("season_features", f"""WITH {PANEL},
f AS (SELECT season, phase, max(weekly_rate) AS peak_rate, avg(weekly_rate) AS mean_rate, sum(weekly_rate) AS cum_rate,
    count(weekly_rate) AS n_weeks, arg_min(week, ROW(-weekly_rate, week)) AS peak_week,
    stddev_samp(weekly_rate) / avg(weekly_rate) AS cv
  FROM panel WHERE age_cat = 'Overall' AND virus_cat = 'Overall' AND season <> '1998-99' AND weekly_rate IS NOT NULL
  GROUP BY 1, 2)
SELECT season, phase, peak_rate, round(mean_rate, 9) AS mean_rate, round(cum_rate, 4) AS cum_rate, n_weeks, peak_week,
  round(cv, 9) AS cv FROM f""")
def season_features(spark, sf):
    out = surveillance.season_features(filters.stratum(panel(spark, sf), PANEL_DIMS), ["season", "phase"],
                                       excluded=SUPPRESSED)
    return out.withColumns({"mean_rate": F.round("mean_rate", 9), "cum_rate": F.round("cum_rate", 4),
                            "cv": F.round("cv", 9)})


@query("feature_kinds", """WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS d FROM customer)
SELECT unnest(['c_custkey', 'c_mktsegment', 'debt', 'gaps', 'constant']) AS feature,
  unnest(['Continuous', 'Categorical', CASE WHEN d > 0 AND d < n THEN 'Binary' ELSE 'Continuous' END, 'Continuous', 'Continuous']) AS kind FROM c""")
def feature_kinds(spark, sf):
    debt = flag(F.col("c_acctbal") < 0)
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", debt.alias("debt"), F.when(F.col("c_custkey") % 5 != 0, debt).alias("gaps"),
        F.lit(1).alias("constant"), flag(F.col("c_nationkey") == 3).alias("target"))
    return tabulate.feature_kinds(df, "target")
