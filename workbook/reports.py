"""Incidence, counts, labels, triage: reports from line-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from episcope.functions.expr import cut, days_since, decimals, per_100k, percent_cell, signif
from episcope.operators import clean, filters, joins, rules, tabulate, windows
from episcope.plans import cohort, incidence, layouts
from workbook.registry import query, table
from workbook.tables import AS_OF, CLAIMS, POPULATION, REGISTRY, claims, events, positive, registry

DAILY = """daily AS (
  SELECT event_type AS pathogen, CAST(ts AS DATE) AS test_date, count(*) FILTER (WHERE value > 50) AS n
  FROM events GROUP BY 1, 2),
rolled AS (
  SELECT *, CAST(sum(n) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS r7,
    CAST(sum(n) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS BIGINT) AS r28
  FROM daily WINDOW w AS (PARTITION BY pathogen ORDER BY test_date))"""


@query("incidence_report", f"""WITH {DAILY},
rates AS (SELECT *, round(r7 * 4e-1, 1) AS i7, round(r28 * 4e-1, 1) AS i28 FROM rolled)
SELECT pathogen, i7 AS incidence_7d, i28 AS incidence_28d, round(i7 - i28, 1) AS change,
  CASE WHEN i7 > 25 THEN 'High' WHEN i7 > 10 THEN 'Medium' ELSE 'Low' END AS concern
FROM rates WHERE test_date = (SELECT max(test_date) FROM rates)""")
def incidence_report(spark, sf):
    return incidence.incidence_report(events(spark, sf), "ts", "event_type", positive(), POPULATION)


@query("incidence_window", f"""WITH {DAILY.replace('FROM events', "FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND event_type IN ('view', 'click')")},
rates AS (SELECT *, round(r7 * 4e-1, 1) AS i7, round(r28 * 4e-1, 1) AS i28 FROM rolled)
SELECT pathogen, i7 AS incidence_7d, i28 AS incidence_28d, round(i7 - i28, 1) AS change,
  CASE WHEN i7 > 25 THEN 'High' WHEN i7 > 10 THEN 'Medium' ELSE 'Low' END AS concern
FROM rates WHERE test_date = (SELECT max(test_date) FROM rates)""")
def incidence_window(spark, sf):
    """The report between two dates, both included, for chosen kinds."""
    return incidence.incidence_report(events(spark, sf), "ts", "event_type", positive(), POPULATION,
                                      "2024-01-05", "2024-01-20", ["view", "click"])


@query("rolling_incidence", f"""WITH {DAILY}
SELECT pathogen, test_date, n AS count, r7 AS rolling_7d, r28 AS rolling_28d,
  round(r7 * 4e-1, 1) AS per_100k_7d, round(r28 * 4e-1, 1) AS per_100k_28d FROM rolled""")
def rolling_incidence(spark, sf):
    return incidence.rolling_incidence(events(spark, sf), "ts", "event_type", positive(), POPULATION).withColumnRenamed(
        "event_type", "pathogen")


@query("rolling_calendar", """WITH daily AS (
  SELECT user_id, CAST(ts AS DATE) AS test_date, count(*) FILTER (WHERE value > 50) AS n FROM events GROUP BY 1, 2)
SELECT user_id, test_date, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY test_date
  RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_7 FROM daily""")
def rolling_calendar(spark, sf):
    daily = tabulate.daily_positives(events(spark, sf), "ts", ["user_id"], positive(), "n")
    return windows.rolling_sum(daily, ["user_id"], "test_date", "n", 7, calendar=True).select(
        "user_id", "test_date", "rolling_7")


@query("recent_vs_older", f"""WITH {DAILY},
rates AS (SELECT *, r7 * 4e-1 AS x, 1 - floor(log10(abs(nullif(r7 * 4e-1, 0)))) AS d FROM rolled),
signed AS (SELECT *, CASE WHEN x = 0 THEN 0.0 ELSE round(x * power(10.0, d)) / power(10.0, d) END AS i FROM rates),
means AS (
  SELECT pathogen, avg(i) AS older, avg(i) FILTER (WHERE test_date >= newest - 7) AS recent
  FROM signed, (SELECT max(test_date) AS newest FROM rates) WHERE test_date >= newest - 35 GROUP BY 1)
SELECT pathogen, round(older, 6) AS older_incidence, round(recent, 6) AS recent_incidence,
  round((recent - older) * 100 / nullif(older, 0), 6) AS pct_change,
  CASE WHEN recent > older THEN 'Increasing' WHEN recent < older THEN 'Decreasing' ELSE 'No Change' END AS status
FROM means WHERE recent IS NOT NULL""")
def recent_vs_older(spark, sf):
    out = incidence.recent_vs_older(events(spark, sf), "ts", "event_type", positive(), POPULATION)
    return out.select("pathogen", F.round("older_incidence", 6).alias("older_incidence"),
                      F.round("recent_incidence", 6).alias("recent_incidence"),
                      F.round("pct_change", 6).alias("pct_change"), "status")


@query("counts_by_two_keys", f"""WITH {CLAIMS}
SELECT c_mktsegment, r_name, count(c_custkey) AS n FROM claims WHERE c_acctbal < 0 GROUP BY 1, 2""")
def counts_by_two_keys(spark, sf):
    return tabulate.counts(claims(spark, sf), ["c_mktsegment", "r_name"], F.col("c_acctbal") < 0, of="c_custkey")


@query("counts_by_area", f"""WITH {CLAIMS}
SELECT n_name, count(c_custkey) AS n FROM claims WHERE c_acctbal > 5000 GROUP BY 1""")
def counts_by_area(spark, sf):
    return tabulate.counts(claims(spark, sf), ["n_name"], F.col("c_acctbal") > 5000, of="c_custkey")


@query("filtered_means", """SELECT round(avg(c_acctbal), 2) AS mean_balance, round(avg(c_nationkey), 2) AS mean_code
FROM customer WHERE c_mktsegment = 'BUILDING'""")
def filtered_means(spark, sf):
    return tabulate.means(table(spark, sf, "customer"), {"mean_balance": "c_acctbal", "mean_code": "c_nationkey"},
                          where=F.col("c_mktsegment") == "BUILDING", digits=2)


@query("sql_text_counts", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean_qty
FROM lineitem WHERE l_discount > 0.035 GROUP BY 1, 2""")
def sql_text_counts(spark, sf):
    from episcope.sources.tables import register
    register(table(spark, sf, "lineitem"), "lines_view")
    return spark.sql("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 4) AS mean_qty
        FROM lines_view WHERE l_discount > 0.035 GROUP BY 1, 2""")


@query("weekly_counts", """SELECT o_orderstatus, CAST(date_trunc('week', o_orderdate) AS DATE) AS period,
  count(*) AS n FROM orders GROUP BY 1, 2""")
def weekly_counts(spark, sf):
    return tabulate.period_counts(table(spark, sf, "orders"), "o_orderdate", keys=["o_orderstatus"])


@query("two_week_counts", """SELECT DATE '1970-01-05'
  + CAST(floor(date_diff('day', DATE '1970-01-05', CAST(o_orderdate AS DATE)) / 14.0) * 14 AS INTEGER) AS period,
  count(*) AS n FROM orders GROUP BY 1""")
def two_week_counts(spark, sf):
    return tabulate.period_counts(table(spark, sf, "orders"), "o_orderdate", n=2)


@query("epi_curve", """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
  count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM orders GROUP BY 1""")
def epi_curve(spark, sf):
    return tabulate.epi_curve(table(spark, sf, "orders"), "o_orderdate", "o_orderstatus", ["F", "O", "P"])


@query("value_counts", """SELECT p_type, count(*) AS n, round(count(*) / (SELECT count(p_type) FROM part), 6) AS share
FROM part GROUP BY 1""")
def value_counts(spark, sf):
    return tabulate.value_counts(table(spark, sf, "part"), "p_type", normalize=True).withColumn(
        "share", F.round("share", 6))


@query("last_days", """SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 7 GROUP BY 1""")
def last_days(spark, sf):
    day = events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    return filters.last_days(day, "day", 7).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("exists_labels", """WITH keys AS (
  SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer)
SELECT key, key IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent,
  key IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS in_debt FROM keys""")
def exists_labels(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    return joins.exists_labels({"urgent": (orders, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")),
                                "in_debt": (customers, F.col("c_acctbal") < 0)}, "key")


@query("label_shares", """WITH keys AS (
  SELECT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer),
flags AS (
  SELECT key, key IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent,
    key IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS in_debt FROM keys)
SELECT round(avg(CAST(urgent AS INTEGER)), 6) AS urgent, round(avg(CAST(in_debt AS INTEGER)), 6) AS in_debt FROM flags""")
def label_shares(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "key")
    customers = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    labels = joins.exists_labels({"urgent": (orders, F.col("o_orderpriority") == "1-URGENT"),
                                  "in_debt": (customers, F.col("c_acctbal") < 0)}, "key")
    return tabulate.means(labels, {"urgent": "urgent", "in_debt": "in_debt"}, digits=6)


@query("mention_rates", """SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n_notes,
  count(*) FILTER (WHERE regexp_matches(lower(text), 'the|ment')) AS n_mentions,
  round(avg(CASE WHEN regexp_matches(lower(text), 'the|ment') THEN 1 ELSE 0 END), 6) AS mention_rate
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def mention_rates(spark, sf):
    out = cohort.mention_rates(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "text",
                               "the|ment", F.col("quality").cast("string"))
    return out.withColumn("mention_rate", F.round("mention_rate", 6))


@query("mention_flags", """SELECT doc_id, regexp_matches(lower(text), 'nausea|gastrointestinal|gi intolerance|ion th')
  AS mention FROM documents""")
def mention_flags(spark, sf):
    return filters.mentions(table(spark, sf, "documents"), "text", cohort.GI_PATTERN + "|ion th", "mention").select(
        "doc_id", "mention")


DAYS = f"date_diff('day', arrival_date, DATE '{AS_OF}')"
SICK = "lower(trim(symptoms)) <> 'none'"
DECISION = f"""CASE WHEN lice_status = 'positive' THEN 'Isolate (Lice)'
  WHEN varicella_status = 'positive' THEN 'Isolate (Varicella)'
  WHEN covid_status = 'positive' AND {DAYS} <= 11 THEN 'Quarantine (COVID - Active)'
  WHEN covid_status = 'positive' AND temp >= 100 THEN 'Quarantine (COVID - Fever Post Isolation)'
  WHEN covid_status = 'positive' THEN 'Clear (COVID - Past Window)'
  WHEN flu_status = 'positive' AND {DAYS} <= 8 THEN 'Quarantine (Flu - Active)'
  WHEN flu_status = 'positive' AND temp >= 100 THEN 'Quarantine (Flu - Fever Post Isolation)'
  WHEN flu_status = 'positive' THEN 'Clear (Flu - Past Window)'
  WHEN temp >= 100 AND {SICK} AND {DAYS} <= 5 THEN 'Quarantine (Symptomatic)' ELSE 'Clear' END"""
REASON = f"""CASE WHEN lice_status = 'positive' THEN 'Lice' WHEN varicella_status = 'positive' THEN 'Varicella'
  WHEN covid_status = 'positive' THEN 'COVID' WHEN flu_status = 'positive' THEN 'Flu'
  WHEN temp >= 100 AND {SICK} AND {DAYS} <= 5 THEN 'Symptom-Based' ELSE 'None' END"""


def label_case(fever: float) -> str:
    return f"""CASE WHEN lice_status = 'positive' THEN 'Lice' WHEN varicella_status = 'positive' THEN 'Varicella'
  WHEN covid_status = 'positive' AND ({DAYS} <= 11 OR temp >= {fever}) THEN 'COVID'
  WHEN flu_status = 'positive' AND ({DAYS} <= 8 OR temp >= {fever}) THEN 'Flu'
  WHEN temp >= {fever} AND {SICK} AND {DAYS} <= 5 THEN 'Symptom-Based' ELSE 'None' END"""


@query("triage", f"""WITH {REGISTRY}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, arrival_date, round(temp, 4) AS temp, symptoms,
  {DECISION} AS triage_decision, {REASON} AS triage_reason FROM registry""")
def triage(spark, sf):
    return rules.triage(registry(spark, sf), AS_OF).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "arrival_date", F.round("temp", 4).alias("temp"),
        "symptoms", "triage_decision", "triage_reason")


@query("triage_line_report", f"""WITH {REGISTRY}
SELECT l_orderkey AS child_id, l_linenumber AS line, l_partkey AS part, arrival_date, o_custkey AS facility_id,
  o_orderpriority AS room_id, round(temp, 4) AS temp, symptoms, {REASON} AS triage_reason,
  {DECISION} AS triage_decision
FROM registry LEFT JOIN orders ON l_orderkey = o_orderkey""")
def triage_line_report(spark, sf):
    census = table(spark, sf, "orders").select(F.col("o_orderkey").alias("child_id"),
                                               F.col("o_custkey").alias("facility_id"),
                                               F.col("o_orderpriority").alias("room_id"))
    arrivals = registry(spark, sf).withColumnRenamed("l_orderkey", "child_id")
    return rules.triage(joins.enrich(arrivals, census, "child_id"), AS_OF).select(
        "child_id", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "arrival_date",
        "facility_id", "room_id", F.round("temp", 4).alias("temp"), "symptoms", "triage_reason", "triage_decision")


@query("triage_counts", f"""WITH {REGISTRY}
SELECT {REASON} AS triage_reason, count(*) AS case_count FROM registry
WHERE {DECISION} LIKE 'Isolate%' OR {DECISION} LIKE 'Quarantine%' GROUP BY 1""")
def triage_counts(spark, sf):
    return rules.held_counts(rules.triage(registry(spark, sf), AS_OF))


@query("triage_labels", f"""WITH {REGISTRY}
SELECT {label_case(100.0)} AS triage_reason, count(*) AS n FROM registry GROUP BY 1""")
def triage_labels(spark, sf):
    return rules.triage_label(registry(spark, sf), AS_OF).groupBy("triage_reason").agg(F.count(F.lit(1)).alias("n"))


@query("fever_sensitivity", f"""WITH {REGISTRY},
long AS (
  SELECT 'f99_5' AS t, {label_case(99.5)} AS triage_reason FROM registry UNION ALL
  SELECT 'f100', {label_case(100.0)} FROM registry UNION ALL SELECT 'f100_5', {label_case(100.5)} FROM registry),
total AS (SELECT count(*) AS n FROM registry)
SELECT triage_reason, round(count(*) FILTER (WHERE t = 'f99_5') / (SELECT n FROM total), 3) AS f99_5,
  round(count(*) FILTER (WHERE t = 'f100') / (SELECT n FROM total), 3) AS f100,
  round(count(*) FILTER (WHERE t = 'f100_5') / (SELECT n FROM total), 3) AS f100_5
FROM long WHERE triage_reason <> 'None' GROUP BY 1""")
def fever_sensitivity(spark, sf):
    return rules.threshold_sensitivity(registry(spark, sf), AS_OF, {"f99_5": 99.5, "f100": 100.0, "f100_5": 100.5})


@query("scenario_rows", """SELECT t AS threshold, count(*) FILTER (WHERE l_quantity >= t) AS n_at_or_above, count(*) AS n
FROM lineitem, (SELECT unnest([10.0, 25.0, 40.0]) AS t) GROUP BY 1""")
def scenario_rows(spark, sf):
    grid = joins.scenarios(table(spark, sf, "lineitem").select("l_quantity"), [10.0, 25.0, 40.0], "threshold")
    return grid.groupBy("threshold").agg(F.count_if(F.col("l_quantity") >= F.col("threshold")).alias("n_at_or_above"),
                                         F.count(F.lit(1)).alias("n"))


@query("new_rows", """SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def new_rows(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return joins.new_rows(table(spark, sf, "customer"), urgent, "c_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("key_sum"))


@query("binned_rates", """WITH binned AS (
  SELECT CASE WHEN p_size >= 1 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium'
    WHEN p_size > 25 AND p_size <= 50 THEN 'large' END AS band, p_retailprice FROM part)
SELECT band, count(*) AS n, round(count(*) * (100000.0 / 300000.0), 4) AS per_100k,
  round(avg(p_retailprice), 4) AS mean_price FROM binned GROUP BY 1""")
def binned_rates(spark, sf):
    banded = table(spark, sf, "part").withColumn("band", cut("p_size", [1, 10, 25, 50], ["small", "medium", "large"]))
    table_ = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_price"))
    return table_.select("band", "n", per_100k("n", 300_000, digits=4).alias("per_100k"),
                         F.round("mean_price", 4).alias("mean_price"))


@query("significant_digits", """WITH d AS (SELECT o_orderkey, o_totalprice AS x,
  1 - floor(log10(abs(o_totalprice))) AS d FROM orders)
SELECT o_orderkey, round(round(x * power(10.0, d)) / power(10.0, d), 2) AS two_digits FROM d""")
def significant_digits(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(signif("o_totalprice", 2), 2).alias("two_digits"))


@query("risk_scores", """SELECT c_custkey, round(1 / (1 + exp(-(-1.5 + 0.0002 * c_acctbal
  + CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.8 ELSE 0 END
  + CASE WHEN c_nationkey < 10 AND c_acctbal > 0 THEN -0.4 ELSE 0 END))), 8) AS probability FROM customer""")
def risk_scores(spark, sf):
    scored = clean.risk_score(table(spark, sf, "customer"), -1.5, {
        "c_acctbal": 0.0002, "c_mktsegment = 'MACHINERY'": 0.8, "c_nationkey < 10 AND c_acctbal > 0": -0.4},
        "probability")
    return scored.select("c_custkey", F.round("probability", 8).alias("probability"))


@query("recoded_segments", """SELECT c_custkey,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS kept,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS seg_BUILDING,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS seg_FURNITURE FROM customer""")
def recoded_segments(spark, sf):
    df = table(spark, sf, "customer")
    df = clean.lookup(df, "c_mktsegment", {"BUILDING": "B", "MACHINERY": "M"}, "kept", keep_unmapped=True)
    df = clean.lookup(df, "c_mktsegment", {"BUILDING": 1, "MACHINERY": 2}, "code")
    df = clean.one_hot(df, "c_mktsegment", ["BUILDING", "FURNITURE"], "seg")
    return df.select("c_custkey", "kept", "code", "seg_BUILDING", "seg_FURNITURE")


@query("group_codes", """WITH k AS (SELECT DISTINCT r_name || '_' || c_mktsegment AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
coded AS (SELECT name, row_number() OVER (ORDER BY name) AS code FROM k)
SELECT c_custkey, code FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN coded ON name = r_name || '_' || c_mktsegment""")
def group_codes(spark, sf):
    return clean.group_code(claims(spark, sf), ["r_name", "c_mktsegment"], "code").select("c_custkey", "code")


@query("arrival_age_counts", f"""SELECT date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}') <= 60 AS recent,
  count(*) AS n, min(date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}')) AS youngest FROM lineitem GROUP BY 1""")
def arrival_age_counts(spark, sf):
    days = table(spark, sf, "lineitem").select(days_since(F.col("l_shipdate").cast("date"), AS_OF).alias("days"))
    return days.groupBy((F.col("days") <= 60).alias("recent")).agg(
        F.count(F.lit(1)).alias("n"), F.min("days").cast("long").alias("youngest"))


@query("exposure_terms", """WITH x AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS a,
    CASE WHEN l_discount > 0.045 THEN 1 ELSE 0 END AS b, CASE WHEN l_tax > 0.035 THEN 1 ELSE 0 END AS c,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS fb, l_returnflag FROM lineitem)
SELECT a + b + c AS total_exposure, CASE WHEN a + b + c >= 3 THEN 1 ELSE 0 END AS high_exposure,
  CASE WHEN fb = 1 AND a + b + c >= 2 THEN 1 ELSE 0 END AS vulnerable,
  CASE WHEN l_returnflag = 'R' AND a = 1 THEN 1 ELSE 0 END AS smoking_workplace, count(*) AS n
FROM x GROUP BY 1, 2, 3, 4""")
def exposure_terms(spark, sf):
    li = table(spark, sf, "lineitem").select(
        clean.flag(F.col("l_quantity") > 25).alias("a"), clean.flag(F.col("l_discount") > 0.045).alias("b"),
        clean.flag(F.col("l_tax") > 0.035).alias("c"), clean.flag(F.col("l_linestatus") == "F").alias("fb"),
        "l_returnflag")
    out = clean.exposure_terms(li, ["a", "b", "c"], "fb", F.col("l_returnflag") == "R", F.col("a") == 1)
    return out.groupBy("total_exposure", "high_exposure", "vulnerable", "smoking_workplace").agg(
        F.count(F.lit(1)).alias("n"))


FLAG_TABLE = layouts.Layout(
    "l_returnflag", "l_linestatus", {"R": "Returned", "N": "Not returned", "Z": "Unknown"}, {"O": "Open", "F": "Filled"},
    {"n": "Lines (n)", "mean": "Mean Quantity", "share": "Discounted"}, "Flag", "Status", rows_of={"R": {"F": "Filled", "P": "Partial"}})


@query("printed_layout", """WITH c AS (SELECT l_returnflag AS s, l_linestatus AS r, CAST(count(*) AS VARCHAR) AS n,
  printf('%.2f', round(avg(l_quantity), 9)) AS m, printf('%.1f', round(avg(CASE WHEN l_discount > 0.045 THEN 1e0 ELSE 0 END) * 100, 9)) || '%' AS d
  FROM lineitem GROUP BY 1, 2),
k(position, kind, s, r, label) AS (VALUES (0, 'title', 'R', NULL, 'Returned'), (1, 'row', 'R', 'F', 'Filled'), (2, 'row', 'R', 'P', 'Partial'),
  (3, 'blank', NULL, NULL, ''), (4, 'title', 'N', NULL, 'Not returned'), (5, 'row', 'N', 'O', 'Open'), (6, 'row', 'N', 'F', 'Filled'),
  (7, 'blank', NULL, NULL, ''), (8, 'title', 'Z', NULL, 'Unknown'), (9, 'row', 'Z', 'O', 'Open'), (10, 'row', 'Z', 'F', 'Filled'), (11, 'blank', NULL, NULL, ''))
SELECT CAST(position AS BIGINT) AS position, CASE WHEN kind = 'title' THEN label ELSE '' END AS "Flag",
  CASE WHEN kind = 'row' THEN label ELSE '' END AS "Status", coalesce(n, '') AS "Lines (n)", coalesce(m, '') AS "Mean Quantity",
  coalesce(d, '') AS "Discounted" FROM k LEFT JOIN c USING (s, r) WHERE kind <> 'row' OR n IS NOT NULL""")
def printed_layout(spark, sf):
    """Sections with titles and blank lines; rows and sections without data print nothing but the title."""
    cells = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), decimals(F.avg("l_quantity"), 2).alias("mean"),
        percent_cell(F.avg(F.when(F.col("l_discount") > 0.045, 1.0).otherwise(0.0))).alias("share"))
    return layouts.printed(cells, FLAG_TABLE)


@query("relabelled_layout", """SELECT c_custkey AS "Customer", CASE c_mktsegment WHEN 'BUILDING' THEN 'BLD' WHEN 'AUTOMOBILE' THEN 'AUTO'
  ELSE c_mktsegment END AS "Segment", c_acctbal AS "Balance" FROM customer""")
def relabelled_layout(spark, sf):
    return layouts.relabelled(table(spark, sf, "customer"), {"c_custkey": "Customer", "c_mktsegment": "Segment", "c_acctbal": "Balance"},
                              {"c_mktsegment": {"BUILDING": "BLD", "AUTOMOBILE": "AUTO"}})
