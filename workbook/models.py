"""Regressions, panel effects, mixed models, bootstrap, forecasts and map work on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from episcope.functions.expr import flag
from episcope.operators import fixed_effects, forecast, geo, mixed, regression, resample, windows
from episcope.operators.filters import stratum
from episcope.operators.joins import method_agreement
from episcope.plans import layouts, surveillance
from workbook.panels import REGIONAL, REGIONS, regional, rounded
from workbook.registry import query, table
from workbook.tables import PANEL, PANEL_DIMS, REGISTRY, SUPPRESSED, panel, registry

TRAIN_END = "1998-09-30"


@query("ols_one_regressor", """WITH s AS (
  SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
    regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
    regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx,
    regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem)
SELECT 'primary' AS model, 'l_quantity' AS term, round(b, 5) AS estimate,
  round(sqrt(syy * (1 - r2) / (n - 2) / sxx), 6) AS se, round(r2, 8) AS r_squared, n FROM s
UNION ALL SELECT 'primary', 'intercept', round(a, 4), round(sqrt(syy * (1 - r2) / (n - 2) * (1.0 / n + mx * mx / sxx)), 5),
  round(r2, 8), n FROM s""")
def ols_one_regressor(spark, sf):
    out = regression.ols_table(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    slope = F.col("term") == "l_quantity"
    return out.select("model", "term", F.when(slope, F.round("estimate", 5)).otherwise(F.round("estimate", 4)).alias("estimate"),
                      F.when(slope, F.round("se", 6)).otherwise(F.round("se", 5)).alias("se"),
                      F.round("r_squared", 8).alias("r_squared"), "n")


@query("ols_two_models")
def ols_two_models(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("open", flag(F.col("l_linestatus") == "O"))
    first = regression.ols_table(li, "l_extendedprice", ["l_quantity", "open"])
    second = regression.ols_table(li, "l_extendedprice", ["l_quantity", "open", "l_discount", "l_tax"], "sensitivity")
    return first.unionByName(second)


@query("season_model_input", f"""WITH {PANEL}
SELECT season, round(avg(weekly_rate), 9) AS mean_weekly, max(weekly_rate) AS peak_weekly,
  count(weekly_rate) AS n_weeks, max(CASE WHEN phase = 'disruption' THEN 1 ELSE 0 END) AS phase_disruption,
  max(CASE WHEN phase = 'recovery' THEN 1 ELSE 0 END) AS phase_recovery
FROM panel WHERE age_cat = 'Overall' AND virus_cat = 'Overall' AND season <> '1998-99' GROUP BY 1""")
def season_model_input(spark, sf):
    return _season_level(spark, sf).withColumn("mean_weekly", F.round("mean_weekly", 9)).drop("phase")


def _season_level(spark, sf):
    rows = stratum(panel(spark, sf), PANEL_DIMS).where(~F.col("season").isin(*SUPPRESSED))
    out = rows.groupBy("season", "phase").agg(F.avg("weekly_rate").alias("mean_weekly"),
                                              F.max("weekly_rate").alias("peak_weekly"),
                                              F.count("weekly_rate").alias("n_weeks"))
    return out.withColumns({f"phase_{p}": flag(F.col("phase") == p) for p in ("disruption", "recovery")})


@query("season_ols")
def season_ols(spark, sf):
    return regression.ols_table(_season_level(spark, sf), "mean_weekly", ["phase_disruption", "phase_recovery"])


def _returned(spark, sf):
    return table(spark, sf, "lineitem").select(
        flag(F.col("l_returnflag") == "R").alias("returned"), flag(F.col("l_linestatus") == "O").alias("open"),
        (F.col("l_quantity") / 10).alias("quantity"), flag(F.col("l_discount") > 0.045).alias("discounted"))


@query("logit_table")
def logit_table(spark, sf):
    return regression.logit_table(_returned(spark, sf), "returned", ["open", "quantity", "discounted"], collapse=True)


@query("logit_fit")
def logit_fit(spark, sf):
    return regression.logit_fit(_returned(spark, sf), "returned", ["open", "quantity", "discounted"], collapse=True)


@query("odds_ratio_binary", """WITH c AS (SELECT CAST(count(*) FILTER (WHERE r AND o) AS DOUBLE) AS a,
  CAST(count(*) FILTER (WHERE NOT r AND o) AS DOUBLE) AS b, CAST(count(*) FILTER (WHERE r AND NOT o) AS DOUBLE) AS c,
  CAST(count(*) FILTER (WHERE NOT r AND NOT o) AS DOUBLE) AS d FROM (
    SELECT l_returnflag = 'R' AS r, l_linestatus = 'O' AS o FROM lineitem))
SELECT 'open' AS term, round(a * d / (b * c), 4) AS odds_ratio,
  round(exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 4) AS ci_low,
  round(exp(ln(a * d / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 4) AS ci_high FROM c""")
def odds_ratio_binary(spark, sf):
    df = _returned(spark, sf)
    return rounded(regression.odds_ratios(df, F.col("returned") == 1, ["open"], digits=None, collapse=True), 4)


@query("odds_ratios_by_segment")
def odds_ratios_by_segment(spark, sf):
    df = table(spark, sf, "customer").withColumn("debt", flag(F.col("c_acctbal") < 0))
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    coded, names = regression.treatment_code(df, "c_mktsegment", levels)
    return regression.odds_ratios(coded, F.col("debt") == 1, names, collapse=True)


@query("odds_ratios_triage")
def odds_ratios_triage(spark, sf):
    from episcope.functions.expr import days_since
    from episcope.operators.rules import triage_label
    df = triage_label(registry(spark, sf), "2001-11-04").select(
        "triage_reason", "temp", (days_since("arrival_date", "2001-11-04") / 365.0).alias("years_since_arrival"),
        flag(F.lower(F.trim("symptoms")) != "none").alias("symptom_flag")).where("triage_reason <> 'None'")
    return regression.odds_ratios(df, F.col("triage_reason") == "COVID",
                                  ["temp", "years_since_arrival", "symptom_flag"])


def _day_panel(spark, sf):
    """Events as a balanced panel: daily total per user, zero on quiet days, start = first purchase day."""
    ev = table(spark, sf, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    daily = ev.groupBy("user_id", "day").agg(F.sum("value").alias("y"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    start = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("day").alias("start"))
    full = fixed_effects.complete_panel(daily, "user_id", "day", 0, 29, ["y", "clicks"])
    from episcope.operators.joins import enrich
    return enrich(full, start, "user_id").withColumn("post", flag(F.col("day") >= F.col("start")))


@query("twoway_fe", """WITH d AS (
  SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, sum(value) AS y FROM events GROUP BY 1, 2),
s AS (SELECT user_id, min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS start FROM events
  WHERE event_type = 'purchase' GROUP BY 1),
p AS (SELECT u.user_id, g.day, coalesce(d.y, 0) AS y, CASE WHEN g.day >= s.start THEN 1 ELSE 0 END AS post
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(30)) AS day) g
  LEFT JOIN d ON d.user_id = u.user_id AND d.day = g.day LEFT JOIN s ON s.user_id = u.user_id),
w AS (SELECT y - avg(y) OVER (PARTITION BY user_id) - avg(y) OVER (PARTITION BY day) + avg(y) OVER () AS y,
    post - avg(post) OVER (PARTITION BY user_id) - avg(post) OVER (PARTITION BY day) + avg(post) OVER () AS x FROM p),
f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x) AS rss,
    count(*) AS n, (SELECT count(DISTINCT user_id) FROM events) AS u FROM w)
SELECT 'post' AS term, round(b, 5) AS estimate, round(sqrt(rss / (n - u - 30) / sxx), 5) AS se, n, u AS n_units FROM f""")
def twoway_fe(spark, sf):
    return fixed_effects.twoway_fe(_day_panel(spark, sf), "y", ["post"], "user_id", "day").select(
        "term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"), "n", "n_units")


@query("unbalanced_fe")
def unbalanced_fe(spark, sf):
    """Only the days on which a user has events, errors clustered by user."""
    from episcope.operators.joins import enrich
    ev = table(spark, sf, "events").withColumn("day", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    daily = ev.groupBy("user_id", "day").agg(F.sum("value").alias("y"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    start = ev.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("day").alias("start"))
    rows = enrich(daily, start, "user_id").withColumn("post", flag(F.col("day") >= F.col("start")))
    return fixed_effects.twoway_fe(rows, "y", ["post", "clicks"], "user_id", "day", cluster=True)


@query("unit_fe")
def unit_fe(spark, sf):
    return fixed_effects.one_way_fe(_day_panel(spark, sf), "y", ["post", "day"], "user_id")


@query("event_study")
def event_study(spark, sf):
    return fixed_effects.event_study(_day_panel(spark, sf), "y", "user_id", "day", "start", -6, 6)


@query("time_since_start", """WITH s AS (
  SELECT user_id, min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) AS start FROM events
  WHERE event_type = 'purchase' GROUP BY 1)
SELECT day - start AS time_since, count(*) AS n FROM s, (SELECT unnest(range(30)) AS day) GROUP BY 1""")
def time_since_start(spark, sf):
    rows = _day_panel(spark, sf).where("start IS NOT NULL")
    return rows.groupBy((F.col("day") - F.col("start")).cast("long").alias("time_since")).agg(F.count(F.lit(1)).alias("n"))


@query("mixed_model")
def mixed_model(spark, sf):
    li = table(spark, sf, "lineitem")
    return mixed.lmm(li, "l_extendedprice", ["l_quantity", "l_discount"], "l_partkey")


@query("mixed_contrasts")
def mixed_contrasts(spark, sf):
    fit, levels = _interaction_fit(spark, sf)
    return mixed.contrasts(spark, fit, "l_returnflag", levels, "quantity", at=2.5)


@query("mixed_anova")
def mixed_anova(spark, sf):
    fit, _ = _interaction_fit(spark, sf)
    return mixed.wald_anova(spark, fit, {
        "quantity": ["quantity"], "l_returnflag": ["l_returnflag_N", "l_returnflag_R"],
        "quantity:l_returnflag": ["quantity:l_returnflag_N", "quantity:l_returnflag_R"]})


def _interaction_fit(spark, sf):
    levels = ["A", "N", "R"]
    li = table(spark, sf, "lineitem").withColumn("quantity", F.col("l_quantity") / 10)
    coded, names = mixed.interaction_columns(li, "quantity", "l_returnflag", levels)
    return mixed.lmm_fit(coded, "l_extendedprice", names, "l_suppkey"), levels


DESIGN = mixed.Design(["quantity"], {"l_returnflag": ["A", "N", "R"], "large": [0, 1]}, [
    ("quantity",), ("l_returnflag",), ("large",), ("quantity", "l_returnflag"), ("l_returnflag", "large")])


def _design_fit(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_extendedprice", "l_suppkey", "l_returnflag", (F.col("l_quantity") / 10).alias("quantity"),
        flag(F.col("l_discount") > 0.045).alias("large"))
    coded, names = DESIGN.coded(li)
    return li, mixed.lmm_fit(coded, "l_extendedprice", names, "l_suppkey")


@query("type3_tests")
def type3_tests(spark, sf):
    return mixed.type3_tests(spark, _design_fit(spark, sf)[1], DESIGN)


@query("marginal_means")
def marginal_means(spark, sf):
    li, fit = _design_fit(spark, sf)
    return mixed.marginal_means(spark, fit, DESIGN, "l_returnflag", mixed.covariate_means(li, DESIGN, "l_extendedprice"))


@query("marginal_contrasts")
def marginal_contrasts(spark, sf):
    li, fit = _design_fit(spark, sf)
    return mixed.marginal_contrasts(spark, fit, DESIGN, "l_returnflag", mixed.covariate_means(li, DESIGN, "l_extendedprice"))


@query("glmm_binomial")
def glmm_binomial(spark, sf):
    li = table(spark, sf, "lineitem").select(
        flag(F.col("l_returnflag") == "R").alias("y"), flag(F.col("l_quantity") > 25).alias("large"),
        flag(F.col("l_discount") > 0.045).alias("discounted"), (F.col("l_suppkey") % 40).alias("site"), "l_linenumber")
    return mixed.glmm_binomial(li, "y", ["large", "discounted"], ["site", "l_linenumber"])


@query("bootstrap_ratio")
def bootstrap_ratio(spark, sf):
    wide = regional(spark, sf).withColumn("revenue", F.col("revenue").cast("double"))
    ref = wide.where("r_name = 'EUROPE'").select("yr", F.col("revenue").alias("ref"))
    pairs = wide.where("r_name <> 'EUROPE'").join(F.broadcast(ref), "yr")  # one row per year
    return resample.bootstrap_ratio(pairs, ["r_name"], "yr", "revenue", "ref")


@query("bootstrap_ratio_points", f"""WITH {REGIONAL}
SELECT a.r_name, count(*) AS n_units, round(avg(CAST(a.revenue AS DOUBLE)) / avg(CAST(b.revenue AS DOUBLE)), 8) AS ratio
FROM regional a JOIN regional b ON a.yr = b.yr AND b.r_name = 'EUROPE' WHERE a.r_name <> 'EUROPE' GROUP BY 1""")
def bootstrap_ratio_points(spark, sf):
    return bootstrap_ratio(spark, sf).select("r_name", "n_units", F.round("ratio", 8).alias("ratio"))


@query("rate_ratio_table")
def rate_ratio_table(spark, sf):
    phase = F.when(F.col("yr") <= 1997, "early").otherwise("late")
    rates = regional(spark, sf).select(phase.alias("phase"), "yr", "r_name", (F.col("revenue") / 1e6).cast("double").alias("rate"))
    return resample.rate_ratio_table(rates, "phase", "yr", "r_name", "rate", "EUROPE",
                                     [r for r in REGIONS if r != "EUROPE"] + ["OCEANIA"])


@query("rate_ratio_layout")
def rate_ratio_layout(spark, sf):
    """The rate ratios as they are printed: a section per phase, the reference group first."""
    others = [r for r in REGIONS if r != "EUROPE"] + ["OCEANIA"]
    return layouts.printed(rate_ratio_table(spark, sf), layouts.Layout(
        "phase", "race_group", {"early": "EARLY", "late": "LATE"}, {"EUROPE (reference)": "EUROPE (reference)", **{r: r for r in others}},
        {"n_seasons": "Seasons (n)", "mean_adj_rate": "Mean Rate", "rr": "Rate Ratio", "ci_95": "95% CI"}, "Phase", "Group"))


@query("bootstrap_median_diff")
def bootstrap_median_diff(spark, sf):
    metric = table(spark, sf, "events").where(F.col("event_type").isin("view", "purchase")).groupBy(
        "event_type", "user_id").agg(F.avg("value").alias("m"))
    return resample.bootstrap_median_diff(metric, "event_type", "view", "purchase", "m")


def _series(spark, sf):
    return surveillance.weekly_series(panel(spark, sf), PANEL_DIMS, ())


DECOMPOSED = f"""WITH {PANEL},
x AS (SELECT virus_cat, epiweek_date, weekly_rate AS y, row_number() OVER w AS t, count(*) OVER (PARTITION BY virus_cat) AS n
  FROM panel WHERE age_cat = 'Overall' AND weekly_rate IS NOT NULL WINDOW w AS (PARTITION BY virus_cat ORDER BY epiweek_date)),
m AS (SELECT *, CASE WHEN t > 26 AND t <= n - 26 THEN (sum(y) OVER (PARTITION BY virus_cat ORDER BY t
    ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING)
    - (lag(y, 26) OVER (PARTITION BY virus_cat ORDER BY t) + lead(y, 26) OVER (PARTITION BY virus_cat ORDER BY t)) / 2) / 52 END AS mid
  FROM x WHERE n >= 104),
e AS (SELECT virus_cat, arg_min(mid, t) AS head, arg_max(mid, t) AS tail FROM m WHERE mid IS NOT NULL GROUP BY 1),
tr AS (SELECT m.*, coalesce(mid, CASE WHEN t <= 26 THEN head ELSE tail END) AS trend FROM m JOIN e USING (virus_cat)),
s AS (SELECT virus_cat, (t - 1) % 52 AS slot, avg(y - trend) AS s FROM tr GROUP BY 1, 2),
c AS (SELECT virus_cat, avg(s) AS centre FROM s GROUP BY 1),
parts AS (SELECT virus_cat, epiweek_date, y AS observed, trend, s - centre AS seasonal, y - trend - (s - centre) AS residual
  FROM tr JOIN s ON tr.virus_cat = s.virus_cat AND (t - 1) % 52 = slot JOIN c ON c.virus_cat = tr.virus_cat
  ) """.replace("SELECT virus_cat, epiweek_date, y AS observed", "SELECT tr.virus_cat, epiweek_date, y AS observed")


def _parts(spark, sf, robust):
    rows = stratum(panel(spark, sf), PANEL_DIMS, ["virus_cat"]).select("virus_cat", "epiweek_date", "weekly_rate")
    return forecast.decompose(rows, ["virus_cat"], "epiweek_date", "weekly_rate", 52, robust)


@query("decompose", DECOMPOSED + """SELECT virus_cat, epiweek_date, observed, round(trend, 7) AS trend,
  round(seasonal, 7) AS seasonal, round(residual, 7) AS residual FROM parts""")
def decompose(spark, sf):
    return rounded(_parts(spark, sf, False).drop("weekly_rate"), 7, skip=("observed",))


@query("decompose_amplitude", DECOMPOSED + """SELECT virus_cat, count(*) AS n_weeks,
  round(quantile_cont(seasonal, 0.75) - quantile_cont(seasonal, 0.25), 7) AS seasonal_amplitude_iqr,
  round(max(seasonal) - min(seasonal), 7) AS seasonal_amplitude_range, round(max(trend) - min(trend), 7) AS trend_range,
  round(stddev_pop(residual), 7) AS residual_sd,
  round(greatest(0, 1 - var_pop(residual) / var_pop(seasonal + residual)), 7) AS strength_of_seasonality_fs,
  round(greatest(0, 1 - var_pop(residual) / var_pop(trend + residual)), 7) AS strength_of_trend_ft
FROM parts GROUP BY 1""")
def decompose_amplitude(spark, sf):
    return rounded(forecast.amplitude(_parts(spark, sf, False), ["virus_cat"]), 7)


@query("decompose_robust")
def decompose_robust(spark, sf):
    return _parts(spark, sf, True)


def _forecast(spark, sf, growth):
    return forecast.seasonal_forecast(_series(spark, sf), "epiweek_date", "weekly_rate", F.col("epiweek_date") <= TRAIN_END,
                                      growth, keep=["season", "phase"])


@query("seasonal_forecast")
def seasonal_forecast(spark, sf):
    return _forecast(spark, sf, "flat")


@query("season_gap")
def season_gap(spark, sf):
    return forecast.season_gap(_forecast(spark, sf, "flat"), "weekly_rate")


@query("gap_side_by_side")
def gap_side_by_side(spark, sf):
    return forecast.gap_side_by_side(forecast.season_gap(_forecast(spark, sf, "flat"), "weekly_rate"),
                                     forecast.season_gap(_forecast(spark, sf, "linear"), "weekly_rate"),
                                     partial=["2000-01"], suppressed=SUPPRESSED)


@query("detection_comparison")
def detection_comparison(spark, sf):
    models = {f"{g}_growth": _forecast(spark, sf, g) for g in ("flat", "linear")}
    return forecast.compare_detections(models, "epiweek_date", "weekly_rate", TRAIN_END)


@query("first_detection", f"""WITH {PANEL},
b AS (SELECT virus_cat, avg(weekly_rate) + 2 * stddev_samp(weekly_rate) AS upper FROM panel
  WHERE age_cat = 'Overall' AND epiweek_date <= DATE '{TRAIN_END}' GROUP BY 1)
SELECT virus_cat, min(epiweek_date) FILTER (WHERE epiweek_date > DATE '{TRAIN_END}' AND weekly_rate > upper) AS first_detection
FROM panel JOIN b USING (virus_cat) WHERE age_cat = 'Overall' GROUP BY 1""")
def first_detection(spark, sf):
    rows = stratum(panel(spark, sf), PANEL_DIMS, ["virus_cat"])
    bound = rows.where(F.col("epiweek_date") <= TRAIN_END).groupBy("virus_cat").agg(
        (F.avg("weekly_rate") + 2 * F.stddev_samp("weekly_rate")).alias("upper"))
    return windows.first_detection(rows.join(bound, "virus_cat"), "epiweek_date", "weekly_rate", "upper", TRAIN_END,
                                   ["virus_cat"])


@query("holdout_metrics")
def holdout_metrics(spark, sf):
    return forecast.holdout_metrics(_holdout(spark, sf))


@query("holdout_residuals")
def holdout_residuals(spark, sf):
    return _holdout(spark, sf)


def _holdout(spark, sf):
    return forecast.holdout(_series(spark, sf), "epiweek_date", "weekly_rate", F.col("epiweek_date") < "1997-10-01",
                            F.col("season") == "1997-98")


@query("residual_summary")
def residual_summary(spark, sf):
    return forecast.residual_summary(_holdout(spark, sf))


@query("leave_one_out")
def leave_one_out(spark, sf):
    return forecast.leave_one_out(_series(spark, sf), "epiweek_date", "weekly_rate", "season",
                                  F.col("epiweek_date") <= TRAIN_END, TRAIN_END)


@query("trend_changes")
def trend_changes(spark, sf):
    return forecast.trend_changes(_series(spark, sf).where(F.col("epiweek_date") <= "2000-09-30"), "epiweek_date", "weekly_rate")


@query("utm_round_trip", """SELECT c_custkey, round(300 + c_acctbal / 50, 5) AS easting,
  CAST(4000 + c_custkey % 1000 AS DOUBLE) AS northing FROM customer""")
def utm_round_trip(spark, sf):
    grid = table(spark, sf, "customer").select("c_custkey", (300 + F.col("c_acctbal") / 50).alias("e"),
                                               (4000 + F.col("c_custkey") % 1000).cast("double").alias("n"))
    lonlat = geo.utm_to_lonlat(grid, "e", "n", 17)
    return geo.lonlat_to_utm(lonlat, "longitude", "latitude", 17).select(
        "c_custkey", F.round("easting", 5).alias("easting"), F.round("northing", 5).alias("northing"))


@query("density_grid", f"""WITH p AS (SELECT CAST(floor(c_acctbal / 200.0) AS BIGINT) AS cx,
  CAST(floor((c_custkey % 1000) / 200.0) AS BIGINT) AS cy FROM customer),
o AS (SELECT i.i AS dx, j.i AS dy, exp(-0.5 * ((i.i * 200e0) * (i.i * 200e0) + (j.i * 200e0) * (j.i * 200e0)) / 62500e0)
  / (2 * {math.pi!r} * 62500e0) AS w FROM range(-4, 5) AS i(i), range(-4, 5) AS j(i))
SELECT CAST(cx + dx AS BIGINT) AS cx, CAST(cy + dy AS BIGINT) AS cy,
  round(sum(w) / (SELECT count(*) FROM customer) * 1e6, 6) AS per_million FROM p, o GROUP BY 1, 2""")
def density_grid(spark, sf):
    points = table(spark, sf, "customer").select("c_acctbal", (F.col("c_custkey") % 1000).cast("double").alias("y"))
    return geo.density_grid(points, "c_acctbal", "y", 200.0, 250.0).select(
        "cx", "cy", F.round(F.col("density") * 1e6, 6).alias("per_million"))


@query("method_agreement", f"""WITH {PANEL},
m AS (SELECT season, avg(weekly_rate) - (SELECT avg(weekly_rate) FROM panel WHERE age_cat = 'Overall'
    AND virus_cat = 'Overall') AS gap, max(weekly_rate) > 60 AS anomaly
  FROM panel WHERE age_cat = 'Overall' AND virus_cat = 'Overall' GROUP BY 1)
SELECT season, round(gap, 8) AS gap, anomaly, CASE WHEN gap > 0 THEN 'Positive' ELSE 'Negative' END AS gap_direction,
  CASE WHEN season = '1998-99' THEN 'N/A' WHEN gap > 0 AND anomaly THEN 'Yes — both methods flag'
    WHEN NOT gap > 0 AND NOT anomaly THEN 'Yes — both methods normal' ELSE 'Partial — methods diverge' END AS method_agreement
FROM m""")
def method_agreement_(spark, sf):
    rows = stratum(panel(spark, sf), PANEL_DIMS)
    centre = rows.select(F.avg("weekly_rate")).scalar()
    gaps = rows.groupBy("season").agg(F.avg("weekly_rate").alias("m")).select("season", (F.col("m") - centre).alias("gap"))
    odd = rows.groupBy("season").agg((F.max("weekly_rate") > 60).alias("anomaly"))
    return method_agreement(gaps, odd, "season", "gap", "anomaly", SUPPRESSED).withColumn("gap", F.round("gap", 8))
