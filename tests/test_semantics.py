"""One test per rule that is easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from episcope.functions import expr
from episcope.operators import clean, filters, joins, ordered, rules, tabulate, windows
from episcope.plans import cohort, incidence, surveillance
from episcope.sources import tables as src
from tests.conftest import rows

D = dt.date


def one(df):
    return df.first()[0]


def test_cut_is_right_closed_with_lowest_edge(spark):
    df = spark.createDataFrame([(v,) for v in (18, 29, 30, 45, 90, 91, None)], "age int")
    got = [r[0] for r in df.select(expr.cut("age", [18, 29, 44, 90], ["a", "b", "c"])).collect()]
    assert got == ["a", "a", "b", "c", "c", None, None]


def test_epiweek_sunday_trap(spark):
    df = spark.createDataFrame([(2015, 1), (2016, 1), (2016, 40), (None, 3)], "year int, week int")
    plain = [r[0] for r in df.select(expr.epiweek_date("year", "week")).collect()]
    exact = [r[0] for r in df.select(expr.epiweek_date("year", "week", mmwr_exact=True)).collect()]
    assert plain == [D(2014, 12, 28), D(2016, 1, 3), D(2016, 10, 2), None]
    assert exact == [D(2015, 1, 4), D(2016, 1, 3), D(2016, 10, 2), None]


def test_signif_and_per_100k(spark):
    df = spark.createDataFrame([(0.0,), (1234.0,), (0.0456,)], "x double")
    assert [r[0] for r in df.select(expr.signif("x", 2)).collect()] == pytest.approx([0.0, 1200.0, 0.046])
    assert one(spark.range(1).select(expr.per_100k(F.lit(7), 250_000, digits=1))) == 2.8


def test_ladder_and_direction(spark):
    df = spark.createDataFrame([(25.0,), (25.1,), (10.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(expr.ladder("x", incidence.CONCERN, "Low")).collect()]
    assert got == ["Medium", "High", "Low", "Low"]
    assert [r[0] for r in df.select(expr.direction(F.col("x") - 10)).collect()] == [
        "Increasing", "Increasing", "No Change", "Decreasing"]


def test_cells_and_parsing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, None), (3.0, None)], "m double, s double")
    assert [r[0] for r in df.select(expr.mean_sd_cell(F.col("m"), F.col("s"))).collect()] == ["1.0 (2.0)", "—", "3.0 (nan)"]
    cell = spark.createDataFrame([("0.98–1.20",), ("1.5 to 2",), ("No data",)], "c string")
    assert [tuple(r[0]) for r in cell.select(expr.parse_interval("c")).collect()] == [(0.98, 1.2), (1.5, 2.0), (None, None)]


def test_coercion_markers(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("X",), (" null",), ("",), ("abc",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in clean.coerce_rate(df, "v").collect()] == [1.5, None, None, None, None, None, None]
    assert rows(clean.coercion_failures(df, ["v"])) == [("v", 2)]
    ints = spark.createDataFrame([("12.0",), ("7",), ("x",)], "v string")
    assert [r[0] for r in clean.coerce_int(ints, "v").collect()] == [12, 7, None]


def test_normalize_binary_two_unknowns(spark):
    df = spark.createDataFrame([(" Yes",), ("no",), ("beta",), ("Alpha",), (None,)], "v string")
    assert [r[0] for r in clean.normalize_binary(df, "v").collect()] == [1, 0, 1, 0, None]
    three = spark.createDataFrame([("a",), ("b",), ("c",), ("yes",)], "v string")
    assert [r[0] for r in clean.normalize_binary(three, "v", true_tokens=["yes"], false_tokens=["no"]).collect()] == [
        None, None, None, 1]


def test_repeated_header_and_bom(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("﻿CATCHMENT,YEAR,YEAR,WEEK\nEntire,2009-10,2009,40\n,,,\n", encoding="utf-8")
    df = src.read_table(spark, str(path))
    assert df.columns == ["CATCHMENT", "YEAR", "YEAR.1", "WEEK"]
    assert clean.drop_blank_rows(df, "CATCHMENT").count() == 1
    with pytest.raises(ValueError, match="LOWER"):
        src.require_columns(df, ["WEEK", "LOWER"])


def test_dates_at_scan(spark, tmp_path):
    path = tmp_path / "notes.txt"
    path.write_text("patient_id|note_date|note_text\n1|2022-09-26|Denies nausea today\n2|bad|GI intolerance\n3|2022-10-03|\n")
    df = src.read_table(spark, str(path), sep="|", dates={"note_date": "yyyy-MM-dd"})
    assert [r[0] for r in df.orderBy("patient_id").select("note_date").collect()] == [D(2022, 9, 26), None, D(2022, 10, 3)]
    assert src.read_table(spark, str(path), sep="|", dates={"note_date": "yyyy-MM-dd"}, drop_bad_dates=True).count() == 2
    flags = filters.mentions(df, "note_text", cohort.GI_PATTERN, "m").orderBy("patient_id").select("m").collect()
    assert [r[0] for r in flags] == [True, True, False]


def test_last_days_has_n_plus_one_days(spark):
    df = spark.createDataFrame([(D(2024, 1, d),) for d in range(1, 21)], "d date")
    assert filters.last_days(df, "d", 7).count() == 8
    assert filters.at_latest(df, "d").collect()[0][0] == D(2024, 1, 20)


def test_windows_count_rows_not_days(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), 1), ("a", D(2024, 3, 1), 2), ("a", D(2024, 3, 2), 4)], "k string, d date, v int")
    by_row = windows.rolling_sum(df, ["k"], "d", "v", 7, bounded=True)
    by_day = windows.rolling_sum(df, ["k"], "d", "v", 7, calendar=True)
    assert [r["rolling_7"] for r in by_row.orderBy("d").collect()] == [1, 3, 7]
    assert [r["rolling_7"] for r in by_day.orderBy("d").collect()] == [1, 2, 6]


def test_week_number_order_is_not_chronological(spark):
    df = spark.createDataFrame([("s", 40, D(2009, 10, 4), 1.0), ("s", 52, D(2009, 12, 27), 2.0), ("s", 1, D(2010, 1, 3), 3.0)],
                               "season string, week int, d date, r double")
    by_week = {r["week"]: r["lag1_r"] for r in windows.lags(df, ["season"], "week", "r", [1], bounded=True).collect()}
    by_date = {r["week"]: r["lag1_r"] for r in windows.lags(df, ["season"], "d", "r", [1]).collect()}
    assert by_week == {1: None, 40: 3.0, 52: 1.0}
    assert by_date == {40: None, 52: 1.0, 1: 2.0}


def test_rolling_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0), (3, None), (4, 8.0), (5, 1.0)], "t int, v double")
    got = [r["m"] for r in windows.rolling_mean(df, [], "t", "v", 4, "m").orderBy("t").collect()]
    assert got == [None, 4.0, 4.0, 6.0, pytest.approx(13 / 3)]


def test_keep_max_ties_and_all_null(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("a", 3, 5.0), ("b", 1, None), ("b", 2, None)], "k string, w int, v double")
    assert rows(windows.keep_max(df, ["k"], "v", ["w"])) == [("a", 2, 5.0), ("b", 1, None)]
    kept = windows.resolve_duplicates(df, F.col("k") == "a", ["k"], "v", ["w"])
    assert kept.count() == 3


def test_peak_null_is_zero_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3.0), ("a", 3, 3.0), ("b", 5, None), ("b", 4, None)], "k string, week int, v double")
    assert rows(tabulate.peak(df, ["k"], "week", "v")) == [("a", 2, 3.0), ("b", 4, None)]


def test_two_week_period_in_plain_mode_is_one_week(spark):
    df = spark.createDataFrame([(D(2022, 9, 26),), (D(2022, 10, 2),), (D(2022, 10, 3),)], "d date")
    assert rows(tabulate.period_counts(df, "d"), "period") == [(D(2022, 9, 26), 2), (D(2022, 10, 3), 1)]
    assert sum(r[1] for r in rows(tabulate.period_counts(df, "d", n=2))) == 3


def test_daily_positives_keep_zero_days(spark):
    df = spark.createDataFrame([("f", D(2024, 1, 1), 0), ("f", D(2024, 1, 2), 1), ("f", D(2024, 1, 2), 1)], "p string, d date, r int")
    assert rows(tabulate.daily_positives(df, "d", ["p"], F.col("r") == 1)) == [("f", D(2024, 1, 1), 0), ("f", D(2024, 1, 2), 2)]


def test_latest_day_drops_silent_pathogens(spark):
    df = spark.createDataFrame([("f", D(2024, 1, 1), 1), ("f", D(2024, 1, 2), 1), ("m", D(2024, 1, 1), 1)], "p string, d date, r int")
    report = incidence.incidence_report(df, "d", "p", F.col("r") == 1, 100_000)
    assert [tuple(r) for r in report.collect()] == [("f", 2.0, 2.0, 0.0, "Low")]


def test_status_sign_flag(spark):
    days = [("f", D(2024, 1, 1) + dt.timedelta(days=i), 1) for i in range(30) for _ in range(1 + i // 10)]
    df = spark.createDataFrame(days, "p string, d date, r int")
    up = incidence.recent_vs_older(df, "d", "p", F.col("r") == 1, 100_000).first()
    flipped = incidence.recent_vs_older(df, "d", "p", F.col("r") == 1, 100_000, reference_sign=True).first()
    assert up["status"] == "Increasing" and flipped["status"] == "Decreasing"
    assert up["pct_change"] == -flipped["pct_change"]


def _arrivals(spark):
    as_of = D(2024, 5, 20)
    base = dict(lice="negative", varicella="negative", covid="negative", flu="negative", temp=98.6, symptoms="none", days=3)
    cases = [
        ("lice first", dict(lice="positive", covid="positive"), "Isolate (Lice)", "Lice"),
        ("varicella", dict(varicella="positive", flu="positive"), "Isolate (Varicella)", "Varicella"),
        ("covid 11", dict(covid="positive", days=11), "Quarantine (COVID - Active)", "COVID"),
        ("covid 12 fever", dict(covid="positive", days=12, temp=100.0), "Quarantine (COVID - Fever Post Isolation)", "COVID"),
        ("covid 12", dict(covid="positive", days=12), "Clear (COVID - Past Window)", "None"),
        ("covid past, flu active", dict(covid="positive", flu="positive", days=12), "Clear (COVID - Past Window)", "None"),
        ("flu 8", dict(flu="positive", days=8), "Quarantine (Flu - Active)", "Flu"),
        ("flu 9", dict(flu="positive", days=9), "Clear (Flu - Past Window)", "None"),
        ("covid past, flu fever", dict(covid="positive", flu="positive", days=12, temp=101.0), "Quarantine (COVID - Fever Post Isolation)", "COVID"),
        ("symptoms 5", dict(temp=100.0, symptoms="Fever, rash", days=5), "Quarantine (Symptomatic)", "Symptom-Based"),
        ("symptoms 6", dict(temp=100.0, symptoms="fever", days=6), "Clear", "None"),
        ("below fever", dict(temp=99.9, symptoms="fever"), "Clear", "None"),
        ("no symptoms", dict(temp=103.0, symptoms=" None "), "Clear", "None"),
        ("future", dict(temp=100.0, symptoms="cough", days=-4), "Quarantine (Symptomatic)", "Symptom-Based"),
    ]
    data = []
    for name, change, decision, label in cases:
        v = {**base, **change}
        data.append((name, as_of - dt.timedelta(days=v["days"]), v["lice"], v["varicella"], v["covid"], v["flu"], v["temp"],
                     v["symptoms"], decision, label))
    return spark.createDataFrame(data, "name string, arrival_date date, lice_status string, varicella_status string, "
                                       "covid_status string, flu_status string, temp double, symptoms string, want string, label string")


def test_triage_branches(spark):
    got = rules.triage(_arrivals(spark), "2024-05-20").select("name", "triage_decision", "want").collect()
    assert all(r["triage_decision"] == r["want"] for r in got), got


def test_triage_label_falls_through(spark):
    df = _arrivals(spark)
    got = {r["name"]: (r["triage_reason"], r["label"]) for r in rules.triage_label(df, "2024-05-20").collect()}
    assert all(a == b for a, b in got.values()), got
    active = df.where("name = 'covid past, flu active'").withColumn("arrival_date", F.lit(D(2024, 5, 12)))
    active = active.withColumn("covid_status", F.lit("positive"))
    assert rules.triage(active, "2024-05-20").first()["triage_reason"] == "COVID"
    late = active.withColumn("arrival_date", F.lit(D(2024, 5, 1)))
    assert rules.triage(late, "2024-05-20").first()["triage_decision"] == "Clear (COVID - Past Window)"


def test_held_counts_and_sensitivity(spark):
    df = _arrivals(spark)
    held = {r[0]: r[1] for r in rules.held_counts(rules.triage(df, "2024-05-20")).collect()}
    assert held == {"COVID": 3, "Flu": 1, "Lice": 1, "Symptom-Based": 2, "Varicella": 1}
    table = rules.threshold_sensitivity(df, "2024-05-20", {"a": 99.5, "b": 100.0, "c": 104.0}).collect()
    assert "None" not in [r["triage_reason"] for r in table]
    symptom = next(r for r in table if r["triage_reason"] == "Symptom-Based")
    assert (symptom["a"], symptom["b"], symptom["c"]) == (round(3 / 14, 3), round(2 / 14, 3), 0.0)


def test_exists_labels(spark):
    dx = spark.createDataFrame([(1, "E11.9"), (1, "E66.9"), (2, "E66.9")], "patient_id long, icd_code string")
    rx = spark.createDataFrame([(2,), (3,), (3,)], "patient_id long")
    assert rows(cohort.patient_labels(dx, rx)) == [(1, True, False), (2, False, True), (3, False, True)]


def test_group_code_small_and_large_agree(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("b", 1), (None, 1)], "s string, p int")
    small = rows(clean.group_code(df, ["s", "p"], "code"))
    large = rows(clean.group_code(df, ["s", "p"], "code", small=1))
    assert small == large
    assert {r[:2]: r[2] for r in small} == {(None, 1): 1, ("a", 1): 2, ("a", 2): 3, ("b", 1): 4}


def test_enrich_with_hot_key_equals_plain_join(spark):
    fact = spark.range(900).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    fact = fact.unionByName(spark.range(5).select(F.lit(None).cast("long").alias("k"), (F.col("id") + 1000).alias("id")))
    dim = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert joins.hot_keys(fact, "k", 0.1) == [(7,)]
    for how in ("left", "inner"):
        assert rows(joins.enrich(fact, dim, "k", how, rows=5)) == rows(fact.join(dim, "k", how))


def test_spread_windows_equal_plain_ones(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
                                  (F.col("id") * 37 % 1009).alias("t"), "id", (F.col("id") % 11).cast("double").alias("v"))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.lag("v", 3).over(w).alias("l"), F.sum("v").over(w.rowsBetween(-4, 0)).alias("s"),
                     F.row_number().over(w).cast("long").alias("pos"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    got = ordered.windowed(df, ["k"], "t", 5, {"l": lambda x: F.lag("v", 3).over(x), "s": lambda x: F.sum("v").over(x.rowsBetween(-4, 0))},
                           tie=["id"], block=50)
    assert rows(got.select("id", "l", "s")) == rows(want.select("id", "l", "s"))
    assert rows(ordered.positions(df, ["k"], "t", tie=["id"]).select("id", "pos")) == rows(want.select("id", "pos"))
    total = ordered.running_totals(df, ["k"], "t", {"c": "v"}, tie=["id"])
    assert rows(total.select("id", "c")) == rows(want.select("id", "c"))


def test_quantiles_equal_percentile(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 613 / 10.0).alias("v"))
    got = {r["k"]: (r["a"], r["b"]) for r in ordered.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.975}).collect()}
    want = {r["k"]: (r["a"], r["b"]) for r in df.groupBy("k").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.975).alias("b")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert one(ordered.quantiles(df, [], "v", {"m": 0.5})) == pytest.approx(one(df.agg(F.percentile("v", 0.5))))


def test_results_do_not_depend_on_partitions(spark):
    from episcope.operators import learning
    df = spark.range(500).select("id", (F.col("id") % 4).alias("label"))
    a = rows(learning.stratified_split(df.repartition(1), "id", "label", {"train": 0.7, "test": 0.3}))
    b = rows(learning.stratified_split(df.repartition(13), "id", "label", {"train": 0.7, "test": 0.3}))
    assert a == b


def test_missingness_audit_and_exemptions(spark):
    df = spark.createDataFrame([("2020-21", None, 1.0), ("2019-20", None, 2.0), ("2019-20", 1.0, None)], "season string, w double, c double")
    audit = {r["column"]: r for r in tabulate.missingness_audit(df, {"w": F.col("season") == "2020-21", "c": F.lit(True)}).collect()}
    assert (audit["w"]["n_structural"], audit["w"]["n_unexpected"], audit["c"]["note"]) == (1, 1, "all structural")
    table = tabulate.missingness(df, ["season"], ["w", "c"], 0.05, exempt=["c"], exempt_rows=F.col("season") == "2020-21")
    assert sorted((r["season"], r["variable"]) for r in table.where("flagged").collect()) == [("2019-20", "w")]


def test_layout_has_headers_blanks_and_dashes(spark):
    cells = spark.createDataFrame([("Overall", "Overall", "pre", "1.0 (0.5–2.0)")], "stratum_variable string, stratum_value string, phase string, m string")
    out = surveillance.layout(cells, [("Panel A", "Overall", ["Overall", "Missing"])], {"m": "Median"}, {"pre": "PRE", "rec": "REC"})
    assert [tuple(r)[1:] for r in out.collect()] == [("Panel A", "", ""), ("Overall", "1.0 (0.5–2.0)", "—"), ("", "", "")]


def test_phase_and_denominator_maps():
    phases, denominators = surveillance.phase_map(), surveillance.denominator_map()
    assert phases["2009-10"] == "pre_pandemic" and phases["2019-20"] == "disruption" and phases["2025-26"] == "recovery"
    assert denominators["2019-20"] == "bridged" and denominators["2020-21"] == "unbridged" and len(phases) == 17


def test_duplicate_weeks_in_features(spark):
    d = D(2014, 12, 28)
    data = [("2014-15", "pre_pandemic", d, 53, "Overall", "Overall", 2.0, 2.0), ("2014-15", "pre_pandemic", d, 1, "Overall", "Overall", 3.0, 5.0),
            ("2014-15", "pre_pandemic", d, 1, "0-4 yr", "Overall", 1.0, 1.0), ("2014-15", "pre_pandemic", d, 53, "0-4 yr", "Overall", 1.0, 1.0)]
    df = spark.createDataFrame(data, "season string, phase string, epiweek_date date, week int, age_cat string, virus_cat string, weekly_rate double, cum_rate double")
    out = surveillance.add_features(df, ("age_cat", "virus_cat"))
    overall = out.where("age_cat = 'Overall'").collect()
    assert len(overall) == 1 and overall[0]["weekly_rate"] == 3.0
    assert out.where("age_cat = '0-4 yr'").count() == 2
    assert {r["n_weeks_in_season"] for r in out.collect()} == {2}


@pytest.mark.parametrize("second", ["n", "name", "day"])
def test_ties_on_one_date_are_split(spark, second):
    """Nine tenths of the rows share one date; the largest range stays small and positions stay exact."""
    df = spark.range(8000).selectExpr(
        "date_add(date'2024-01-01', if(id % 10 = 0, cast(id % 7 as int), 3)) AS d", "id % 2 AS g", "(id * 7919) % 8000 AS n",
        "concat('k', lpad(cast((id * 7919) % 8000 as string), 4, '0')) AS name", "date_add(date'2000-01-01', cast((id * 7919) % 8000 as int)) AS day")
    ranged = ordered.with_composite_ranges(df, "d", [second, "n"], parts=16)
    sizes = [r["count"] for r in ranged.groupBy("__range").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 8000 / 16 * 2.5 and ranged.columns == [*df.columns, "__range"]
    # The ranges follow the order: none begins before the one below it ends.
    ends = ranged.groupBy("__range").agg(F.min(F.struct("d", second)).alias("a"), F.max(F.struct("d", second)).alias("b")).orderBy("__range").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))
    got = {(r["g"], r["n"]): r["pos"] for r in ordered.positions(df, ["g"], "d", "pos", [second, "n"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["g"], r["d"], r[second], r["n"]))
    counts = {0: 0, 1: 0}
    for r in rows:
        counts[r["g"]] += 1
        assert got[r["g"], r["n"]] == counts[r["g"]]


def test_ties_of_several_columns(spark):
    """One date and one name hold most rows; nulls in a tie column come first, as they sort."""
    df = spark.range(6000).selectExpr("date'2024-01-01' AS d", "if(id % 20 = 0, cast(null as string), if(id % 5 = 0, concat('a', id % 9), 'same')) AS name", "(id * 7919) % 6000 AS n")
    ranged = ordered.with_composite_ranges(df, "d", ["name", "n"], parts=12)
    assert max(r["count"] for r in ranged.groupBy("__range").count().collect()) < 6000 / 12 * 3
    got = {r["n"]: r["pos"] for r in ordered.positions(df, [], "d", "pos", ["name", "n"]).collect()}
    rows = sorted(df.collect(), key=lambda r: (r["name"] is not None, r["name"] or "", r["n"]))
    assert [got[r["n"]] for r in rows] == list(range(1, 6001))
    empty = ordered.positions(df.limit(0), [], "d", "pos", ["name", "n"])
    assert empty.count() == 0
