"""Weekly surveillance tables: from raw text extract to season panels and publication tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.expr import (all_of, clip, epiweek_date, first_season_year, flag, log1p_filled, mean_sd_cell,
                                     median_iqr_cell, weeks_since)
from episcope.operators import clean
from episcope.operators.filters import mentions_word, stratum
from episcope.operators.tabulate import peak_at
from episcope.operators.windows import dense_position, lags, resolve_duplicates, rolling_mean

TOTAL = "Overall"
DIMS = ("age_cat", "sex_cat", "race_cat", "virus_cat")
RATES = ("cum_rate", "weekly_rate", "age_adj_cum_rate", "age_adj_weekly_rate")

# Column names of the raw extract.
RAW_NAMES = {
    "CATCHMENT": "catchment",
    "NETWORK": "network",
    "YEAR": "season",
    "YEAR.1": "year",
    "WEEK": "week",
    "AGE CATEGORY": "age_cat",
    "SEX CATEGORY": "sex_cat",
    "RACE CATEGORY": "race_cat",
    "VIRUS TYPE CATEGORY": "virus_cat",
    "CUMULATIVE RATE": "cum_rate",
    "WEEKLY RATE": "weekly_rate",
    "AGE ADJUSTED CUMULATIVE RATE": "age_adj_cum_rate",
    "AGE ADJUSTED WEEKLY RATE": "age_adj_weekly_rate",
    "LOWER": "ci_lower",
    "MEDIAN": "ci_median",
    "UPPER": "ci_upper",
}
# First and last season start year of each phase, and seasons with known gaps.
PHASE_YEARS = {"pre_pandemic": (2009, 2018), "disruption": (2019, 2021), "recovery": (2022, 2025)}
UNBRIDGED_FROM = 2020
H1N1_SEASON, SUPPRESSED_SEASON, YEAR_ROUND_SEASON, PARTIAL_SEASON = "2009-10", "2020-21", "2023-24", "2025-26"
PANDEMIC_ANCHOR = "2020-09-27"
AGE_CORRECTIONS = {"5-11  yr": "5-11 yr"}
ACTIVE_RATE = 0.1


def season_name(start_year: int) -> str:
    return f"{start_year}-{(start_year + 1) % 100:02d}"


def phase_map() -> dict[str, str]:
    return {season_name(y): phase for phase, (a, b) in PHASE_YEARS.items() for y in range(a, b + 1)}


def denominator_map() -> dict[str, str]:
    first, last = PHASE_YEARS["pre_pandemic"][0], PHASE_YEARS["recovery"][1]
    return {season_name(y): "unbridged" if y >= UNBRIDGED_FROM else "bridged" for y in range(first, last + 1)}


def clean_extract(raw: DataFrame, network: str = "ENTIRE") -> DataFrame:
    """Typed, labelled table from the all-text extract: names, rates, footer rows, phase, flags and epiweek date."""
    named = clean.rename_known(clean.clean_strings(raw), RAW_NAMES)
    rows = clean.drop_blank_rows(named, "season").where(mentions_word("network", network))
    for col in (*RATES, "ci_lower", "ci_median", "ci_upper"):
        if col in rows.columns:
            rows = clean.coerce_rate(rows, col)
    for col in ("year", "week"):
        rows = clean.coerce_int(rows, col)
    rows = clean.replace_values(rows, "age_cat", AGE_CORRECTIONS)
    rows = clean.lookup(rows, "season", phase_map(), "phase", default="unknown")
    rows = clean.lookup(rows, "season", denominator_map(), "denom_version", default="unknown")
    return rows.withColumns({
        "season_year": first_season_year("season"),
        "h1n1_flag": flag(F.col("season") == H1N1_SEASON),
        "partial_season_flag": flag(F.col("season") == PARTIAL_SEASON),
        "suppressed_flag": flag(F.col("season") == SUPPRESSED_SEASON),
        "year_round_season_flag": flag(F.col("season") == YEAR_ROUND_SEASON),
        "race_gap_flag": clean.structural_gap("season", SUPPRESSED_SEASON, "race_cat", "weekly_rate"),
        "epiweek_date": epiweek_date("year", "week"),
    })


def add_features(df: DataFrame, dims: Sequence[str] = DIMS, order: str = "week") -> DataFrame:
    """Duplicate weeks resolved, then log rates, phase dummies, week numbers, lags and the 4-row mean.

    Lags follow ``order`` within season and stratum. The default, week number, is what the published tables use; a
    date column gives chronological lags.
    """
    overall = all_of([F.col(d) == TOTAL for d in dims])
    rows = resolve_duplicates(df, overall, ["epiweek_date", *dims], "weekly_rate", ["season", "week"])
    rows = dense_position(rows, ["season"], "week", "season_week_num", bounded=True)
    weeks = df.groupBy("season").agg(F.countDistinct("week").alias("n_weeks_in_season"))
    rows = rows.join(F.broadcast(weeks), "season", "left")  # one row per season
    rows = rows.withColumns({
        "log1p_weekly_rate": log1p_filled("weekly_rate"),
        "log1p_cum_rate": log1p_filled("cum_rate"),
        "weeks_since_pandemic": weeks_since("epiweek_date", PANDEMIC_ANCHOR),
        **{f"phase_{p}": flag(F.col("phase") == p) for p in PHASE_YEARS},
    })
    keys = ["season", *dims]
    # A stratum has at most 53 weeks per season, so these windows are small.
    rows = lags(rows, keys, order, "weekly_rate", (1, 2, 4), bounded=True, tie=["epiweek_date"])
    return rolling_mean(rows, keys, order, "weekly_rate", 4, "roll4_weekly_rate", bounded=True, tie=["epiweek_date"])


def weekly_series(df: DataFrame, dims: Sequence[str] = DIMS, partial: Sequence[str] = (PARTIAL_SEASON,)) -> DataFrame:
    """Overall weekly series of complete seasons, one row per date."""
    rows = stratum(df, dims).where(~F.col("season").isin(*partial))
    return resolve_duplicates(rows, F.lit(True), ["epiweek_date"], "weekly_rate", ["season", "week"])


def panels(df: DataFrame, dims: Sequence[str] = DIMS) -> dict[str, DataFrame]:
    """The panels that are published: overall, and one per free dimension."""
    out = {"overall": stratum(df, dims)}
    for d in dims:
        out[d.removesuffix("_cat")] = stratum(df, dims, free=[d])
    return out


def phase_table(df: DataFrame, phase: str, label: str, value: str | None = None, **columns) -> DataFrame:
    """Numeric Table 1 rows for one stratum variable of an already filtered frame."""
    stratum_value = F.lit(TOTAL) if value is None else F.col(value)
    return _phase_rows(df.withColumns({"stratum_variable": F.lit(label), "stratum_value": stratum_value}), phase, **columns)


def _phase_rows(df: DataFrame, phase: str, season: str = "season", week: str = "week", weekly: str = "weekly_rate",
                cumulative: str = "cum_rate", suppressed: Sequence[str] = (SUPPRESSED_SEASON,),
                active: float = ACTIVE_RATE) -> DataFrame:
    """Per phase and stratum value, two levels of aggregation.

    Suppressed seasons count towards the number of seasons and the cumulative rate, not towards weekly summaries.
    """
    open_week = ~F.col(season).isin(*suppressed) if suppressed else F.lit(True)
    rows = df.select("stratum_variable", "stratum_value", F.col(phase).alias("phase"), F.col(season).alias("season"),
                     F.col(week).alias("week"), F.when(open_week, F.col(weekly)).alias("weekly"),
                     open_week.alias("open"), F.col(cumulative).alias("cum"))
    keys = ["phase", "stratum_variable", "stratum_value"]
    per_season = rows.groupBy(*keys, "season").agg(
        F.max("weekly").alias("peak"),
        F.max("cum").alias("cum"),
        F.when(F.bool_or("open"), peak_at("week", "weekly")).alias("peak_week"),
        F.when(F.bool_or("open"), F.count_if(F.col("weekly") >= active)).alias("duration"))
    seasons = per_season.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seasons"),
        F.avg("peak").alias("peak_mean"), F.stddev_samp("peak").alias("peak_sd"),
        F.avg("cum").alias("cum_mean"), F.stddev_samp("cum").alias("cum_sd"),
        *_quartiles("peak_week"), *_quartiles("duration"))
    weeks = rows.groupBy(*keys).agg(
        F.count("weekly").alias("n_weeks_obs"), *_quartiles("weekly"),
        F.avg("weekly").alias("weekly_mean"), F.stddev_samp("weekly").alias("weekly_sd"))
    return seasons.join(weeks, keys)


def _quartiles(col: str) -> list[Column]:
    # Season and week counts per cell are bounded by the calendar; the built-in exact percentile is enough.
    return [F.percentile(col, p).alias(f"{col}_{n}") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]


def table_one(df: DataFrame, strata: Mapping[str, tuple[str | None, Sequence[str]]], phase: str = "phase",
              dims: Sequence[str] = DIMS, **columns) -> DataFrame:
    """Table 1 over several strata; ``strata`` maps a label to (dimension, wanted values).

    Every row is told the strata it belongs to, so all strata share the same two aggregates and one reading of the table.
    """
    homes = []
    for label, (dim, values) in strata.items():
        inside = all_of([F.col(d) == TOTAL for d in dims if d != dim])
        if dim:
            inside = inside & F.col(dim).isin(*values)
        home = F.struct(F.lit(label).alias("stratum_variable"),
                        (F.col(dim) if dim else F.lit(TOTAL)).alias("stratum_value"))
        homes.append(F.when(inside, home))
    placed = df.withColumn("__home", F.explode(F.array_compact(F.array(*homes)))).select("*", "__home.*").drop("__home")
    return _phase_rows(placed, phase, **columns)


def table_one_cells(table: DataFrame) -> DataFrame:
    """The numeric Table 1 as text cells."""
    def iqr(name: str, digits: int) -> Column:
        return median_iqr_cell(F.col(f"{name}_median"), F.col(f"{name}_q1"), F.col(f"{name}_q3"), digits)

    return table.select(
        "stratum_variable", "stratum_value", "phase", "n_seasons", "n_weeks_obs",
        iqr("weekly", 1).alias("weekly_median_iqr"),
        mean_sd_cell(F.col("weekly_mean"), F.col("weekly_sd")).alias("weekly_mean_sd"),
        mean_sd_cell(F.col("peak_mean"), F.col("peak_sd")).alias("peak_rate_mean_sd"),
        iqr("peak_week", 0).alias("peak_week_median_iqr"),
        mean_sd_cell(F.col("cum_mean"), F.col("cum_sd")).alias("cum_rate_mean_sd"),
        iqr("duration", 0).alias("season_dur_median_iqr"))


def layout(cells: DataFrame, panels_: Sequence[tuple[str, str, Sequence[str]]], metrics: Mapping[str, str],
           phases: Mapping[str, str]) -> DataFrame:
    """Publication layout: a header row per panel, one row per group with a column per metric and phase, a blank row
    after each panel, and an em dash where a cell has no data. ``position`` carries the printed order."""
    spark = cells.sparkSession
    wide = cells.groupBy("stratum_variable", "stratum_value").agg(*[
        F.max(F.when(F.col("phase") == phase, F.col(metric))).alias(f"{title} {short}")
        for metric, title in metrics.items() for phase, short in phases.items()])
    titles = [c for c in wide.columns if c not in ("stratum_variable", "stratum_value")]
    skeleton = []
    for i, (header, variable, groups) in enumerate(panels_):
        skeleton.append((1000 * i, header, None, None))
        skeleton += [(1000 * i + 1 + j, g, variable, g) for j, g in enumerate(groups)]
        skeleton.append((1000 * i + 999, "", None, None))
    frame = spark.createDataFrame(
        skeleton, "position long, `Group` string, stratum_variable string, stratum_value string")
    joined = F.broadcast(frame).join(
        wide.withColumn("present", F.lit(True)), ["stratum_variable", "stratum_value"], "left")
    shown = joined.where(F.col("stratum_variable").isNull() | F.col("present"))
    cell = lambda t: F.when(F.col("stratum_variable").isNull(), "").otherwise(
        F.coalesce(F.col(f"`{t}`"), F.lit("—")))
    return shown.select("position", "Group", *[cell(t).alias(t) for t in titles]).orderBy("position")


def season_features(df: DataFrame, keys: Sequence[str], week: str = "week", weekly: str = "weekly_rate",
                    excluded: Sequence[str] = (), season: str = "season") -> DataFrame:
    """Season feature matrix: peak, mean, total, weeks, peak week and coefficient of variation."""
    rows = df.where(F.col(weekly).isNotNull())
    if excluded:
        rows = rows.where(~F.col(season).isin(*excluded))
    mean, sd = F.avg(weekly), F.stddev_samp(weekly)
    return rows.groupBy(*keys).agg(
        F.max(weekly).alias("peak_rate"), mean.alias("mean_rate"), F.sum(weekly).alias("cum_rate"),
        F.count(weekly).alias("n_weeks"), peak_at(week, weekly).alias("peak_week"),
        F.when(mean > 0, sd / mean).otherwise(0.0).alias("cv"))


def cumulative_rate(df: DataFrame, keys: Sequence[str], order: str, weekly: str, out: str = "cum_rate") -> DataFrame:
    """Running total of weekly rates within a season and stratum (at most 53 rows)."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(weekly).over(window))


def floor_rates(df: DataFrame, cols: Sequence[str], low: float = 0.0) -> DataFrame:
    return df.withColumns({c: clip(c, low=low) for c in cols})
