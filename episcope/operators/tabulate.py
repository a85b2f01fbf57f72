"""Counts, summaries, panels and audits. Every operator is an aggregate with map-side combine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.expr import all_of, flag, is_true, ladder
from episcope.operators.joins import enrich
from episcope.operators.ordered import quantiles, windowed

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in skip]


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups with a null key are not reported."""
    return df.dropna(subset=list(keys)) if keys else df


# --- counts and means -------------------------------------------------------------------------------------------

def counts(df: DataFrame, keys: Sequence[str], where: Column | None = None, of: str | None = None,
           out: str = "n") -> DataFrame:
    """Rows (or non-null values of ``of``) per key, largest first."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1) if of is None else F.col(of)).alias(out)).orderBy(
        F.desc(out), *keys)


def means(df: DataFrame, cols: Mapping[str, str], keys: Sequence[str] = (), where: Column | None = None,
          digits: int | None = None) -> DataFrame:
    """Mean of ``{out: column}`` per key, rounded on request. Conditions average to proportions."""
    rows = drop_null_keys(df if where is None else df.where(where), keys)
    types = dict(df.dtypes)

    def mean(c: str) -> Column:
        value = F.col(c).cast("int") if types.get(c) == "boolean" else F.col(c)
        return F.avg(value) if digits is None else F.round(F.avg(value), digits)

    return rows.groupBy(*keys).agg(*[mean(c).alias(o) for o, c in cols.items()])


def daily_positives(df: DataFrame, date: str, keys: Sequence[str], result: Column, out: str = "count") -> DataFrame:
    """Positive tests per date and key. A day with tests and no positive is 0; a day without tests has no row."""
    return df.groupBy(*keys, F.col(date).cast("date").alias("test_date")).agg(F.count_if(is_true(result)).alias(out))


def period_counts(df: DataFrame, date: str, unit: str = "week", n: int = 1, keys: Sequence[str] = (),
                  anchor: str = "1970-01-05", out: str = "n") -> DataFrame:
    """Events per calendar period (weeks start on Monday). ``n`` weeks per bucket are counted from ``anchor``."""
    if n == 1:
        start = F.date_trunc(unit, F.col(date)).cast("date")
    elif unit == "week":
        start_day = F.lit(anchor).cast("date")
        span = 7 * n
        start = F.date_add(start_day, (F.floor(F.datediff(F.col(date), start_day) / span) * span).cast("int"))
    else:
        raise ValueError("several units per bucket are offered for weeks")
    return df.where(F.col(date).isNotNull()).groupBy(*keys, start.alias("period")).agg(F.count(F.lit(1)).alias(out))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Rows per category and, on request, their share of all non-null rows."""
    table = drop_null_keys(df, [col]).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return table
    return table.withColumn("share", F.col("n") / df.select(F.count(col)).scalar())


def epi_curve(df: DataFrame, date: str, cat: str, levels: Sequence[str]) -> DataFrame:
    """Month by category counts, one column per level, 0 where nothing happened."""
    month = F.date_format(F.col(date), "yyyy-MM").alias("month")
    return df.where(F.col(date).isNotNull()).groupBy(month).agg(
        *[F.count_if(F.col(cat) == level).alias(str(level)) for level in levels])


# --- seasons and peaks ------------------------------------------------------------------------------------------

def peak_at(order: str, value: str, report: str | None = None) -> Column:
    """The ``report`` column (default: the order itself) of the highest value; null counts as 0, the first row in
    order wins a tie."""
    key = F.struct((-F.coalesce(F.col(value), F.lit(0.0))).alias("v"), F.col(order).alias("o"))
    return F.min_by(F.col(report or order), key)


def peak(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(peak_at(order, value).alias(f"peak_{order}"), F.max(value).alias(f"peak_{value}"))


def season_summary(df: DataFrame, keys: Sequence[str], week: str = "week", weekly: str = "weekly_rate",
                   cumulative: str = "cum_rate", adjusted: str | None = None) -> DataFrame:
    """Distinct weeks, peak, peak week, mean and end-of-season values per season."""
    extra = [F.max(adjusted).alias("max_adjusted")] if adjusted else []
    return df.groupBy(*keys).agg(
        F.countDistinct(week).alias("n_weeks"),
        F.max(weekly).alias("peak_rate"),
        peak_at(week, weekly).alias("peak_week"),
        F.avg(weekly).alias("mean_rate"),
        F.max(cumulative).alias("max_cum_rate"), *extra)


def season_detail(df: DataFrame, keys: Sequence[str], week: str = "week", weekly: str = "weekly_rate",
                  cumulative: str = "cum_rate", active: float = 0.1, digits: int = 2) -> DataFrame:
    """One row per season with counts, spread, peak and active duration. A season has at most 53 weeks per stratum,
    so the built-in exact percentile holds few values."""
    quart = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rounded = lambda c: F.round(c, digits)
    return df.groupBy(*keys).agg(
        F.countDistinct(week).alias("n_weeks"),
        F.count(weekly).alias("n_obs"),
        F.count_if(F.col(weekly).isNull()).alias("n_missing"),
        rounded(F.avg(weekly)).alias("mean_rate"),
        rounded(F.stddev_samp(weekly)).alias("sd_rate"),
        *[rounded(F.percentile(weekly, p)).alias(f"{n}_rate") for n, p in quart.items()],
        rounded(F.min(weekly)).alias("min_rate"),
        rounded(F.max(weekly)).alias("peak_rate"),
        peak_at(week, weekly).alias("peak_week"),
        rounded(F.max(cumulative)).alias("max_cum_rate"),
        F.count_if(F.col(weekly) >= active).alias("active_weeks"))


# --- reshaping --------------------------------------------------------------------------------------------------

def to_wide(df: DataFrame, keys: Sequence[str], col: str, value: str, levels: Sequence, agg: str = "avg") -> DataFrame:
    """One column per level; duplicates are aggregated. Levels are given, so no extra job looks for them."""
    return df.groupBy(*keys).pivot(col, list(levels)).agg(F.expr(f"{agg}(`{value}`)"))


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "variable",
            value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(cols), name, value)


def rate_ratio_preview(wide: DataFrame, levels: Sequence[str], reference: str) -> DataFrame:
    """Per level: n, mean, min and max over seasons of level / reference."""
    ratios = wide.select(*[F.try_divide(F.col(f"`{lv}`"), F.col(f"`{reference}`")).alias(lv)
                           for lv in levels if lv != reference])
    long = ratios.unpivot([], ratios.columns, "level", "ratio")
    return long.groupBy("level").agg(F.count("ratio").alias("n"), F.avg("ratio").alias("mean_ratio"),
                                     F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"))


def full_grid(df: DataFrame, levels: Mapping[str, Sequence], value: str, fill=0) -> DataFrame:
    """Every combination of literal levels, with ``fill`` where the table has none."""
    spark = df.sparkSession
    grid = spark.range(1).drop("id")
    for col, values in levels.items():
        grid = grid.withColumn(col, F.explode(F.array(*[F.lit(v) for v in values])))
    joined = F.broadcast(grid).join(df, list(levels), "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


# --- audits -----------------------------------------------------------------------------------------------------

def missingness(df: DataFrame, keys: Sequence[str], cols: Sequence[str], threshold: float = 0.05,
                exempt: Sequence[str] = (), exempt_rows: Column | None = None) -> DataFrame:
    """Missing share per group and variable with a flag above the threshold; exempt variables and groups are reported
    but not flagged. All columns share one aggregate."""
    wide = drop_null_keys(df, keys).groupBy(*keys).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols])
    long = wide.unpivot(list(keys), list(cols), "variable", "miss_frac")
    excused = F.col("variable").isin(*exempt) if exempt else F.lit(False)
    if exempt_rows is not None:
        excused = excused | exempt_rows
    return long.withColumn("flagged", is_true((F.col("miss_frac") > threshold) & ~excused))


def missingness_audit(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per column: missing values, and how many of them a structural rule explains. One pass for all columns."""
    row = df.agg(*[F.struct(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col(c).isNull()).alias("n_missing"),
        F.count_if(F.col(c).isNull() & is_true(rule)).alias("n_structural")).alias(c) for c, rule in rules.items()])
    long = row.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in rules]), F.array(*[F.col(c) for c in rules]))).alias("column", "s"))
    unexpected = F.col("n_missing") - F.col("n_structural")
    return (long.select("column", "s.*")
            .withColumn("n_unexpected", unexpected)
            .withColumn("pct_missing", F.round(F.try_divide(F.col("n_missing") * 100.0, F.col("total_rows")), 1))
            .withColumn("structural", (F.col("n_missing") > 0) & (F.col("n_unexpected") == 0))
            .withColumn("note", F.when(F.col("n_missing") == 0, "complete")
                        .when(F.col("n_unexpected") == 0, "all structural")
                        .otherwise(F.concat(F.col("n_unexpected").cast("string"), F.lit(" unexpected")))))


def coverage(df: DataFrame, keys: Sequence[str], index: str, value: str, short: int = 20,
             sparse: int = 10) -> DataFrame:
    """Distinct index values and available share per group, with flags for short and sparse groups."""
    return df.groupBy(*keys).agg(
        F.countDistinct(index).alias("n_index"),
        F.count(value).alias("n_obs"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
    ).select("*", F.round(F.col("n_obs") * 100.0 / (F.col("n_obs") + F.col("n_null")), 1).alias("pct_available"),
             (F.col("n_index") < short).alias("short"), (F.col("n_obs") < sparse).alias("sparse"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return enrich(df, repeated, keys, how="left_semi")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_quality(df: DataFrame, keys: Sequence[str], arrival: str, index: str) -> DataFrame:
    """Does the index repeat, and does it rise along the arrival order? Exact for groups of any size."""
    step = windowed(df.select(*keys, arrival, index), keys, arrival, 1,
                    {"__prev": lambda w: F.lag(index).over(w)}, tie=[index])
    return step.groupBy(*keys).agg(
        F.count(index).alias("n_rows"),
        (F.count(index) - F.countDistinct(index)).alias("n_duplicates"),
        (F.count_if(F.col(index) < F.col("__prev")) == 0).alias("monotonic"))


def domain_audit(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """Observed values with their row count and whether they are on the allowed list."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where(F.col(col).isNotNull()).withColumn(
        "known", F.col(col).isin(*allowed))


def unexpected_values(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    return domain_audit(df, col, allowed).where(~F.col("known")).select(col, "n")


def level_order(df: DataFrame, col: str, wanted: Sequence[str]) -> DataFrame:
    """The wanted levels that occur, in the wanted order."""
    spark = df.sparkSession
    order = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "position long, level string")
    present = df.select(F.col(col).alias("level")).distinct()
    return F.broadcast(order).join(present, "level", "left_semi").orderBy("position")


def is_subset(df: DataFrame, col: str, allowed: Sequence[str]) -> DataFrame:
    """One row: do all non-null values lie in the allowed set?"""
    outside = F.col(col).isNotNull() & ~F.col(col).isin(*allowed)
    return df.agg((F.count_if(outside) == 0).alias("is_subset"))


def audit_log(spark, steps: Sequence[tuple[str, str, DataFrame, str]]) -> DataFrame:
    """One row per cleaning step; each step brings a one-row, one-column frame with the number of affected rows."""
    out = None
    for i, (step, operation, affected, note) in enumerate(steps):
        row = affected.toDF("n_affected").select(
            F.lit(i).cast("long").alias("position"), F.lit(step).alias("step"), F.lit(operation).alias("operation"),
            F.col("n_affected").cast("long").alias("n_affected"), F.lit(note).alias("note"))
        out = row if out is None else out.unionByName(row)
    return out


# --- descriptions -----------------------------------------------------------------------------------------------

def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sd, min, quartiles, max per column; quartiles are exact and need no per-column buffer.

    The columns are stacked once, so one pass counts distinct values of all of them.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "variable", "value")
    long = long.where(F.col("value").isNotNull())
    moments = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quart = quantiles(long, ["variable"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(quart, "variable")


def dispersion(df: DataFrame, strata: Mapping[str, Column], value: str, min_rows: int = 10,
               limit: float = 2.0) -> DataFrame:
    """Variance-to-mean ratio, biased skewness and verdict per stratum; strata may overlap and share one pass."""
    here = lambda cond: F.when(cond, F.col(value))
    wide = df.agg(*[F.struct(
        F.count(here(cond)).alias("n_obs"), F.avg(here(cond)).alias("mean"), F.var_samp(here(cond)).alias("variance"),
        F.skewness(here(cond)).alias("skewness")).alias(name) for name, cond in strata.items()])
    long = wide.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in strata]), F.array(*[F.col(f"`{n}`") for n in strata]))).alias("stratum", "s"))
    vmr = F.when(F.col("mean") > 0, F.col("variance") / F.col("mean"))
    return (long.select("stratum", "s.*").where(F.col("n_obs") >= min_rows).withColumn("vmr", vmr)
            .withColumn("interpretation", F.when(F.col("vmr") > limit, "overdispersed — NB appropriate")
                        .otherwise("near-equidispersion — Poisson acceptable")))


def stat_grid(df: DataFrame, keys: Sequence[str], cols: Sequence[str], stats: Sequence[str] = ("mean", "sd"),
              digits: int | None = 3) -> DataFrame:
    """Statistics by columns per group. Medians come from the exact counted form, the rest from one aggregate."""
    simple = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "n": F.count}
    shown = lambda c, s: c if digits is None or s == "n" else F.round(c, digits)
    out = df.groupBy(*keys).agg(*[shown(simple[s](c), s).alias(f"{c}_{s}") for c in cols for s in stats if s in simple])
    if "median" in stats:
        for c in cols:
            med = quantiles(df, keys, c, {f"{c}_median": 0.5})
            out = out.join(med.select(*keys, shown(F.col(f"{c}_median"), "median").alias(f"{c}_median")),
                           list(keys), "left")
    return out


def mean_all(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every numeric column per key."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric_columns(df, keys)])


def mean_sd_curve(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    return df.groupBy(*keys, index).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                        (F.avg(value) - F.stddev_samp(value)).alias("low"),
                                        (F.avg(value) + F.stddev_samp(value)).alias("high"))


def mean_ci(df: DataFrame, keys: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean with a normal 95% interval (closed form; a plot library would bootstrap it)."""
    half = F.lit(z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 (F.avg(value) - half).alias("ci_low"), (F.avg(value) + half).alias("ci_high"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value inside 1.5 IQR, and the number of outliers per group.

    Two passes: the quartiles, then one aggregate over the rows with their group's fences next to them.
    """
    quart = quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = drop_null_keys(df.select(*keys, F.col(value).cast("double").alias("__v")), [*keys, "__v"])
    joined = enrich(rows, quart, keys, how="inner")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("__v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return joined.groupBy(*keys).agg(
        *[F.max(q).alias(q) for q in ("q1", "median", "q3")], F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


# --- curves and correlation -------------------------------------------------------------------------------------

def trapezoid_auc(df: DataFrame, keys: Sequence[str], x: str, y: str | Mapping[str, str], unit_spacing: bool = False,
                  bounded: bool = False, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Area under ``y`` over ``x`` per key by the trapezoid rule. ``bounded`` groups use a plain window; others the
    block-wise one. ``sums`` adds further aggregates to the same pass."""
    ys = {"auc": y} if isinstance(y, str) else dict(y)
    prev = {"__px": lambda w: F.lag(x).over(w), **{f"__p_{c}": (lambda w, c=c: F.lag(c).over(w)) for c in ys.values()}}
    if bounded:
        window = Window.partitionBy(*keys).orderBy(x)
        stepped = df.select("*", *[fn(window).alias(n) for n, fn in prev.items()])
    else:
        stepped = windowed(df, keys, x, 1, prev)
    dx = F.lit(1.0) if unit_spacing else (F.col(x) - F.col("__px"))
    return stepped.groupBy(*keys).agg(
        *[F.coalesce(F.sum((F.col(c) + F.col(f"__p_{c}")) / 2.0 * dx), F.lit(0.0)).alias(o) for o, c in ys.items()],
        *[agg.alias(n) for n, agg in (sums or {}).items()])


def episode_metrics(df: DataFrame, keys: Sequence[str] = ("agent", "episode"), cycle: str = "cycle",
                    aucs: Sequence[str] = ("MIC_chloro", "MIC_polyB"), burden: str = "copper",
                    growth: str = "growth_inhibition", bounded: bool = False) -> DataFrame:
    """Two areas, one total and one mean per episode."""
    return trapezoid_auc(df, list(keys), cycle, {f"AUC_{c}": c for c in aucs}, bounded=bounded,
                         sums={f"{burden}_burden": F.sum(burden), f"mean_{growth}": F.avg(growth)})


def correlations(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Pairwise Pearson correlations in one pass; with a target, its correlations by falling strength."""
    pairs = ([(c, target) for c in cols if c != target] if target
             else [(a, b) for i, a in enumerate(cols) for b in cols[i:]])
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    stacked = F.array(*[F.struct(F.lit(a).alias("variable"), F.lit(b).alias("other"), F.col(f"c{i}").alias("r"))
                        for i, (a, b) in enumerate(pairs)])
    out = row.select(F.explode(stacked).alias("p")).select("p.*")
    if target:
        strength = ladder(F.abs("r"), [(0.5, "Strong"), (0.3, "Moderate")], "Weak")
        out = out.withColumn("strength", strength).orderBy(F.desc(F.abs("r")), "variable")
    return out


def slope(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 5, out: str = "slope") -> DataFrame:
    """Least-squares slope per key; null under ``min_points`` complete rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy(*keys).agg(F.when(F.count_if(both) >= min_points, F.regr_slope(y, x)).alias(out))


def signature(df: DataFrame, source: str, cycle: str, dose: str, response: str) -> DataFrame:
    """Per source: mean curve over cycles, then correlation of dose and response, both slopes and the mean dose."""
    curve = df.groupBy(source, cycle).agg(F.avg(dose).alias("dose"), F.avg(response).alias("response"))
    enough = F.count(F.lit(1)) >= 5
    return curve.groupBy(source).agg(
        F.corr("dose", "response").alias("correlation"),
        F.when(enough, F.regr_slope("dose", cycle)).alias("dose_slope"),
        F.when(enough, F.regr_slope("response", cycle)).alias("response_slope"),
        F.avg("dose").alias("mean_dose"))


def at_every_level(df: DataFrame, key: str, level: str, flagged: Column, n_levels: int) -> DataFrame:
    """Keys that are flagged at every level of a sweep."""
    return df.groupBy(key).agg((F.countDistinct(F.when(flagged, F.col(level))) == n_levels).alias("robust"))


# --- dataset profile --------------------------------------------------------------------------------------------

def class_balance(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and percent per class and the ratio of the larger to the smaller class."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("n_pos"),
        F.count_if(F.col(target) == 0).alias("n_neg"))
    return out.select("*", (F.col("n_pos") * 100.0 / F.col("n")).alias("pct_pos"),
                      F.try_divide(F.greatest("n_pos", "n_neg"), F.least("n_pos", "n_neg")).alias("imbalance_ratio"))


def profile(df: DataFrame, target: str) -> DataFrame:
    """Rows, features, missing cells, complete cases and the number of binary features, in one pass."""
    features = [c for c in df.columns if c != target]
    numeric = set(numeric_columns(df))
    complete = all_of([F.col(c).isNotNull() for c in df.columns])
    binary = [(F.count_if(~F.col(c).isin(0, 1)) == 0) & (F.min(c) != F.max(c)) for c in features if c in numeric]
    binaries = sum((flag(b) for b in binary), F.lit(0))
    n_missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), n_missing.alias("n_missing"),
                 F.count_if(complete).alias("n_complete"), binaries.cast("long").alias("n_binary"))
    return row.select(
        "n_rows", F.lit(len(features)).cast("long").alias("n_features"), "n_missing",
        (F.col("n_missing") * 100.0 / (F.col("n_rows") * len(df.columns))).alias("pct_missing"), "n_complete",
        "n_binary", F.lit(len(numeric - {target})).cast("long").alias("n_numeric"))


def feature_kinds(df: DataFrame, target: str) -> DataFrame:
    """Kind of every feature: Binary (a number that is 0 or 1 in every row, both met), Continuous or Categorical."""
    numeric = set(numeric_columns(df))
    features = [c for c in df.columns if c != target]
    both = {c: (F.count_if(F.coalesce(F.col(c).isin(0, 1), F.lit(False))) == F.count(F.lit(1))) & (F.min(c) != F.max(c))
            for c in features if c in numeric}
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.coalesce(b, F.lit(False)).alias(f"__b{features.index(c)}") for c, b in both.items()])
    kinds = [F.struct(F.lit(c).alias("feature"), (F.when(F.col(f"__b{i}"), "Binary").otherwise("Continuous") if c in both else
                                                  F.lit("Categorical")).alias("kind")) for i, c in enumerate(features)]
    return row.select(F.explode(F.array(*kinds)).alias("k")).select("k.*")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two categories with the share within each value of ``a``. The share is a window over the counted
    cells, never over rows."""
    cells = drop_null_keys(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def nearest(df: DataFrame, col: str, targets: Sequence[float], tie: Sequence[str]) -> DataFrame:
    """For each target the row whose value is nearest, the first by ``tie`` on equal distance; repeated picks once."""
    picks = df.agg(*[F.min_by(F.struct(*df.columns),
                              F.struct(F.abs(F.col(col) - t).alias("d"), *[F.col(x) for x in tie])).alias(f"t{i}")
                     for i, t in enumerate(targets)])
    return picks.select(F.explode(F.array(*[F.col(f"t{i}") for i in range(len(targets))])).alias("r")).select(
        "r.*").dropDuplicates()


def best_row(df: DataFrame, metric: str, tie: Sequence[str] = ()) -> DataFrame:
    key = F.struct((-F.col(metric)).alias("m"), *[F.col(t) for t in tie])
    return df.where(F.col(metric).isNotNull()).agg(F.min_by(F.struct(*df.columns), key).alias("r")).select("r.*")


def top_k(df: DataFrame, col: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(col), *tie).limit(k)
