"""Seasonal decomposition and baseline forecasts of regular weekly series.

A series has one row per week, so windows per series are bounded by the calendar; many series run side by side as
groups. Forecasts are regressions on yearly Fourier terms: Spark adds up the cross-products, the driver solves a
p x p system, and the projection is a column expression again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.expr import clip, direction
from episcope.operators.metrics import regression_metrics
from episcope.operators.regression import Moments, Ols, moments, ols_fit
from episcope.operators.windows import detection_gap, first_detection
from episcope.session import durable

YEAR_DAYS = 365.25
ORIGIN = "2000-01-01"


# --- decomposition ----------------------------------------------------------------------------------------------

def decompose(df: DataFrame, series: Sequence[str], order: str, value: str, period: int = 52, robust: bool = True,
              passes: int = 2) -> DataFrame:
    """Observed = trend + seasonal + residual per series with at least two periods.

    The first pass takes the trend from a centred moving average over one period (held constant at both ends) and the
    seasonal part from the mean of the detrended values by position, centred on zero. Robust passes smooth the
    deseasonalised values again with bisquare weights from the residuals.
    """
    keys = list(series)
    whole = Window.partitionBy(*keys)
    by_order = whole.orderBy(order)
    rows = df.where(F.col(value).isNotNull()).select(
        *df.columns, F.row_number().over(by_order).alias("__t"), F.count(F.lit(1)).over(whole).alias("__n"))
    rows = rows.where(F.col("__n") >= 2 * period).withColumn("__slot", (F.col("__t") - 1) % period)
    rows = rows.withColumns({"observed": F.col(value).cast("double"), "__w": F.lit(1.0)})

    half = period // 2
    span = by_order.rowsBetween(-half, half)
    wide = F.sum("observed").over(span)
    if period % 2 == 0:
        ends = (F.lag("observed", half).over(by_order) + F.lead("observed", half).over(by_order)) / 2
        middle = (wide - ends) / period
    else:
        middle = wide / period
    inside = (F.col("__t") > half) & (F.col("__t") <= F.col("__n") - half)
    rows = rows.withColumn("__m", F.when(inside, middle))
    rows = rows.withColumn("trend", F.coalesce(
        "__m", F.last("__m", True).over(by_order.rowsBetween(Window.unboundedPreceding, -1)),
        F.first("__m", True).over(by_order.rowsBetween(1, Window.unboundedFollowing))))
    rows = _seasonal(rows, keys, period)
    for _ in range(passes if robust else 0):
        # The residual scale is a median over one series: a few hundred weeks.
        scale = 6 * F.percentile(F.abs("residual"), 0.5).over(whole)
        rows = rows.withColumn("__u", F.abs("residual") / F.greatest(scale, F.lit(1e-12)))
        rows = rows.withColumn("__w", F.when(F.col("__u") < 1, (1 - F.col("__u") ** 2) ** 2).otherwise(0.0))
        flat = F.col("observed") - F.col("seasonal")
        rows = rows.withColumn("trend", F.coalesce(F.try_divide(
            F.sum(F.col("__w") * flat).over(span), F.sum("__w").over(span)), F.col("trend")))
        rows = _seasonal(rows, keys, period)
    return rows.select(*df.columns, "observed", "trend", "seasonal", "residual")


def _seasonal(rows: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    slot, whole = Window.partitionBy(*keys, "__slot"), Window.partitionBy(*keys)
    detrended = F.col("observed") - F.col("trend")
    rows = rows.withColumns({
        "__s": F.coalesce(F.try_divide(F.sum(F.col("__w") * detrended).over(slot), F.sum("__w").over(slot)), F.lit(0.0)),
        "__c": F.count(F.lit(1)).over(slot)})
    centre = F.sum(F.col("__s") / F.col("__c")).over(whole) / period
    rows = rows.withColumn("seasonal", F.col("__s") - centre)
    return rows.withColumn("residual", F.col("observed") - F.col("trend") - F.col("seasonal"))


def amplitude(parts: DataFrame, series: Sequence[str]) -> DataFrame:
    """Seasonal IQR and range, trend range, residual SD and the strengths of season and trend."""
    r, s, t = F.col("residual"), F.col("seasonal"), F.col("trend")

    def strength(other: Column) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop(r), F.var_pop(other + r)))

    return parts.groupBy(*series).agg(
        F.count(F.lit(1)).alias("n_weeks"),
        (F.percentile(s, 0.75) - F.percentile(s, 0.25)).alias("seasonal_amplitude_iqr"),
        (F.max(s) - F.min(s)).alias("seasonal_amplitude_range"),
        (F.max(t) - F.min(t)).alias("trend_range"),
        F.stddev_pop(r).alias("residual_sd"),
        strength(s).alias("strength_of_seasonality_fs"), strength(t).alias("strength_of_trend_ft"))


# --- forecast ---------------------------------------------------------------------------------------------------

def _day(date: str) -> Column:
    return F.datediff(F.col(date), F.lit(ORIGIN).cast("date")).cast("double")


def design(df: DataFrame, date: str, growth: str, order: int, hinges: Sequence[float] = ()) -> tuple[DataFrame, list[str]]:
    """Fourier columns of the year, a linear trend in years if asked for, and hinge columns at given days."""
    day = _day(date)
    cols = {}
    for k in range(1, order + 1):
        angle = day * F.lit(2 * math.pi * k / YEAR_DAYS)
        cols[f"__sin{k}"], cols[f"__cos{k}"] = F.sin(angle), F.cos(angle)
    if growth == "linear":
        cols["__trend"] = day / YEAR_DAYS
    elif growth != "flat":
        raise ValueError("growth is 'flat' or 'linear'")
    for i, at in enumerate(hinges):
        cols[f"__hinge{i}"] = F.greatest(day - F.lit(float(at)), F.lit(0.0)) / YEAR_DAYS
    return df.withColumns(cols), list(cols)


def _fit_literals(fit: Ols) -> list[Column]:
    """A fit as literal columns: coefficients, flattened covariance and residual variance."""
    return [F.lit([float(b) for b in fit.beta]).alias("beta"), F.lit([float(v) for v in fit.cov.ravel()]).alias("cov"),
            F.lit(float(fit.sigma2)).alias("sigma2")]


def _interval(df: DataFrame, names: Sequence[str], fold: str, z: float) -> DataFrame:
    """Projection with its interval for rows that carry the design columns and a fit in the struct ``fold``."""
    p = len(names) + 1
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    x, beta, cov = F.col("__x"), F.col(f"{fold}.beta"), F.col(f"{fold}.cov")
    spread = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                    lambda i: F.element_at(x, i + 1) * dot(x, F.slice(cov, i * p + 1, p))),
        F.lit(0.0), lambda s, v: s + v)
    out = df.withColumn("__x", F.array(F.lit(1.0), *[F.col(c) for c in names])).withColumn("yhat", dot(x, beta))
    half = F.lit(z) * F.sqrt(F.col(f"{fold}.sigma2") + F.greatest(spread, F.lit(0.0)))
    return out.withColumns({"yhat_lower": F.col("yhat") - half, "yhat_upper": F.col("yhat") + half}).drop("__x", *names)


def fit_baseline(train: DataFrame, date: str, y: str, growth: str = "flat", order: int = 10) -> Ols:
    coded, names = design(train, date, growth, order)
    return ols_fit(moments(coded, [y, *names], few_rows=True), y, names)


def project(grid: DataFrame, fit: Ols, date: str, growth: str = "flat", order: int = 10, z: float = 1.96) -> DataFrame:
    coded, names = design(grid, date, growth, order)
    return _interval(coded.withColumn("__fit", F.struct(*_fit_literals(fit))), names, "__fit", z).drop("__fit")


def weekly_grid(df: DataFrame, date: str, extra_weeks: int = 4) -> DataFrame:
    """Every week from the first to the last date of a series and a few beyond."""
    span = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return span.select(F.explode(F.expr(f"sequence(a, date_add(b, {7 * extra_weeks}), interval 7 days)")).alias(date))


def seasonal_forecast(df: DataFrame, date: str, y: str, train: Column, growth: str = "flat", order: int = 10,
                      extra_weeks: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Fit on the training rows, project every week of the grid, and put the observations next to it.

    The weekly series is written out once; it is small and read four times.
    """
    df = durable(df)
    fit = fit_baseline(df.where(train), date, y, growth, order)
    grid = project(weekly_grid(df, date, extra_weeks), fit, date, growth, order)
    return grid.join(df.select(date, y, *keep), date, "left").withColumn("gap", F.col(y) - F.col("yhat"))


def season_gap(merged: DataFrame, y: str, keys: Sequence[str] = ("season", "phase")) -> DataFrame:
    """Observed against projected per season, over weeks with observations; projections are floored at zero."""
    rows = merged.where(F.col(y).isNotNull()).withColumn("__f", clip("yhat", low=0.0))
    out = rows.groupBy(*keys).agg(
        F.avg(y).alias("mean_observed"), F.avg("__f").alias("mean_projected"), F.avg("gap").alias("mean_gap"),
        F.max(y).alias("peak_observed"), F.max("__f").alias("peak_projected"))
    return out.withColumn("peak_gap", F.col("peak_observed") - F.col("peak_projected"))


def gap_side_by_side(flat: DataFrame, linear: DataFrame, key: str = "season", partial: Sequence[str] = (),
                     suppressed: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Both models' gaps next to one another with notes for partial and suppressed seasons."""
    model = ("mean_projected", "mean_gap", "peak_projected", "peak_gap")
    a = flat.withColumnsRenamed({c: f"{c}_flat" for c in model})
    b = linear.select(key, *[F.col(c).alias(f"{c}_linear") for c in model])
    joined = a.join(b, key, "full_outer")
    note = (F.when(F.col(key).isin(*partial) if partial else F.lit(False), "Partial season")
            .when(F.col(key).isin(*suppressed) if suppressed else F.lit(False), "Suppressed — excluded from forecasting")
            .otherwise(""))
    return joined.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in joined.dtypes],
                         note.alias("notes"))


def holdout(df: DataFrame, date: str, y: str, train: Column, test: Column, growth: str = "flat", order: int = 10) -> DataFrame:
    """Observed, predicted and residual for held-out rows."""
    df = durable(df)
    fit = fit_baseline(df.where(train), date, y, growth, order)
    rows = project(df.where(test & F.col(y).isNotNull()).select(date, y), fit, date, growth, order)
    return rows.select(date, F.col(y).alias("observed"), F.col("yhat").alias("predicted"),
                       (F.col(y) - F.col("yhat")).alias("residual"))


def holdout_metrics(rows: DataFrame, floor: float | None = 0.05) -> DataFrame:
    return regression_metrics(rows, "observed", "predicted", floor)


def residual_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("residual").alias("mean_residual"), F.stddev_samp("residual").alias("sd_residual"),
                    F.count("residual").alias("n"))


def compare_detections(merged: dict[str, DataFrame], date: str, y: str, after: str, robust_weeks: int = 4) -> DataFrame:
    """First detection per model, and whether all of them lie within ``robust_weeks`` of one another."""
    out = None
    for name, df in merged.items():
        row = first_detection(df, date, y, "yhat_upper", after).select(F.lit(name).alias("model"), "first_detection")
        out = row if out is None else out.unionByName(row)
    span = out.agg(F.min("first_detection").alias("a"), F.max("first_detection").alias("b"),
                   F.count("first_detection").alias("n"))
    weeks = F.when(F.col("n") == len(merged), detection_gap(F.col("b"), F.col("a")))
    gap = span.select(weeks).scalar()
    verdict = F.when(F.col("weeks_apart").isNull(), "—").when(F.col("weeks_apart") <= robust_weeks, "Yes").otherwise(
        f"No — >{robust_weeks} week divergence")
    return out.withColumn("weeks_apart", gap).withColumn("robust", verdict)


def _season_moments(df: DataFrame, season: str, cols: Sequence[str]) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Raw sums and cross-products per season; the driver gets p x p sums for each season.

    A constant column in front turns counts and sums into cross-products too. Input is a weekly series, so the products
    are spread as rows (see :func:`moments`).
    """
    p = len(cols) + 1
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols])
    outer = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
    rows = df.dropna(subset=list(cols)).select(season, F.posexplode(outer).alias("at", "v")).groupBy(season, "at").agg(
        F.sum("v").alias("v")).collect()
    flat: dict[str, np.ndarray] = {}
    for r in rows:
        flat.setdefault(r[season], np.zeros(p * p))[r["at"]] = r["v"]
    out = {}
    for name, values in flat.items():
        m = values.reshape(p, p)
        out[name] = (m[0, 0], m[0, 1:], (m[1:, 1:] + m[1:, 1:].T) / 2)
    return out


def leave_one_out(df: DataFrame, date: str, y: str, season: str, train: Column, after: str, growth: str = "flat",
                  order: int = 10) -> DataFrame:
    """First detection when each training season is left out, against the full model.

    Cross-products are added up once per season; a fold is the total minus one season, so nothing is refitted from rows.
    """
    df = durable(df)
    coded, names = design(df.where(train & F.col(y).isNotNull()), date, growth, order)
    cols = [y, *names]
    parts = _season_moments(coded, season, cols)

    def solve(skip: str | None) -> Ols:
        kept = [v for k, v in parts.items() if k != skip]
        n = sum(v[0] for v in kept)
        mean = sum(v[1] for v in kept) / n
        cross = sum(v[2] for v in kept) - n * np.outer(mean, mean)
        return ols_fit(Moments(int(n), cols, mean, cross), y, names)

    later = df.where((F.col(date) > F.lit(after).cast("date")) & F.col(y).isNotNull()).select(date, y)
    folds = F.array(*[F.struct(F.lit(s or "").alias("s"), *_fit_literals(solve(s))) for s in [None, *sorted(parts)]])
    every, _ = design(later.withColumn("__fold", F.explode(folds)), date, growth, order)
    found = first_detection(_interval(every, names, "__fold", 1.96).withColumn("excluded_season", F.col("__fold.s")),
                            date, y, "yhat_upper", after, ["excluded_season"])
    full = found.where("excluded_season = ''").select("first_detection").scalar()
    out = found.where("excluded_season <> ''").select(
        "excluded_season", F.lit(len(parts) - 1).alias("n_train_seasons"), "first_detection",
        (F.datediff(F.col("first_detection"), full) / F.lit(7.0)).cast("int").alias("gap_weeks"))
    return out.withColumn(
        "direction", F.when(F.col("gap_weeks").isNull(), "—").otherwise(direction("gap_weeks", "Later", "Earlier", "Same")))


def trend_changes(train: DataFrame, date: str, y: str, n_changes: int = 15, share: float = 0.8, scale: float = 0.05,
                  order: int = 10) -> DataFrame:
    """Change of slope at evenly spread dates over the first part of the training rows, largest first.

    Hinge terms join the seasonal regression under a ridge penalty of residual variance / ``scale`` squared, with the
    series scaled to its largest absolute value and time to the training span.
    """
    rows = durable(train.where(F.col(y).isNotNull()))
    probs = [share * (i + 1) / n_changes for i in range(n_changes)]
    head = rows.agg(F.percentile(_day(date), probs), F.max(F.abs(y)), F.max(_day(date)) - F.min(_day(date))).first()
    days, top, span = [math.floor(v) for v in head[0]], float(head[1]), float(head[2]) / YEAR_DAYS
    coded, names = design(rows, date, "linear", order, days)
    m = moments(coded.withColumn("__y", F.col(y) / F.lit(top)), ["__y", *names], few_rows=True)
    for i, c in enumerate(m.names):
        if c == "__trend" or c.startswith("__hinge"):
            m.cross[i, :] /= span
            m.cross[:, i] /= span
            m.mean[i] /= span
    hinge = [c for c in names if c.startswith("__hinge")]
    plain = ols_fit(m, "__y", [c for c in names if c not in hinge])
    fit = ols_fit(m, "__y", names, ridge=plain.sigma2 / scale ** 2, ridge_on=hinge)
    deltas = [float(fit.beta[fit.names.index(c)]) for c in hinge]
    table = train.sparkSession.createDataFrame(list(zip(days, deltas)), "day int, delta double")
    return table.select(F.date_add(F.lit(ORIGIN).cast("date"), F.col("day")).alias("change_date"), "delta",
                        F.abs("delta").alias("abs_delta")).orderBy(F.desc("abs_delta"))
