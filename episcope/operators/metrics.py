"""Classifier and regression metrics, computed from counts so that any number of scored rows is one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import decimals, mean_sd_cell
from episcope.operators.hypothesis import rank_table
from episcope.operators.tabulate import nearest

INF = float("inf")


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_metrics() -> dict[str, Column]:
    """Metrics as expressions over the columns tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    sens, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    ppv, npv = _ratio(tp, tp + fp), _ratio(tn, tn + fn)

    def f_beta(beta: float) -> Column:
        return _ratio((1 + beta ** 2) * tp, (1 + beta ** 2) * tp + beta ** 2 * fn + fp)

    lr_pos = F.when(spec < 1, sens / F.greatest(1 - spec, F.lit(1e-300))).otherwise(F.lit(INF))
    lr_neg = F.when(spec > 0, (1 - sens) / F.greatest(spec, F.lit(1e-300))).otherwise(F.lit(INF))
    dor = F.when((lr_pos != INF) & (lr_neg != 0), lr_pos / F.greatest(lr_neg, F.lit(1e-300))).otherwise(F.lit(INF))
    mcc = _ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))
    chance = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)
    accuracy = (tp + tn) / n
    return {
        "accuracy": accuracy, "balanced_accuracy": (sens + spec) / 2, "precision": ppv, "recall": sens,
        "f1_score": f_beta(1.0), "f2_score": f_beta(2.0), "f05_score": f_beta(0.5), "sensitivity": sens,
        "specificity": spec, "ppv": ppv, "npv": npv, "lr_positive": lr_pos, "lr_negative": lr_neg,
        "diagnostic_odds_ratio": dor, "youdens_j": sens + spec - 1, "markedness": ppv + npv - 1,
        "matthews_corrcoef": mcc, "cohens_kappa": F.try_divide(accuracy - chance, 1 - chance),
        "prevalence": (tp + fn) / n, "false_positive_rate": _ratio(fp, fp + tn),
        "false_negative_rate": _ratio(fn, fn + tp), "false_discovery_rate": _ratio(fp, fp + tp),
        "false_omission_rate": _ratio(fn, fn + tn), "geometric_mean": F.sqrt(sens * spec),
    }


def confusion_counts(df: DataFrame, label: str, pred: str, keys: Sequence[str] = (), extra=()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(y & ~p).alias("fn"), *extra)


def score_losses(label: str, score: str) -> list[Column]:
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    eps = 2.220446049250313e-16  # double precision step, so that a certain score has a finite loss
    safe = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return [F.avg((y - p) * (y - p)).alias("brier_score"),
            F.avg(-(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss")]


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """ROC area (ties count half) and average precision (step-wise, not the trapezoid area) from counted scores. ``count``:
    how many rows each row stands for."""
    ranks = rank_table(df, keys, score, F.col(label) == 1, descending=True, count=count)
    above_neg = F.col("cum_second") - F.col("n_second")
    pos = F.col("n_first").cast("double")
    beaten_by_neg = pos * (above_neg + F.col("n_second") / 2.0)
    precision = F.col("cum_first") / (F.col("cum_first") + F.col("cum_second"))
    sums = ranks.groupBy(*keys).agg(
        F.sum("n_first").alias("pos"), F.sum("n_second").alias("neg"), F.sum(beaten_by_neg).alias("lost"),
        F.sum(pos * precision).alias("ap"))
    return sums.select(
        *keys, (1 - F.try_divide(F.col("lost"), F.col("pos").cast("double") * F.col("neg"))).alias("roc_auc"),
        F.try_divide(F.col("ap"), F.col("pos").cast("double")).alias("pr_auc"))


def binary_metrics(df: DataFrame, label: str, pred: str, score: str | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and all derived metrics; with a score also areas, Brier score and log loss."""
    extra = score_losses(label, score) if score else []
    counted = confusion_counts(df, label, pred, keys, extra)
    out = counted.select("*", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("total"),
                         *[c.alias(n) for n, c in confusion_metrics().items()])
    if score is None:
        return out
    areas = auc(df, label, score, keys)
    if keys:
        return out.join(areas, list(keys))
    row = areas.select(F.struct("roc_auc", "pr_auc").alias("a")).scalar()
    return out.withColumn("__a", row).select("*", "__a.*").drop("__a")


def roc_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, from high to low."""
    ranks = rank_table(df, keys, score, F.col(label) == 1, descending=True)
    return _curve(ranks, keys, lambda pos, neg: {
        "tpr": _ratio(F.col("cum_first"), pos), "fpr": _ratio(F.col("cum_second"), neg)})


def pr_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    ranks = rank_table(df, keys, score, F.col(label) == 1, descending=True)
    return _curve(ranks, keys, lambda pos, neg: {
        "precision": _ratio(F.col("cum_first"), F.col("cum_first") + F.col("cum_second")),
        "recall": _ratio(F.col("cum_first"), pos)})


def with_start(points: DataFrame, keys: Sequence[str] = (), **start: float) -> DataFrame:
    """Curve points with the point before the highest score, one per key; its threshold is null. ROC curves start at
    ``tpr=0, fpr=0``, precision-recall curves at ``precision=1, recall=0``."""
    head = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, F.lit(None).cast(dict(points.dtypes)["threshold"]).alias("threshold"), *[F.lit(float(v)).alias(c) for c, v in start.items()])
    return points.unionByName(head)


def _curve(ranks: DataFrame, keys: Sequence[str], columns) -> DataFrame:
    totals = ranks.groupBy(*keys).agg(F.sum("n_first").alias("__pos"), F.sum("n_second").alias("__neg"))
    if keys:
        joined = ranks.join(totals, list(keys))
    else:
        joined = ranks.withColumns({"__pos": totals.select("__pos").scalar(), "__neg": totals.select("__neg").scalar()})
    return joined.select(*keys, F.col("value").alias("threshold"), *[
        c.alias(n) for n, c in columns(F.col("__pos"), F.col("__neg")).items()])


def calibration(df: DataFrame, label: str, score: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Uniform right-closed bins with observed share and mean prediction; empty bins are absent."""
    p = F.col(score)
    edges = [F.when(p > i / bins, 1).otherwise(0) for i in range(1, bins)]
    bucket = sum(edges[1:], edges[0])
    return df.where(p.isNotNull()).groupBy(*keys, bucket.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label)).alias("observed"), F.avg(p).alias("predicted"))


def calibration_error(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute gap over non-empty bins, each bin counted once."""
    return bins.groupBy(*keys).agg(F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("calibration_error"))


def grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [round(low + i * step, 12) for i in range(n)]


def threshold_counts(df: DataFrame, label: str, score: str, thresholds: Sequence[float],
                     keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at every threshold (score >= threshold is positive).

    Rows whose score is null or NaN are left out. Rows are counted once per interval between thresholds; the counts above each threshold are then summed over that
    histogram, so the cost does not grow with the number of thresholds.
    """
    cuts = sorted(set(float(t) for t in thresholds))
    rows = df.withColumn("__s", F.col(score).cast("double")).where(F.col("__s").isNotNull() & ~F.isnan("__s"))
    binned = Bucketizer(splits=[-INF, *cuts, INF], inputCol="__s", outputCol="__b").transform(rows)
    hist = binned.groupBy(*keys, F.col("__b").cast("int").alias("passed")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    values = F.array(*[F.lit(c) for c in cuts])
    reached = hist.select(*keys, F.explode(F.slice(values, F.lit(1), F.col("passed"))).alias("threshold"), "pos", "neg")
    totals = hist.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    every = totals.select(*keys, F.explode(values).alias("threshold"), "all_pos", "all_neg")
    above = reached.groupBy(*keys, "threshold").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    joined = every.join(above, [*keys, "threshold"], "left")
    tp, fp = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0))
    return joined.select(*keys, "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("all_neg") - fp).alias("tn"),
                         (F.col("all_pos") - tp).alias("fn"))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float] | None = None, per: int = 1000,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Metrics and workload (alerts, false and true positives per ``per`` cases) at each threshold."""
    counts = threshold_counts(df, label, score, thresholds or grid(0.05, 0.80, 76), keys)
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    m = confusion_metrics()
    wanted = ("prevalence", "precision", "recall", "specificity", "f1_score", "f2_score", "youdens_j")
    share = lambda c: _ratio(c, n) * per
    return counts.select("*", *[m[k].alias(k) for k in wanted],
                         share(F.col("tp") + F.col("fp")).alias(f"alerts_per_{per}"),
                         share(F.col("fp")).alias(f"false_positives_per_{per}"),
                         share(F.col("tp")).alias(f"true_positives_per_{per}"))


def tune_threshold(df: DataFrame, label: str, score: str, min_recall: float = 0.70, points: int = 500,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Threshold with the best F1 among those that keep the recall, the lowest on ties; without any, the one with the
    best recall."""
    sweep = threshold_sweep(df, label, score, grid(0.01, 0.99, points), keys=keys)
    kept = F.col("recall") >= min_recall
    order = F.struct((~kept).alias("a"), F.when(kept, -F.col("f1_score")).otherwise(-F.col("recall")).alias("b"),
                     F.col("threshold").alias("c"))
    return sweep.groupBy(*keys).agg(
        F.min_by(F.struct("threshold", "precision", "recall", "f1_score"), order).alias("r")).select(*keys, "r.*")


def operating_points(sweep: DataFrame, targets: Sequence[float] = (0.95, 0.85, 0.75, 0.65, 0.55, 0.40, 0.25)) -> DataFrame:
    """The sweep rows whose recall is nearest to each target, the lowest threshold on ties."""
    return nearest(sweep, "recall", targets, ["threshold"])


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    cells = df.groupBy(F.col(label).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).alias("called"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("called"),
                     F.lit(0).alias("hit")))
    sums = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"),
                                      F.sum("hit").alias("hit"))
    precision, recall = _ratio(F.col("hit"), F.col("called")), _ratio(F.col("hit"), F.col("support"))
    f1 = _ratio(2 * F.col("hit"), F.col("called") + F.col("support"))
    per_class = sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"),
                            F.col("support").cast("long").alias("support"), F.col("hit"))
    names = ("precision", "recall", "f1_score")
    total = F.sum("support")
    macro = per_class.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names],
                          total.alias("support"))
    weighted = per_class.agg(F.lit("weighted avg").alias("class"),
                             *[(F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in names],
                             total.alias("support"))
    accuracy = per_class.agg(F.lit("accuracy").alias("class"),
                             *[(F.sum("hit") / total).alias(c) for c in names], total.alias("support"))
    return per_class.drop("hit").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def regression_metrics(df: DataFrame, y: str, yhat: str, floor: float | None = 0.05,
                       keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R squared and n; MAPE over actual values above ``floor`` (None leaves it out)."""
    err = F.col(y) - F.col(yhat)
    both = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    aggs = [F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
            (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count(y))).alias("r2")]
    if floor is not None:
        aggs.append(F.avg(F.when(F.col(y) > floor, F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(1e-300))) * 100)
                    .alias("mape"))
    return both.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n"))


def cv_summary(folds: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population SD, range and coefficient of variation per metric over folds."""
    long = folds.unpivot(list(keys), list(metrics), "metric", "value")
    mean, sd = F.avg("value"), F.stddev_pop("value")
    return long.groupBy(*keys, "metric").agg(mean.alias("mean"), sd.alias("sd"), F.min("value").alias("min"),
                                             F.max("value").alias("max"), F.try_divide(sd, mean).alias("cv"))


def comparison_table(summary: DataFrame, model: str, metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """Models by metrics with ``mean (SD)`` cells, from a :func:`cv_summary` keyed by model."""
    cell = mean_sd_cell(F.col("mean"), F.col("sd"), digits)
    return summary.groupBy(model).agg(*[
        F.max(F.when(F.col("metric") == m, cell)).alias(m) for m in metrics]).orderBy(model)


def metric_cells(table: DataFrame, keys: Sequence[str], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    return table.select(*keys, *[decimals(F.col(m), digits).alias(m) for m in metrics])


