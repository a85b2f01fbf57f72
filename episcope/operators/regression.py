"""Linear and logistic coefficient tables.

Spark reduces the rows to cross-products (one row of p x p sums) or runs the GLM; only those small matrices reach the
driver, where a table with one row per term is made.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions import dist
from episcope.operators.clean import one_hot

COEF_SCHEMA = ("term string, estimate double, se double, ci_low double, ci_high double, stat double, "
               "p_value double")


@dataclass
class Moments:
    """Row count, column means and centred cross-products of a few columns."""

    n: int
    names: list[str]
    mean: np.ndarray
    cross: np.ndarray

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]


def moments(df: DataFrame, cols: Sequence[str], few_rows: bool = False) -> Moments:
    """Complete-case moments: a pass for the means, a pass for the centred products. The driver gets p (p + 1) / 2 sums.

    Products are separate sums in one generated aggregate. ``few_rows`` (a weekly series under a wide design) spreads
    them as rows instead, which avoids compiling hundreds of sums for a small table.
    """
    cols = list(cols)
    rows = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    head = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols]).first()
    if not head[0]:
        raise ValueError("no complete rows to fit")
    centred = rows.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(cols, head[1:])])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    if few_rows:
        x = F.array(*cols)
        outer = F.flatten(F.transform(x, lambda a: F.transform(x, lambda b: a * b)))
        sums = centred.select(F.posexplode(outer).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(len(cols) ** 2)
        for r in sums:
            flat[r["at"]] = r["v"]
        cross = flat.reshape(len(cols), len(cols))
        cross = (cross + cross.T) / 2
    else:
        row = centred.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).first()
        cross = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, row):
            cross[i, j] = cross[j, i] = v
    return Moments(head[0], cols, np.array([float(v) for v in head[1:]]), cross)


@dataclass
class Ols:
    """Least-squares fit from moments; the intercept comes first."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    dof: int
    n: int
    r2: float

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))

    def rows(self) -> list[tuple]:
        q = dist.t_quantile(0.975, self.dof)
        out = []
        for name, b, s in zip(self.names, self.beta, self.se):
            b, s = float(b), float(s)
            t = b / s if s > 0 else float("nan")
            p = dist.t_two_sided(t, self.dof) if s > 0 else float("nan")
            out.append((name, b, s, b - q * s, b + q * s, t, p))
        return out


def ols_fit(m: Moments, y: str, xs: Sequence[str], ridge: float = 0.0, ridge_on: Sequence[str] = ()) -> Ols:
    """Solve the centred normal equations; an optional ridge penalty acts on the named columns."""
    xi, yi = m.index(xs), m.names.index(y)
    sxx, sxy = m.cross[np.ix_(xi, xi)], m.cross[xi, yi]
    penalty = np.diag([ridge if c in ridge_on else 0.0 for c in xs])
    inv = np.linalg.pinv(sxx + penalty, hermitian=True)
    slope = inv @ sxy
    rank = int(np.linalg.matrix_rank(sxx, hermitian=True)) if len(xs) else 0
    rss = float(m.cross[yi, yi] - 2 * slope @ sxy + slope @ sxx @ slope)
    dof = max(m.n - rank - 1, 1)
    sigma2 = max(rss, 0.0) / dof
    means = m.mean[xi]
    cov = np.zeros((len(xs) + 1, len(xs) + 1))
    cov[1:, 1:] = sigma2 * inv
    cov[0, 1:] = cov[1:, 0] = -sigma2 * inv @ means
    cov[0, 0] = sigma2 * (1.0 / m.n + means @ inv @ means)
    beta = np.concatenate([[m.mean[yi] - slope @ means], slope])
    tss = float(m.cross[yi, yi])
    return Ols(["intercept", *xs], beta, cov, sigma2, dof, m.n, 1 - rss / tss if tss > 0 else float("nan"))


def ols_table(df: DataFrame, y: str, xs: Sequence[str], model: str = "primary") -> DataFrame:
    """Coefficient table with t intervals, R squared and n."""
    fit = ols_fit(moments(df, [y, *xs]), y, xs)
    adj = 1 - (1 - fit.r2) * (fit.n - 1) / fit.dof
    rows = [(model, *r, fit.r2, adj, fit.n) for r in fit.rows()]
    return df.sparkSession.createDataFrame(
        rows, f"model string, {COEF_SCHEMA}, r_squared double, adj_r2 double, n long")


def check_outcome(df: DataFrame, y: str) -> None:
    """A logistic fit needs rows and both outcomes."""
    row = df.agg(F.count(y), F.min(y), F.max(y)).first()
    if not row[0]:
        raise ValueError("no rows remain for the model")
    if row[1] == row[2]:
        raise ValueError(f"{y} has a single class")


def most_frequent(df: DataFrame, col: str) -> str:
    """Mode of a category, the smallest value on ties."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col)))).first()[0]


def treatment_code(df: DataFrame, col: str, levels: Sequence[str], reference: str | None = None) -> tuple[DataFrame, list[str]]:
    """Indicator columns for every level but the reference (given, or the most frequent)."""
    reference = reference or most_frequent(df, col)
    kept = [lv for lv in levels if lv != reference]
    return one_hot(df, col, kept, col), [f"{col}_{lv}" for lv in kept]


def _glm(df: DataFrame, y: str, xs: Sequence[str], collapse: bool):
    rows = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in xs]).dropna()
    check_outcome(rows, "__y")
    weight, settled = {}, 0.0
    if collapse:
        # Equal design rows become one row with their share of ones and their number: indicator designs get tiny.
        rows = rows.groupBy(*xs).agg(F.avg("__y").alias("__y"), F.count(F.lit(1)).cast("double").alias("__w"))
        weight = {"weightCol": "__w"}
        p = F.col("__y")
        entropy = F.when((p > 0) & (p < 1), p * F.log(p) + (1 - p) * F.log(1 - p)).otherwise(0.0)
        settled, n = rows.agg(F.sum(F.col("__w") * entropy), F.sum("__w")).first()
    design = VectorAssembler(inputCols=list(xs), outputCol="features").transform(rows).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="__y", featuresCol="features",
                                            maxIter=50, tol=1e-10, **weight).fit(design)
        s = model.summary
        # Deviances of grouped rows are relative to the shares; add that constant to get back to single outcomes.
        return {"beta": [model.intercept, *model.coefficients.toArray()],
                "se": [s.coefficientStandardErrors[-1], *s.coefficientStandardErrors[:-1]],
                "deviance": s.deviance - 2 * settled, "null": s.nullDeviance - 2 * settled,
                "n": int(n) if collapse else s.numInstances}
    finally:
        design.unpersist()


def logit_table(df: DataFrame, y: str, xs: Sequence[str], collapse: bool = False) -> DataFrame:
    """Logistic coefficients with normal intervals; ``collapse`` counts equal design rows first."""
    fit = _glm(df, y, xs, collapse)
    return df.sparkSession.createDataFrame(_logit_rows(fit, xs), COEF_SCHEMA)


def _logit_rows(fit: Mapping, xs: Sequence[str]) -> list[tuple]:
    q = dist.normal_quantile(0.975)
    pairs = [(float(b), float(s)) for b, s in zip(fit["beta"], fit["se"])]
    return [(name, b, s, b - q * s, b + q * s, b / s, dist.normal_two_sided(b / s))
            for name, (b, s) in zip(["intercept", *xs], pairs)]


def logit_fit(df: DataFrame, y: str, xs: Sequence[str], collapse: bool = False) -> DataFrame:
    """One row of fit statistics: log-likelihoods, AIC, BIC, McFadden R squared and the likelihood-ratio test."""
    fit = _glm(df, y, xs, collapse)
    ll, ll0, k = -fit["deviance"] / 2, -fit["null"] / 2, len(xs) + 1
    row = (fit["n"], ll, ll0, 2 * k - 2 * ll, k * math.log(fit["n"]) - 2 * ll, 1 - ll / ll0,
           dist.chi2_sf(2 * (ll - ll0), k - 1))
    return df.sparkSession.createDataFrame(
        [row], "n long, log_likelihood double, ll_null double, aic double, bic double, pseudo_r2 double, llr_p double")


def odds_ratios(df: DataFrame, target: Column, xs: Sequence[str], digits: int | None = 3, collapse: bool = False) -> DataFrame:
    """exp(coefficient) with 95% limits, intercept left out; ``target`` is the one-against-rest condition."""
    rows = _logit_rows(_glm(df.withColumn("__target", target.cast("int")), "__target", xs, collapse), xs)[1:]

    def shown(v: float) -> float:
        v = math.exp(min(v, 700.0))
        return v if digits is None else round(v, digits)

    out = [(name, shown(b), shown(b - 1.96 * s), shown(b + 1.96 * s)) for name, b, s, *_ in rows]
    return df.sparkSession.createDataFrame(out, "term string, odds_ratio double, ci_low double, ci_high double")
