"""Mixed models from group-level sums."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions import dist
from episcope.session import durable

TERM_SCHEMA = ("term string, estimate double, se double, ci_low double, ci_high double, z double, p_value double")


@dataclass
class MixedFit:
    """Fixed effects with their covariance, and the variance components."""

    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    group_var: dict[str, float]
    residual_var: float | None
    n: int
    n_groups: dict[str, int]

    def rows(self) -> list[tuple]:
        return [_term_row(n, float(b), math.sqrt(max(v, 0.0)))
                for n, b, v in zip(self.names, self.beta, np.diag(self.cov))]


def _term_row(name: str, b: float, s: float, z_crit: float = 1.96) -> tuple:
    z = b / s if s > 0 else float("nan")
    return name, b, s, b - z_crit * s, b + z_crit * s, z, dist.normal_two_sided(z) if s > 0 else float("nan")


def _symmetric(values, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip([(i, j) for i in range(p) for j in range(i, p)], values):
        out[i, j] = out[j, i] = v or 0.0
    return out


def lmm_fit(df: DataFrame, y: str, xs: Sequence[str], group: str, grid: int = 25, rounds: int = 6) -> MixedFit:
    """Random-intercept model by REML.

    For a variance ratio r the marginal cross-products are the total ones minus sum over groups of
    r / (1 + n r) times the outer products of the group sums. So one table of group sums serves every r: each round
    spreads a grid of ratios over that table, adds up per ratio in Spark, and zooms in. The driver sees grid x p x p sums.
    """
    rows = df.dropna(subset=[y, *xs, group]).select(
        group, F.lit(1.0).alias("c0"), *[F.col(c).cast("double").alias(f"c{i + 1}") for i, c in enumerate(xs)],
        F.col(y).cast("double").alias(f"c{len(xs) + 1}"))
    cols = [f"c{i}" for i in range(len(xs) + 2)]
    p, k = len(xs) + 1, len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # One pass: sums and cross-products per group, written out because every round reads them.
    groups = durable(rows.groupBy(group).agg(*[F.sum(c).alias(c) for c in cols],
                                             *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs]))
    head = groups.agg(F.count(F.lit(1)), *[F.sum(f"p{i}_{j}") for i, j in pairs]).first()
    n_groups, total = head[0], _symmetric(head[1:], k)
    n = int(total[0, 0])

    def profile(ratios: Sequence[float]) -> list[tuple]:
        r, size = F.col("r"), F.col("c0")
        shrink = r / (1 + size * r)
        table = groups.withColumn("r", F.explode(F.array(*[F.lit(float(x)) for x in ratios]))).groupBy("r").agg(
            F.sum(F.log1p(size * r)).alias("logdet"),
            *[F.sum(shrink * F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i, j in pairs]).collect()
        out = []
        for row in table:
            a = total - _symmetric([row[f"q{i}_{j}"] for i, j in pairs], k)
            xx, xy, yy = a[:p, :p], a[:p, p], a[p, p]
            beta = np.linalg.solve(xx, xy)
            rss = float(yy - beta @ xy)
            s2 = rss / (n - p)
            reml = -0.5 * ((n - p) * math.log(s2) + row["logdet"] + np.linalg.slogdet(xx)[1])
            out.append((reml, row["r"], beta, s2 * np.linalg.inv(xx), s2))
        return sorted(out, key=lambda t: t[1])

    ratios = [0.0, *np.geomspace(1e-6, 1e4, grid - 1)]
    best = None
    for _ in range(rounds):
        scored = profile(ratios)
        at = max(range(len(scored)), key=lambda i: scored[i][0])
        best = scored[at]
        low, high = scored[max(at - 1, 0)][1], scored[min(at + 1, len(scored) - 1)][1]
        ratios = [float(x) for x in np.linspace(low, high, grid)]
    _, r, beta, cov, s2 = best
    return MixedFit(["intercept", *xs], beta, cov, {group: r * s2}, s2, n, {group: n_groups})


def lmm(df: DataFrame, y: str, xs: Sequence[str], group: str) -> DataFrame:
    """Fixed effects with Wald limits, and on every row the variance components, ICC and sizes."""
    fit = lmm_fit(df, y, xs, group)
    gv = fit.group_var[group]
    tail = (gv, fit.residual_var, gv / (gv + fit.residual_var), fit.n, fit.n_groups[group])
    return df.sparkSession.createDataFrame(
        [(*r, *tail) for r in fit.rows()],
        TERM_SCHEMA + ", group_var double, residual_var double, icc double, n long, n_groups long")


def interaction_columns(df: DataFrame, slope: str, group: str, levels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Design of ``slope * group``: the slope, an indicator per level after the first, and their products."""
    out = df
    names = [slope]
    for lv in levels[1:]:
        out = out.withColumn(f"{group}_{lv}", F.when(F.col(group) == lv, 1.0).otherwise(0.0))
        names.append(f"{group}_{lv}")
    for lv in levels[1:]:
        out = out.withColumn(f"{slope}:{group}_{lv}", F.col(slope) * F.col(f"{group}_{lv}"))
        names.append(f"{slope}:{group}_{lv}")
    return out, names


def wald_anova(spark, fit: MixedFit, terms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Joint Wald chi-square test per term, each term being a set of columns."""
    rows = []
    for term, cols in terms.items():
        at = [fit.names.index(c) for c in cols]
        b, v = fit.beta[at], fit.cov[np.ix_(at, at)]
        stat = float(b @ np.linalg.solve(v, b))
        rows.append((term, stat, len(cols), dist.chi2_sf(stat, len(cols))))
    return spark.createDataFrame(rows, "term string, chi2 double, dof long, p_value double")


def contrasts(spark, fit: MixedFit, group: str, levels: Sequence[str], slope: str | None = None, at: float = 0.0) -> DataFrame:
    """All pairwise differences of group means (at a value of the slope), Bonferroni-adjusted, with limits."""
    def vector(lv: str) -> np.ndarray:
        v = np.zeros(len(fit.names))
        if lv != levels[0]:
            v[fit.names.index(f"{group}_{lv}")] = 1.0
            if slope:
                v[fit.names.index(f"{slope}:{group}_{lv}")] = at
        return v

    pairs = [(a, b) for i, a in enumerate(levels) for b in levels[i + 1:]]
    z_crit = dist.normal_quantile(1 - 0.025 / len(pairs))
    rows = []
    for a, b in pairs:
        c = vector(a) - vector(b)
        row = _term_row(f"{a} - {b}", float(c @ fit.beta), math.sqrt(max(float(c @ fit.cov @ c), 0.0)), z_crit)
        rows.append((*row[:-1], min(1.0, row[-1] * len(pairs))))
    return spark.createDataFrame(rows, TERM_SCHEMA)


@dataclass
class Design:
    """Fixed effects of a model formula: terms name covariates and factors, factor levels come with the base level first.

    ``Design(["x"], {"arm": ["a", "b"]}, [("x",), ("arm",), ("x", "arm")])`` is x * arm. Every margin of a term must be a
    term itself. Factors are treatment coded; columns are named ``arm_b`` and ``x:arm_b``.
    """

    covariates: Sequence[str]
    factors: Mapping[str, Sequence]
    terms: Sequence[tuple[str, ...]]

    def __post_init__(self):
        known = {frozenset(t) for t in self.terms}
        for t in self.terms:
            if unknown := set(t) - set(self.covariates) - set(self.factors):
                raise ValueError(f"neither covariate nor factor: {sorted(unknown)}")
            if missing := [m for m in t if len(t) > 1 and frozenset(t) - {m} not in known]:
                raise ValueError(f"term {':'.join(t)} needs its margins without {missing}")

    def covariate_part(self, term: Sequence[str]) -> tuple[str, ...]:
        return tuple(c for c in self.covariates if c in term)

    def column(self, covariates: Sequence[str], level: Mapping) -> str:
        return ":".join([*covariates, *[f"{f}_{level[f]}" for f in self.factors if f in level]]) or "intercept"

    def columns(self) -> dict[str, tuple[tuple[str, ...], dict]]:
        """Column names with their covariates and their level per factor."""
        out = {}
        for term in self.terms:
            own = [f for f in self.factors if f in term]
            for combo in itertools.product(*[self.factors[f][1:] for f in own]):
                level = dict(zip(own, combo))
                out[self.column(self.covariate_part(term), level)] = (self.covariate_part(term), level)
        return out

    def coded(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        """The frame with the design's columns, and their names. Rows with a null covariate or factor get null."""
        columns = self.columns()
        made = {}
        for name, (covariates, level) in columns.items():
            value = F.lit(1.0)
            for c in covariates:
                value = value * F.col(c).cast("double")
            for f, lv in level.items():
                value = value * F.when(F.col(f) == F.lit(lv), 1.0).when(F.col(f).isNotNull(), 0.0)
            made[name] = value
        return df.withColumns(made), list(columns)

    def row(self, names: Sequence[str], covariates: Sequence[str], weights: Mapping[str, Sequence[float]]) -> np.ndarray:
        """The linear function of the coefficients of one covariate set that gives factor ``f``'s levels (base first, then the
        treatment columns) the weights ``weights[f]``."""
        out = np.zeros(len(names))
        for combo in itertools.product(*[range(len(self.factors[f])) for f in weights]):
            level = {f: self.factors[f][i] for f, i in zip(weights, combo) if i}
            name = self.column(covariates, level)
            if name in names:
                out[names.index(name)] = math.prod(weights[f][i] for f, i in zip(weights, combo))
        return out

    def type3_matrix(self, names: Sequence[str], term: Sequence[str]) -> np.ndarray:
        """The estimable functions of a term: its factors by their deviations from the average level, all other factors
        averaged over their levels with equal weight. Covariates are held at 0 unless the term holds them."""
        options = []
        for f, levels in self.factors.items():
            k = len(levels)
            # The mean of a level i is base + its column; the average over levels puts 1/k on each column.
            average = [1.0, *[1.0 / k] * (k - 1)]
            deviations = [[0.0, *[float(i == j) - 1.0 / k for j in range(1, k)]] for i in range(1, k)]
            options.append(deviations if f in term else [average])
        return np.array([self.row(names, self.covariate_part(term), dict(zip(self.factors, picked)))
                         for picked in itertools.product(*options)])

    def mean_vector(self, names: Sequence[str], at: Mapping[str, float], fixed: Mapping) -> np.ndarray:
        """The function that gives the mean at covariate values ``at`` and factor levels ``fixed``, averaged over the levels of
        all other factors."""
        weights = {}
        for f, levels in self.factors.items():
            k = len(levels)
            weights[f] = [1.0, *[float(lv == fixed[f]) if f in fixed else 1.0 / k for lv in levels[1:]]]
        sets = {()} | {self.covariate_part(t) for t in self.terms}
        return sum(math.prod(at[c] for c in cov) * self.row(names, cov, weights) for cov in sets)


def type3_tests(spark, fit: MixedFit, design: Design) -> DataFrame:
    """Joint Wald tests of the estimable functions of every term, which do not depend on the base levels chosen; ``f_value``
    is the chi-square over its degrees of freedom."""
    rows = []
    for term in design.terms:
        m = design.type3_matrix(fit.names, term)
        b, v = m @ fit.beta, m @ fit.cov @ m.T
        stat = float(b @ np.linalg.solve(v, b))
        rows.append((":".join(term), stat, len(m), stat / len(m), dist.chi2_sf(stat, len(m))))
    return spark.createDataFrame(rows, "term string, chi2 double, dof long, f_value double, p_value double")


def covariate_means(df: DataFrame, design: Design, y: str) -> dict[str, float]:
    """Means of the covariates over the rows of the fit, in one aggregate."""
    if not design.covariates:
        return {}
    used = df.dropna(subset=[y, *design.covariates, *design.factors])
    row = used.agg(*[F.avg(F.col(c).cast("double")) for c in design.covariates]).first()
    return dict(zip(design.covariates, row))


def marginal_means(spark, fit: MixedFit, design: Design, factor: str, at: Mapping[str, float]) -> DataFrame:
    """Estimated means per level of a factor with 95% limits, at covariate values ``at`` (their means, as a rule)."""
    rows = []
    for lv in design.factors[factor]:
        v = design.mean_vector(fit.names, at, {factor: lv})
        rows.append(_term_row(str(lv), float(v @ fit.beta), math.sqrt(max(float(v @ fit.cov @ v), 0.0))))
    return spark.createDataFrame(rows, TERM_SCHEMA)


def marginal_contrasts(spark, fit: MixedFit, design: Design, factor: str, at: Mapping[str, float]) -> DataFrame:
    """All pairwise differences of the estimated means, p-values and limits Bonferroni-adjusted."""
    vectors = {lv: design.mean_vector(fit.names, at, {factor: lv}) for lv in design.factors[factor]}
    pairs = list(itertools.combinations(vectors, 2))
    z_crit = dist.normal_quantile(1 - 0.025 / len(pairs))
    rows = []
    for a, b in pairs:
        c = vectors[a] - vectors[b]
        row = _term_row(f"{a} - {b}", float(c @ fit.beta), math.sqrt(max(float(c @ fit.cov @ c), 0.0)), z_crit)
        rows.append((*row[:-1], min(1.0, row[-1] * len(pairs))))
    return spark.createDataFrame(rows, TERM_SCHEMA)


def glmm_binomial_fit(df: DataFrame, y: str, xs: Sequence[str], groups: Sequence[str], max_iter: int = 25,
                      tol: float = 1e-6, max_levels: int = 4000, max_cells: int = 200_000) -> MixedFit:
    """Logistic model with random intercepts for one or more crossed groupings, by penalised quasi-likelihood.

    Every iteration is one Spark aggregate: weighted cross-products per combination of group levels. The combinations
    are categories (site, period, ...), checked to be at most ``max_cells``; the mixed-model equations over at most
    ``max_levels`` levels are solved on the driver. The estimates are close to, not equal to, a Laplace fit.
    """
    p = len(xs) + 1
    xcols = [f"x{i}" for i in range(p)]
    rows = df.dropna(subset=[y, *xs, *groups]).select(
        *groups, F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(xs)],
        F.col(y).cast("double").alias("y"))
    # Equal rows count once with their frequency, so later passes read a smaller table.
    rows = rows.groupBy(*groups, *xcols, "y").agg(F.count(F.lit(1)).cast("double").alias("f"))
    rows = durable(rows)
    cells = rows.select(*groups).distinct().limit(max_cells + 1).collect()
    if len(cells) > max_cells:
        raise ValueError("too many combinations of group levels; group over categories, not over row identifiers")
    levels = {g: {v: i for i, v in enumerate(sorted({c[g] for c in cells}, key=str))} for g in groups}
    offsets, q = {}, 0
    for g in groups:
        offsets[g], q = q, q + len(levels[g])
    if q > max_levels:
        raise ValueError(f"{q} random levels exceed max_levels={max_levels}")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*groups).schema) + ", off double"
    beta, u = np.zeros(p), np.zeros(q)
    variances = {g: 1.0 for g in groups}
    n = int(rows.agg(F.sum("f")).first()[0])
    inv = None
    for _ in range(max_iter):
        shift = [(*[c[g] for g in groups], float(sum(u[offsets[g] + levels[g][c[g]]] for g in groups))) for c in cells]
        offset = spark.createDataFrame(shift, schema)
        eta = F.col("off") + sum((F.col(c) * F.lit(float(b)) for c, b in zip(xcols, beta)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-F.greatest(F.least(F.col("eta"), F.lit(30.0)), F.lit(-30.0))))
        work = (rows.join(F.broadcast(offset), list(groups)).withColumn("eta", eta).withColumn("mu", mu)
                .withColumn("w", F.col("mu") * (1 - F.col("mu")))
                .withColumn("z", F.col("eta") + (F.col("y") - F.col("mu")) / F.col("w"))
                .withColumn("w", F.col("w") * F.col("f")))
        sums = work.groupBy(*groups).agg(
            *[F.sum(F.col("w") * F.col(xcols[i]) * F.col(xcols[j])).alias(f"a{i}_{j}") for i, j in pairs],
            *[F.sum(F.col("w") * F.col(c) * F.col("z")).alias(f"b{i}") for i, c in enumerate(xcols)]).collect()
        lhs, rhs = np.zeros((p + q, p + q)), np.zeros(p + q)
        for row in sums:
            a = _symmetric([row[f"a{i}_{j}"] for i, j in pairs], p)
            b = np.array([row[f"b{i}"] for i in range(p)])
            at = [p + offsets[g] + levels[g][row[g]] for g in groups]
            lhs[:p, :p] += a
            rhs[:p] += b
            for s in at:
                lhs[:p, s] += a[:, 0]
                lhs[s, :p] += a[0, :]
                rhs[s] += b[0]
                for t in at:
                    lhs[s, t] += a[0, 0]
        old = np.concatenate([beta, [variances[g] for g in groups]])
        for _ in range(200):
            penalty = np.concatenate([np.zeros(p)] + [np.full(len(levels[g]), 1 / variances[g]) for g in groups])
            inv = np.linalg.inv(lhs + np.diag(penalty))
            sol = inv @ rhs
            step = 0.0
            for g in groups:
                sl = slice(p + offsets[g], p + offsets[g] + len(levels[g]))
                new = max(float(sol[sl] @ sol[sl] + np.trace(inv[sl, sl])) / len(levels[g]), 1e-8)
                step = max(step, abs(new - variances[g]) / max(variances[g], 1e-3))
                variances[g] = new
            if step < 1e-5:
                break
        beta, u = sol[:p], sol[p:]
        new = np.concatenate([beta, [variances[g] for g in groups]])
        if np.max(np.abs(new - old) / np.maximum(np.abs(old), 0.1)) < tol:
            break
    return MixedFit(["intercept", *xs], beta, inv[:p, :p], dict(variances), None, n, {g: len(levels[g]) for g in groups})


def glmm_binomial(df: DataFrame, y: str, xs: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Fixed effects with Wald limits on the log-odds scale."""
    fit = glmm_binomial_fit(df, y, xs, groups)
    tail = (fit.n, float(sum(fit.group_var.values())))
    return df.sparkSession.createDataFrame([(*r, *tail) for r in fit.rows()], TERM_SCHEMA + ", n long, random_var double")
