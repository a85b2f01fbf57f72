"""Two-way fixed effects and event studies on unit-by-period panels, without dummy columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions import dist
from episcope.operators.joins import enrich
from episcope.operators.regression import COEF_SCHEMA
from episcope.session import durable


def complete_panel(df: DataFrame, unit: str, time: str, start: int, end: int, values: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Every unit in every integer period from ``start`` to ``end``; missing cells get ``fill``."""
    grid = df.select(unit).distinct().withColumn(time, F.explode(F.sequence(F.lit(start), F.lit(end))))
    return grid.join(df, [unit, time], "left").fillna(fill, subset=list(values))


def panel_shape(df: DataFrame, unit: str, time: str) -> tuple[int, int, int, bool]:
    """Rows, units, periods, and whether every unit meets every period exactly once."""
    units = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("t"))
    u = units.agg(F.sum("n"), F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("t")).first()
    periods = df.select(F.countDistinct(time)).first()[0]
    return u[0], u[1], periods, u[2] == u[3] == u[4] == periods


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _products(df: DataFrame, cols: Sequence[Column]) -> np.ndarray:
    """Matrix of sums of products in one aggregate."""
    pairs = _pairs(len(cols))
    row = df.agg(*[F.sum(cols[i] * cols[j]) for i, j in pairs]).first()
    out = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v or 0.0
    return out


def balanced_cross(df: DataFrame, cols: Sequence[str], unit: str, time: str, n_units: int, n_periods: int) -> np.ndarray:
    """Cross-products of the doubly demeaned columns of a balanced panel.

    Uses sum(ab) - sum over units - sum over periods + grand term, so the demeaned rows are never built and nothing is
    joined back: three aggregates whose results are p x p numbers.
    """
    means = df.agg(*[F.avg(c) for c in cols]).first()
    shifted = [(F.col(c) - F.lit(float(m))) for c, m in zip(cols, means)]
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(shifted)]
    total = _products(df, shifted)
    by_unit = _products(df.groupBy(unit).agg(*sums), [F.col(f"s{i}") for i in range(len(cols))])
    by_time = _products(df.groupBy(time).agg(*sums), [F.col(f"s{i}") for i in range(len(cols))])
    return total - by_unit / n_periods - by_time / n_units


def demean(df: DataFrame, cols: Sequence[str], unit: str, time: str, tol: float = 1e-10, max_iter: int = 200) -> DataFrame:
    """Doubly demeaned columns of any panel by alternating projections.

    Each sweep subtracts unit means, then period means, and is written to a durable table; sweeps stop when the squared
    length of the columns no longer changes.
    """
    cur = df.select(unit, time, *[F.col(c).cast("double").alias(c) for c in cols])
    last = None
    for _ in range(max_iter):
        for key in (unit, time):
            means = cur.groupBy(key).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
            cur = enrich(cur, means, key, how="inner").select(
                unit, time, *[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in cols])
        cur = durable(cur)
        size = np.array([v or 0.0 for v in cur.agg(*[F.sum(F.col(c) ** 2) for c in cols]).first()])
        if last is not None and np.all(np.abs(last - size) <= tol * np.maximum(last, 1e-300)):
            return cur
        last = size
    raise RuntimeError("alternating projections did not settle; raise max_iter")


@dataclass
class PeriodSolve:
    """Cross-products of columns free of unit and period effects. ``shift`` holds per period what the projection takes from
    each column, ``rank`` the number of independent period effects beside those of the units."""

    cross: np.ndarray
    shift: dict
    rank: int


def eliminate(df: DataFrame, cols: Sequence[str], unit: str, time: str) -> PeriodSolve:
    """Take unit and period effects out of the cross-products of any panel, exactly and without building demeaned rows.

    Rows become one cell per unit and period, units one row with their cells (as many as the calendar has periods). For
    units all that is left are sums: products within a unit less the products of its sums over its rows, for the columns and
    for the period indicators. The driver gets T x T and T x p numbers and solves for the periods.
    """
    k = len(cols)
    means = df.agg(*[F.avg(c) for c in cols]).first()
    centred = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, means)]
    total = _products(df, centred)
    cells = df.groupBy(unit, F.col(time).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("n"),
                                                         *[F.sum(c).alias(f"s{i}") for i, c in enumerate(centred)])
    units = durable(cells.groupBy(unit).agg(
        F.collect_list(F.struct("t", "n", *[f"s{i}" for i in range(k)])).alias("cells"), F.sum("n").alias("rows"),
        *[F.sum(f"s{i}").alias(f"u{i}") for i in range(k)]))
    total = total - _products(units, [F.col(f"u{i}") / F.sqrt("rows") for i in range(k)])
    each = units.select("rows", "cells", *[f"u{i}" for i in range(k)], F.explode("cells").alias("a"))
    by_period = each.groupBy("a.t").agg(F.sum("a.n").alias("n"), *[
        F.sum(F.col(f"a.s{i}") - F.col("a.n") * F.col(f"u{i}") / F.col("rows")).alias(f"m{i}") for i in range(k)]).collect()
    shared = each.select(F.col("a.t").alias("t"), F.col("a.n").alias("n"), "rows", F.explode("cells").alias("b")).groupBy(
        "t", F.col("b.t").alias("o")).agg(F.sum(F.col("n") * F.col("b.n") / F.col("rows")).alias("w")).collect()
    at = {r["t"]: i for i, r in enumerate(sorted(by_period, key=lambda r: r["t"]))}
    dd, dc = np.zeros((len(at), len(at))), np.zeros((len(at), k))
    for r in by_period:
        dd[at[r["t"]], at[r["t"]]] += r["n"]
        dc[at[r["t"]]] = [r[f"m{i}"] for i in range(k)]
    for r in shared:
        dd[at[r["t"]], at[r["o"]]] -= r["w"]
    scale, rank = _inverse(dd)
    taken = scale @ dc
    return PeriodSolve(total - dc.T @ taken, {t: [float(x) for x in taken[i]] for t, i in at.items()}, rank)


def _inverse(a: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, int]:
    """Generalised inverse and rank of a matrix of cross-products, judged after scaling its columns to length one."""
    d = np.sqrt(np.maximum(np.diag(a), 0.0))
    d = np.where(d > 0, d, 1.0)
    values, vectors = np.linalg.eigh(a / np.outer(d, d))
    keep = values > tol
    inv = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    return inv / np.outer(d, d), int(keep.sum())


def _fit(cross: np.ndarray, xs: Sequence[str], dof: int) -> tuple[np.ndarray, np.ndarray, float]:
    sxx, sxy, syy = cross[1:, 1:], cross[1:, 0], cross[0, 0]
    inv = np.linalg.pinv(sxx, hermitian=True)
    beta = inv @ sxy
    rss = max(float(syy - beta @ sxy), 0.0)
    return beta, inv, rss / dof


def _table(df: DataFrame, xs, beta, cov, dof, extra="", tail=()) -> DataFrame:
    q = dist.t_quantile(0.975, dof)
    rows = []
    for name, b, v in zip(xs, beta, np.diag(cov)):
        s = float(np.sqrt(max(v, 0.0)))
        t = float(b) / s if s > 0 else float("nan")
        rows.append((name, float(b), s, float(b) - q * s, float(b) + q * s, t,
                     dist.t_two_sided(t, dof) if s > 0 else float("nan"), *tail))
    return df.sparkSession.createDataFrame(rows, COEF_SCHEMA + extra)


def twoway_fe(df: DataFrame, y: str, xs: Sequence[str], unit: str, time: str, cluster: bool = False) -> DataFrame:
    """Coefficients of ``y ~ xs + unit effects + period effects``; equal to the fit with explicit dummies.

    Balanced panels need only three aggregates, others :func:`eliminate`. ``cluster`` gives standard errors that allow for
    correlation within a unit. Degrees of freedom count independent effects and columns: units, periods less one per
    connected part of the panel, and the rank of ``xs`` beside them. The needed columns are written out once, since the
    sums read them several times.
    """
    rows = durable(df.select(unit, time, y, *xs).dropna())
    return _twoway(rows, y, xs, unit, time, cluster)


def _twoway(rows: DataFrame, y: str, xs: Sequence[str], unit: str, time: str, cluster: bool = False,
            max_periods: int = 2000) -> DataFrame:
    n, units, periods, balanced = panel_shape(rows, unit, time)
    cols = [y, *xs]
    if balanced and not cluster:
        solve = PeriodSolve(balanced_cross(rows, cols, unit, time, units, periods), {}, periods - 1)
    elif periods <= max_periods:
        solve = eliminate(rows, cols, unit, time)
    else:  # the driver's table of periods grows with their square, so long calendars are demeaned in sweeps
        flat = demean(rows, cols, unit, time)
        solve = PeriodSolve(_products(flat, [F.col(c) for c in cols]), {}, periods - 1)
        rows = flat
    dof = n - units - solve.rank - _inverse(solve.cross[1:, 1:])[1]
    beta, inv, s2 = _fit(solve.cross, xs, dof)
    cov = s2 * inv
    if cluster:
        meat = _unit_scores(rows, cols, unit, time, solve.shift, beta)
        cov = inv @ meat @ inv * (units / (units - 1)) * ((n - 1) / dof)
    return _table(rows, xs, beta, cov, dof, ", n long, n_units long, n_periods long", (n, units, periods))


def _unit_scores(rows: DataFrame, cols: Sequence[str], unit: str, time: str, shift: dict, beta: np.ndarray) -> np.ndarray:
    """Sum over units of the outer products of their scores. A unit's score needs the products and sums of its columns less
    the period shifts, so one grouped pass is enough."""
    k = len(cols)
    moved = rows
    if shift:
        schema = ", ".join([f"`{time}` {dict(rows.dtypes)[time]}", *[f"g{i} double" for i in range(k)]])
        table = rows.sparkSession.createDataFrame([(t, *g) for t, g in shift.items()], schema)
        moved = rows.join(F.broadcast(table), time)  # one row per period, no more than the driver has just solved for
    z = [F.col(c).cast("double") - (F.col(f"g{i}") if shift else F.lit(0.0)) for i, c in enumerate(cols)]
    resid = z[0] - sum((x * F.lit(float(b)) for x, b in zip(z[1:], beta)), F.lit(0.0))
    # A pass over rows gives sums of x * residual, of x and of residuals; the unit's means are taken out afterwards.
    sums = moved.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.sum(resid).alias("r"), *[
        F.sum(x * resid).alias(f"p{i}") for i, x in enumerate(z[1:])], *[F.sum(x).alias(f"x{i}") for i, x in enumerate(z[1:])])
    return _products(sums, [F.col(f"p{i}") - F.col(f"x{i}") * F.col("r") / F.col("n") for i in range(k - 1)])


def one_way_fe(df: DataFrame, y: str, xs: Sequence[str], unit: str) -> DataFrame:
    """Coefficients of ``y ~ xs + unit effects``: total cross-products minus those of the unit sums, no join.

    A column that never changes within a unit has no coefficient of its own and comes out as zero.
    """
    rows = durable(df.select(unit, y, *xs).dropna())
    cols = [y, *xs]
    means = rows.agg(*[F.avg(c) for c in cols]).first()
    shifted = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, means)]
    total = _products(rows, shifted)
    sums = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(shifted)])
    scaled = [F.col(f"s{i}") / F.sqrt("n") for i in range(len(cols))]
    cross = total - _products(sums, scaled)
    size = sums.agg(F.sum("n"), F.count(F.lit(1))).first()
    dof = size[0] - size[1] - _inverse(cross[1:, 1:])[1]
    beta, inv, s2 = _fit(cross, xs, dof)
    return _table(df, xs, beta, s2 * inv, dof, ", n long, n_units long", (size[0], size[1]))


def event_study(df: DataFrame, y: str, unit: str, time: str, start: str, lo: int = -12, hi: int = 12,
                omit: int = -1) -> DataFrame:
    """Effect at each period relative to the unit's start, both ends binned, ``omit`` as reference, with unit and
    period effects. Units without a start serve as controls."""
    rel = F.greatest(F.least(F.col(time) - F.col(start), F.lit(hi)), F.lit(lo))
    steps = [k for k in range(lo, hi + 1) if k != omit]
    names = {k: f"rel_{'m' if k < 0 else 'p'}{abs(k)}" for k in steps}
    base = durable(df.select(F.col(y).cast("double").alias(y), unit, time, start).dropna(subset=[y, unit, time]))
    coded = base.select(y, unit, time, *[
        F.when(F.col(start).isNotNull() & (rel == k), 1.0).otherwise(0.0).alias(names[k]) for k in steps])
    table = _twoway(coded, y, list(names.values()), unit, time)
    back = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)])
    effects = table.select(F.element_at(back, F.col("term")).alias("rel_time"), "estimate", "se", "ci_low", "ci_high",
                           "p_value")
    zero = table.sparkSession.createDataFrame([(omit, 0.0, 0.0, 0.0, 0.0, None)], effects.schema)
    return effects.unionByName(zero).orderBy("rel_time")
