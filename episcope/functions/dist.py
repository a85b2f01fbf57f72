"""Tail probabilities for small result tables (one row per test or model term).

The closed forms are the usual continued fractions for the incomplete beta and gamma functions. They run inside
Arrow-batched UDFs so that a test result stays a lazy DataFrame.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-15
#: Beyond so many degrees of freedom the continued fraction needs too many terms and its front factor cancels.
LARGE_DOF = 1e6


def _lentz(numerators, start: float = 1.0) -> float:
    """Modified Lentz evaluation of start + a1/(1 + a2/(1 + ...))."""
    f, c, d = start or _TINY, start or _TINY, 0.0
    for a in numerators:
        d = 1.0 + a * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + a / c
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < _EPS:
            break
    return f


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)

    def terms():
        for m in range(1, 2000):
            k = m // 2
            if m % 2:
                yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
            else:
                yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))

    log_front = a * math.log(x) + b * math.log1p(-x) - math.log(a) + (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return math.exp(log_front) / _lentz(terms())


def gamma_sf(x: float, a: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    # Legendre's continued fraction, evaluated backwards with enough levels for the tail region.
    value = 0.0
    for k in range(600, 0, -1):
        value = k * (a - k) / (x + 2 * k + 1 - a + value)
    return math.exp(log_front) / (x + 1 - a + value)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, dof: float) -> float:
    if dof > LARGE_DOF:  # normal transformation; its error falls with the square of dof
        return normal_two_sided(t * (1.0 - 0.25 / dof) / math.sqrt(1.0 + t * t / (2.0 * dof)))
    return beta_cdf(dof / (dof + t * t), dof / 2.0, 0.5)


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(x / 2.0, dof / 2.0)


def f_sf(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 1.0
    if d1 == 1.0:
        return t_two_sided(math.sqrt(x), d2)
    if d2 > 100 * LARGE_DOF:  # the chi-square limit; its error falls with d2
        return chi2_sf(d1 * x, d1)
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2.0, d1 / 2.0)


def _bisect(fn, target: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if fn(mid) < target else (low, mid)
    return (low + high) / 2.0


def normal_quantile(p: float) -> float:
    return _bisect(normal_cdf, p, -40.0, 40.0)


def t_quantile(p: float, dof: float) -> float:
    if p < 0.5:
        return -t_quantile(1.0 - p, dof)
    high = 10.0
    while 1.0 - t_two_sided(high, dof) / 2.0 < p:
        high *= 2.0
    return _bisect(lambda t: 1.0 - t_two_sided(t, dof) / 2.0, p, 0.0, high)


def _column(fn):
    @F.pandas_udf("double")
    def tail(x: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(u) or pd.isna(v) else fn(float(u), float(v)) for u, v in zip(x, a)],
                         dtype="float64")
    return tail


def t_p_value(stat, dof):
    """Two-sided Student p-value as a Column."""
    return _column(t_two_sided)(stat, dof)


def chi2_p_value(stat, dof):
    return _column(chi2_sf)(stat, dof)


def z_p_value(stat):
    return _column(lambda z, _: normal_two_sided(z))(stat, F.lit(1.0))
