"""Column expressions shared by the operators. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PER_100K = 100_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def flag(condition: Column) -> Column:
    """0/1 indicator; an unknown condition counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def is_true(condition: Column) -> Column:
    """Boolean with unknown read as false."""
    return F.coalesce(condition, F.lit(False))


def no_nan(c: str | Column) -> Column:
    """NaN to null. Aggregates skip nulls but spread NaN, so this belongs at ingestion."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def per_100k(count: str | Column, population: float | Column, digits: int | None = None,
             significant: int | None = None) -> Column:
    """Rate per 100,000, rounded to ``digits`` decimals or to ``significant`` digits."""
    population = population if isinstance(population, Column) else F.lit(float(population))
    rate = _col(count) * (F.lit(float(PER_100K)) / population)
    if significant is not None:
        return signif(rate, significant)
    return rate if digits is None else F.round(rate, digits)


def signif(c: str | Column, digits: int) -> Column:
    """Round to significant digits; zero stays zero."""
    c = _col(c).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c * scale) / scale)


def ladder(c: str | Column, steps: Sequence[tuple[float, str]], default: str, inclusive: bool = False) -> Column:
    """Label by the first threshold the value exceeds (or reaches); thresholds are given from high to low."""
    c = _col(c)
    out = None
    for threshold, label in steps:
        hit = (c >= threshold) if inclusive else (c > threshold)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def direction(c: str | Column, up: str = "Increasing", down: str = "Decreasing", flat: str = "No Change") -> Column:
    c = _col(c)
    return F.when(c > 0, up).when(c < 0, down).otherwise(flat)


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = True) -> Column:
    """Right-closed bins: ``(lo, hi]``; the lowest edge belongs to the first bin. Outside values are null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("cut needs one label per bin")
    c = _col(c)
    out = None
    for i, label in enumerate(labels):
        lower = (c >= edges[i]) if i == 0 and include_lowest else (c > edges[i])
        hit = lower & (c <= edges[i + 1])
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def epiweek_date(year: str | Column, week: str | Column, mmwr_exact: bool = False) -> Column:
    """Sunday that starts an epidemiological week.

    The default steps back from 4 January by its weekday plus one, so a year whose 4 January is a Sunday
    starts a week early; ``mmwr_exact`` keeps that Sunday.
    """
    year, week = _col(year).cast("int"), _col(week).cast("int")
    jan4 = F.make_date(F.when(year.between(1, 9998), year), F.lit(1), F.lit(4))
    back = F.weekday(jan4) + 1
    if mmwr_exact:
        back = back % 7
    return F.date_add(F.date_sub(jan4, back), (week - 1) * 7)


def weeks_since(d: str | Column, anchor: str) -> Column:
    """Whole weeks from an anchor date, halves to even."""
    return F.bround(F.datediff(_col(d), F.lit(anchor).cast("date")) / F.lit(7.0), 0).cast("int")


def days_since(d: str | Column, as_of: str | Column) -> Column:
    """Days from ``d`` up to ``as_of``. A date still to come gives a negative number."""
    as_of = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.datediff(as_of, _col(d))


def first_season_year(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), r"^(\d{4})-", 1).try_cast("int")


def log1p_filled(c: str | Column) -> Column:
    return F.log1p(F.coalesce(_col(c), F.lit(0.0)))


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a range; null stays null."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    return out


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def decimals(c: Column, digits: int) -> Column:
    """Fixed-point text. The value is settled at nine digits first, so that the last bit of a sum decides nothing;
    a half is printed upwards."""
    return F.format_string(f"%.{digits}f", F.round(c, 9))


def median_iqr_cell(median: Column, q1: Column, q3: Column, digits: int = 1) -> Column:
    """``median (Q1–Q3)``; an em dash stands for no data."""
    cell = F.concat(decimals(median, digits), F.lit(" ("), decimals(q1, digits), F.lit("–"),
                    decimals(q3, digits), F.lit(")"))
    return F.when(median.isNull(), F.lit("—")).otherwise(cell)


def mean_sd_cell(mean: Column, sd: Column, digits: int = 1) -> Column:
    """``mean (SD)``; one observation has no SD and shows ``nan``."""
    sd_text = F.when(sd.isNull(), F.lit("nan")).otherwise(decimals(sd, digits))
    return F.when(mean.isNull(), F.lit("—")).otherwise(
        F.concat(decimals(mean, digits), F.lit(" ("), sd_text, F.lit(")")))


def percent_cell(share: Column, digits: int = 1) -> Column:
    return F.when(share.isNull(), F.lit("—")).otherwise(F.concat(decimals(share * 100, digits), F.lit("%")))


def parse_interval(c: str | Column) -> Column:
    """Read ``low–high`` (en dash or ``to``) back into a struct of two doubles."""
    parts = F.split(F.trim(_col(c)), r"\s*(?:–|to)\s*")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("low"),
                    F.get(parts, F.lit(1)).try_cast("double").alias("high"))


def leading_number(c: str | Column) -> Column:
    """The number before the bracket in a formatted cell such as ``12.3 (4.5)``."""
    return F.regexp_extract(_col(c), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def hashed_unit(seed: int, *cols: str | Column) -> Column:
    """Uniform draw in [0, 1) that depends on the row key and the seed only, never on the partitioning."""
    bits = F.xxhash64(*[_col(c) for c in cols], F.lit(seed))
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))
