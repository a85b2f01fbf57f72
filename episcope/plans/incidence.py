"""Incidence reports from a line list of tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import direction, ladder, per_100k
from episcope.operators.filters import at_latest, last_days
from episcope.operators.tabulate import daily_positives
from episcope.operators.windows import rolling_sum

# Concern levels by 7-day incidence per 100,000.
CONCERN = ((25.0, "High"), (10.0, "Medium"))


def rolling_incidence(tests: DataFrame, date: str, pathogen: str, result: Column, population: float,
                      windows: Sequence[int] = (7, 28), digits: int | None = 1,
                      significant: int | None = None) -> DataFrame:
    """Daily positives with trailing sums over rows and rates per 100,000.

    The line list is reduced to one row per pathogen and day before the window, so a window group has as many rows as
    the calendar has days, however large the list.
    """
    daily = daily_positives(tests, date, [pathogen], result)
    rolled = rolling_sum(daily, [pathogen], "test_date", "count", list(windows), "rolling_{n}d", bounded=True)
    return rolled.select("*", *[
        per_100k(f"rolling_{n}d", population, digits, significant).alias(f"per_100k_{n}d") for n in windows])


def incidence_report(tests: DataFrame, date: str, pathogen: str, result: Column, population: float,
                     start: str | None = None, end: str | None = None,
                     pathogens: Sequence[str] | None = None) -> DataFrame:
    """Incidence on the latest date, change between the 7- and 28-day rate, and concern level per pathogen."""
    day = F.col(date).cast("date")
    rows = tests
    if pathogens:
        rows = rows.where(F.col(pathogen).isin(*pathogens))
    if start:
        rows = rows.where(day >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(day <= F.lit(end).cast("date"))
    latest = at_latest(rolling_incidence(rows, date, pathogen, result, population), "test_date")
    return latest.select(
        F.col(pathogen).alias("pathogen"), F.col("per_100k_7d").alias("incidence_7d"),
        F.col("per_100k_28d").alias("incidence_28d"),
        F.round(F.col("per_100k_7d") - F.col("per_100k_28d"), 1).alias("change"),
        ladder("per_100k_7d", CONCERN, "Low").alias("concern"))


def recent_vs_older(tests: DataFrame, date: str, pathogen: str, result: Column, population: float, recent: int = 7,
                    older: int = 35, reference_sign: bool = False) -> DataFrame:
    """Mean incidence of the last days against a longer stretch, percent change and status.

    The change is (recent - older) / older; ``reference_sign`` flips it, which also flips the status, to match reports
    that were made that way.
    """
    rates = rolling_incidence(tests, date, pathogen, result, population, windows=(7,), significant=2)
    newest = rates.select(F.max("test_date")).scalar()
    window = last_days(rates, "test_date", older)
    fresh = F.col("test_date") >= F.date_sub(newest, recent)
    table = window.groupBy(F.col(pathogen).alias("pathogen")).agg(
        F.avg("per_100k_7d").alias("older_incidence"),
        F.avg(F.when(fresh, F.col("per_100k_7d"))).alias("recent_incidence")).where("recent_incidence is not null")
    change = F.try_divide((F.col("recent_incidence") - F.col("older_incidence")) * 100.0, F.col("older_incidence"))
    signed = -change if reference_sign else change
    return table.withColumn("pct_change", signed).withColumn("status", direction("pct_change"))
