"""Row filters and plausibility counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import all_of, is_true


def stratum(df: DataFrame, dims: Sequence[str], free: Sequence[str] = (), total: str = "Overall") -> DataFrame:
    """Rows of a pre-cubed table where every dimension but the free ones is the total."""
    return df.where(all_of([F.col(d) == total for d in dims if d not in free]))


def mentions_word(col: str, word: str) -> Column:
    """Case-insensitive substring test; null is no match."""
    return is_true(F.upper(F.col(col)).contains(word.upper()))


def mentions(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Keyword flag on the lower-cased text. Negations are not read: "denies nausea" is a mention."""
    return df.withColumn(out, is_true(F.lower(F.col(text)).rlike(pattern)))


def last_days(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows from ``n`` days before the newest date of the whole table up to it (``n + 1`` days)."""
    newest = df.select(F.max(col)).scalar()
    return df.where(F.col(col) >= F.date_sub(newest, n))


def at_latest(df: DataFrame, col: str) -> DataFrame:
    """Rows of the newest date only; a group with no row on that date is absent."""
    return df.where(F.col(col) == df.select(F.max(col)).scalar())


def plausibility(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule, all rules in one pass."""
    counted = df.agg(*[F.count_if(is_true(rule)).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "rule", "n_violations")


def rate_rules(weekly: str, cumulative: str, high: float = 500.0) -> dict[str, Column]:
    """Rules for a rate table: negative, too high, and a weekly value above the cumulative one."""
    return {
        "negative": F.col(weekly) < 0,
        "too_high": F.col(weekly) > high,
        "weekly_above_cumulative": F.col(weekly) > F.col(cumulative),
    }
