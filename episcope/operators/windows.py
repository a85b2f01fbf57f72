"""Row and calendar windows per group.

``bounded=True`` says that a group has few rows by construction (for example one row per day), so a plain window is
the right plan. Otherwise the block-wise form is used, which also holds when one key owns a third of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from episcope.operators.joins import enrich
from episcope.operators.ordered import running_totals, windowed


def _apply(df: DataFrame, keys: Sequence[str], order: str, before: int,
           exprs: dict[str, Callable[[WindowSpec], Column]], bounded: bool, tie: Sequence[str] = ()) -> DataFrame:
    if bounded:
        window = Window.partitionBy(*keys).orderBy(order, *tie)
        return df.select("*", *[fn(window).alias(name) for name, fn in exprs.items()])
    return windowed(df, keys, order, before, exprs, tie)


def rolling_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int | Sequence[int],
                out: str = "rolling_{n}", calendar: bool = False, bounded: bool = False,
                tie: Sequence[str] = ()) -> DataFrame:
    """Trailing sum over ``n`` rows, partial at the start. ``calendar`` counts days instead of rows."""
    sizes = [n] if isinstance(n, int) else list(n)
    if calendar:
        day = F.unix_date(F.col(order).cast("date"))
        window = Window.partitionBy(*keys).orderBy(day)
        return df.select("*", *[F.sum(value).over(window.rangeBetween(-(k - 1), 0)).alias(out.format(n=k))
                                for k in sizes])
    exprs = {out.format(n=k): (lambda w, k=k: F.sum(value).over(w.rowsBetween(-(k - 1), 0))) for k in sizes}
    return _apply(df, keys, order, max(sizes), exprs, bounded, tie)


def rolling_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, out: str,
                 bounded: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Trailing mean over ``n`` rows; nulls are skipped and one value is enough."""
    return _apply(df, keys, order, n, {out: lambda w: F.avg(value).over(w.rowsBetween(-(n - 1), 0))}, bounded, tie)


def lags(df: DataFrame, keys: Sequence[str], order: str, value: str, ns: Sequence[int],
         out: str = "lag{n}_{value}", bounded: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Earlier values of a column. The order column decides what "earlier" means: ordering a season by week number
    puts weeks 1-17 before week 40; pass a date for the chronological reading."""
    exprs = {out.format(n=n, value=value): (lambda w, n=n: F.lag(value, n).over(w)) for n in ns}
    return _apply(df, keys, order, max(ns), exprs, bounded, tie)


def dense_position(df: DataFrame, keys: Sequence[str], order: str, out: str, bounded: bool = False) -> DataFrame:
    """Dense rank of ``order`` per key, taken over its distinct values and joined back."""
    levels = df.select(*keys, order).distinct()
    if bounded:
        window = Window.partitionBy(*keys).orderBy(order)
        ranked = levels.withColumn(out, F.row_number().over(window).cast("long"))
    else:
        ranked = running_totals(levels.withColumn("__one", F.lit(1).cast("long")), keys, order, {out: "__one"}).drop("__one")
    return enrich(df, ranked, [*keys, order])


def keep_max(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """One row per key: the highest value wins, nulls last, then the first by ``tie``.

    An aggregate with map-side combine, not a window, so duplicates of a hot key are reduced before the shuffle.
    """
    order = F.struct(F.col(value).isNull().alias("gap"), (-F.col(value)).alias("neg"), *[F.col(t) for t in tie])
    best = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.min_by(F.struct(*df.columns), order).alias("row"))
    return best.select("row.*")


def resolve_duplicates(df: DataFrame, within, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Apply :func:`keep_max` to the rows that meet ``within`` and leave the others untouched."""
    inside = F.coalesce(within, F.lit(False))
    return keep_max(df.where(inside), keys, value, tie).unionByName(df.where(~inside))


def rank_by(summary: DataFrame, col: str, out: str = "rank", descending: bool = False,
            tie: Sequence[str] = ()) -> DataFrame:
    """Number the rows of a summary table by a column. For result tables only: the whole table is one window."""
    by = F.col(col).desc() if descending else F.col(col).asc()
    return summary.withColumn(out, F.row_number().over(Window.orderBy(by, *tie)).cast("long"))


def first_detection(df: DataFrame, date: str, observed: str, upper: str, after: str,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Earliest date after ``after`` on which the observed value is above the upper bound."""
    hit = (F.col(date) > F.lit(after).cast("date")) & (F.col(observed) > F.col(upper))
    return df.groupBy(*keys).agg(F.min(F.when(hit, F.col(date))).alias("first_detection"))


def detection_gap(a: Column, b: Column) -> Column:
    """Whole weeks between two detections, truncated toward zero."""
    return F.abs((F.datediff(a, b) / F.lit(7.0)).cast("int"))
