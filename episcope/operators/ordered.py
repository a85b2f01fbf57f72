"""Ordered work on groups of any size.

A plain window sorts a whole group in one task, which fails when one key holds a large part of the table. The
helpers here cut the order into ranges first, work inside each range, and carry small per-range totals across.
Results are exact and do not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from episcope.session import durable

_BUCKET, _ORDER = "__range", "__order"


def _order_number(df: DataFrame, col: str) -> Column:
    """The order column as a double that never reverses the order (equal doubles share a range)."""
    dtype = dict(df.dtypes)[col]
    if dtype == "date":
        return F.unix_date(col).cast("double")
    if dtype == "timestamp_ntz":
        # Wall-clock parts, since a session time zone would reorder times around a clock change.
        seconds = F.hour(col) * 3600 + F.minute(col) * 60 + F.expr(f"extract(SECOND FROM `{col}`)").cast("double")
        return F.unix_date(F.col(col).cast("date")) * F.lit(86400.0) + seconds
    if dtype.startswith("timestamp"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if dtype == "string":
        raise TypeError(f"{col}: order ranges need a number, date or timestamp")
    return F.col(col).cast("double")


def range_count(df: DataFrame) -> int:
    """Number of order ranges: one per shuffle partition, 8 at least. It grows with the cluster's setting without a limit."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _sketched(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float], out: str) -> DataFrame:
    """Approximate quantiles of a number per key. Sketches are merged in 256 groups first and then once more, so no task
    receives a sketch from every input partition."""
    accuracy = F.lit(2 * len(probs) + 100)
    first = df.where(F.col(col).isNotNull()).groupBy(*keys, (F.spark_partition_id() % 256).alias("__g")).agg(
        F.percentile_approx(col, list(probs), accuracy).alias("c"))
    return first.select(*keys, F.explode("c").alias("c")).groupBy(*keys).agg(F.percentile_approx("c", list(probs), accuracy).alias(out))


def _raw_cuts(df: DataFrame, order: str, parts: int | None) -> list[float]:
    """Cut points with repeats: a value that holds the rows of several ranges comes several times."""
    parts = parts or range_count(df)
    probs = [i / parts for i in range(1, parts)]
    found = _sketched(df.select(_order_number(df, order).alias(_ORDER)), [], _ORDER, probs, "c").first()
    return sorted(float(c) for c in (found["c"] if found else None) or [] if c == c)


def range_cuts(df: DataFrame, order: str, parts: int | None = None) -> list[float]:
    """Cut points that split the rows into ranges of about equal size. Driver step: at most ``parts`` numbers. The cuts
    steer balance only; results are exact for any cuts."""
    return sorted(set(_raw_cuts(df, order, parts)))


def _tie_number(df: DataFrame, col: str) -> Column:
    """As the order number; strings by their first six bytes, in the order in which Spark sorts strings."""
    if dict(df.dtypes)[col] == "string":
        return F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(col), "utf-8")), 1, 12), 12, "0"), 16, 10).cast("double")
    return _order_number(df, col)


def _steps(value: Column, cuts: Column, coarse: Column, stride: int) -> Column:
    """How many of the sorted cuts are at or below the value: first among every ``stride``-th one, then behind the last of
    these."""
    reached = F.size(F.filter(coarse, lambda c: c <= value))
    start = F.greatest(reached - 1, F.lit(0)) * stride
    return start + F.size(F.filter(F.slice(cuts, start + 1, F.lit(stride)), lambda c: c <= value))


def with_composite_ranges(df: DataFrame, order: str, tie: Sequence[str], parts: int | None = None,
                          cuts: Sequence[float] | None = None) -> DataFrame:
    """Add the range number along ``order`` and then ``tie``, a long: a value of ``order`` that holds several ranges' rows is
    cut along the first tie column, a pair that still does along the next, and so on.

    Such a value is the lowest one of its range, so its rows' sub-ranges come first and the range's other rows after them.
    Per column the driver gets as many numbers as there are ranges; they return as a broadcast table of that size.
    """
    parts = parts or range_count(df)
    raw = _raw_cuts(df, order, parts) if cuts is None else sorted(cuts)
    ranged = with_ranges(df, order, sorted(set(raw))).withColumn(_BUCKET, F.col(_BUCKET).cast("long"))
    ranged = ranged.withColumn("__value", _order_number(df, order))
    heavy = {(v,): n for v, n in Counter(raw).items() if n > 1}
    values, base = ["__value"], parts + 2
    for i, column in enumerate(tie):
        if not heavy or base ** (i + 2) >= 1 << 62:
            break
        names = [f"__v{j}" for j in range(len(values))]
        keys = df.sparkSession.createDataFrame(
            [(*k, n) for k, n in heavy.items()], ", ".join(f"{x} double" for x in names) + ", __k int")
        number = _tie_number(df, column)
        match = reduce(lambda a, b: a & b, [F.col(v) == F.col(x) for v, x in zip(values, names)])
        rows = ranged.join(F.broadcast(keys), match).select(*names, "__k", number.alias("__t"))  # few keys: two ranges' rows each
        most = max(heavy.values())
        found = _sketched(rows, [*names, "__k"], "__t", [j / (most + 1) for j in range(1, most + 1)], "c")
        # As many cuts as the key has ranges of its own.
        found = [(tuple(r[x] for x in names), sorted(float(c) for c in r["c"] if c == c)) for r in found.select(
            *names, F.filter("c", lambda c, j: F.floor((j + 1) * F.col("__k") / most) > F.floor(j * F.col("__k") / most)).alias("c")).collect()]
        stride = max(1, math.isqrt(most))
        table = [(*k, sorted(set(c)), sorted(set(c))[::stride]) for k, c in found if c]
        if not table:
            break
        cut_of = F.broadcast(df.sparkSession.createDataFrame(
            table, ", ".join(f"{x} double" for x in names) + ", __c array<double>, __coarse array<double>"))
        t = F.col("__t")
        sub = F.when(t.isNull(), 0).otherwise(F.coalesce(_steps(t, F.col("__c"), F.col("__coarse"), stride) + 1, F.lit(base - 1)))
        ranged = ranged.withColumn("__t", number).join(cut_of, match, "left").withColumn(
            _BUCKET, F.col(_BUCKET) * base + F.when(F.col("__c").isNull(), base - 1).otherwise(sub).cast("long"))
        ranged = ranged.withColumnRenamed("__t", f"__value{i}").drop(*names, "__c", "__coarse")
        values.append(f"__value{i}")
        heavy = {(*k, v): n for k, c in found for v, n in Counter(c).items() if n > 1}
    return ranged.drop(*values)


def with_ranges(df: DataFrame, order: str, cuts: Sequence[float]) -> DataFrame:
    """Add the range number of ``order``."""
    numbered = df.withColumn(_ORDER, _order_number(df, order))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=_ORDER, outputCol=_BUCKET, handleInvalid="keep").transform(numbered)
    return bucketed.withColumn(_BUCKET, F.col(_BUCKET).cast("int")).drop(_ORDER)


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on null-safe keys, keeping the left copy of each key."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"__r_{k}"])
    return left.join(renamed, condition).drop(*[f"__r_{k}" for k in keys])


def running_totals(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], descending: bool = False,
                   tie: Sequence[str] = (), cuts: Sequence[float] | None = None) -> DataFrame:
    """Inclusive running sums ``{out: col}`` per key along ``order``, exact for groups of any size.

    Rows that share an order value need ``tie`` columns, or should be added up beforehand. A range holds at most its
    share of all rows, so a key with a third of the table is spread over a third of the ranges. Pass ``cuts`` when they
    can be taken from a cheaper frame than ``df``.
    """
    keys = list(keys)
    if tie and not descending:
        ranged = with_composite_ranges(df, order, tie, cuts=cuts)
    else:
        ranged = with_ranges(df, order, range_cuts(df, order) if cuts is None else cuts)
    cell = [*keys, _BUCKET]
    totals = ranged.groupBy(cell).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in cols.items()])
    by_range = F.col(_BUCKET).desc() if descending else F.col(_BUCKET)
    before = Window.partitionBy(*keys).orderBy(by_range).rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and range: a key has at most `parts` rows here, whatever its size in the input.
    offsets = totals.select(*cell, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}")
                                     for o in cols])
    sort = [F.col(order).desc() if descending else F.col(order).asc(), *tie]
    within = Window.partitionBy(*cell).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(within).alias(f"__s_{o}") for o, c in cols.items()])
    joined = _join_on(local, offsets, cell)
    return joined.select(*df.columns, *[(F.col(f"__s_{o}") + F.col(f"__o_{o}")).alias(o) for o in cols])


def positions(df: DataFrame, keys: Sequence[str], order: str, out: str = "pos", tie: Sequence[str] = (),
              cuts: Sequence[float] | None = None) -> DataFrame:
    """1-based row number per key along ``order`` (then ``tie``)."""
    counted = running_totals(df.withColumn("__one", F.lit(1).cast("long")), keys, order, {out: "__one"},
                             tie=tie, cuts=cuts)
    return counted.drop("__one")


def windowed(df: DataFrame, keys: Sequence[str], order: str, before: int,
             exprs: dict[str, Callable[[WindowSpec], Column]], tie: Sequence[str] = (),
             block: int = 100_000) -> DataFrame:
    """Look-back window functions that need at most ``before`` earlier rows, exact for groups of any size.

    A group is cut into blocks of consecutive rows. The last ``before`` rows of a block are repeated at the head of
    the next one, so every window sees the rows it needs and no task holds more than ``block + before`` rows.
    """
    block = max(block, before)
    numbered = positions(df, keys, order, "__pos", tie)
    home = F.floor((F.col("__pos") - 1) / block)
    tail = (F.col("__pos") - 1) % block >= block - before
    blocks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = numbered.withColumn("__home", home).withColumn("__block", F.explode(blocks))
    window = Window.partitionBy(*keys, "__block").orderBy("__pos")
    out = spread.select("*", *[fn(window).alias(name) for name, fn in exprs.items()])
    return out.where(F.col("__block") == F.col("__home")).drop("__pos", "__home", "__block")


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, without sorting the table or holding a group in one task.

    Rows are first only counted per key and value range. The counts tell which ranges hold the wanted ranks, and just
    the rows of those ranges are looked at value by value: a few in two thousand on a large cluster. Null values and
    null keys are left out.
    """
    from episcope.operators.joins import enrich

    keys = list(keys)
    present = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("__v")).dropna()
    ranged = with_ranges(present, "__v", range_cuts(present, "__v"))
    cells = durable(ranged.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("__n")))
    order = Window.partitionBy(*keys).orderBy(_BUCKET)  # at most one row per range and key
    placed = cells.select(
        *keys, _BUCKET, (F.sum("__n").over(order) - F.col("__n")).alias("__before"), "__n",
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"))
    rank = {name: (F.col("__total") - 1) * F.lit(float(p)) for name, p in probs.items()}
    ends = [(f"__{side}_{name}", at(r)) for name, r in rank.items() for side, at in (("lo", F.floor), ("hi", F.ceil))]
    inside = F.lit(False)
    for _, at in ends:
        inside = inside | ((F.col("__before") <= at) & (at < F.col("__before") + F.col("__n")))
    wanted = placed.where(inside).drop("__n")
    few = enrich(ranged, wanted, [*keys, _BUCKET], how="inner")
    values = few.groupBy(*keys, _BUCKET, "__before", "__total", "__v").agg(F.count(F.lit(1)).alias("__n"))
    within = Window.partitionBy(*keys, _BUCKET).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.withColumn("__last", F.col("__before") + F.sum("__n").over(within) - 1)
    first = F.col("__last") - F.col("__n") + 1
    found = counted.groupBy(*keys).agg(
        *[F.max(F.when((first <= at) & (at <= F.col("__last")), F.col("__v"))).alias(name) for name, at in ends],
        F.max("__total").alias("__total"))
    return found.select(*keys, *[
        (F.col(f"__lo_{n}") + (rank[n] - F.floor(rank[n])) * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n)
        for n in probs])
