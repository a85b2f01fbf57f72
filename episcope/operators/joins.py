"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import is_true

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 256 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row: text and arrays by their length, other columns at 16 bytes."""
    total = F.lit(0).cast("long")
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 16
        elif t.startswith("array"):
            total = total + F.coalesce(F.size(F.col(f"`{c}`")), F.lit(0)) * 16 + 16
        else:
            total = total + 16
    return total


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Check rows and bytes before a broadcast: one aggregate over the table."""
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return found[0] <= rows and found[1] <= size


def hot_keys(df: DataFrame, keys: str | Sequence[str], share: float = 0.01) -> list[tuple]:
    """Keys that hold more than ``share`` of the rows. There are fewer than ``1 / share`` of them by arithmetic."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return [tuple(r) for r in counts.where(F.col("__n") > total * F.lit(share)).select(*keys).collect()]


def enrich(df: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "left",
           rows: int = BROADCAST_ROWS, share: float = 0.01) -> DataFrame:
    """Join detail rows to a table with unique keys.

    A dimension within the checked broadcast size is broadcast. A larger one is joined by shuffle, and the rows of hot
    keys are set apart: they meet the few matching dimension rows by broadcast, so no shuffle partition carries a hot
    key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dim, rows):
        return df.join(F.broadcast(dim), keys, how)
    hot = hot_keys(df, keys, share)
    if not hot:
        return df.join(dim, keys, how)
    marks = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))  # fewer than 1 / share rows
    apart, few = df.join(marks, keys, "left_semi"), dim.join(marks, keys, "left_semi")
    rest = df.join(marks, keys, "left_anti")
    return rest.join(dim, keys, how).unionByName(apart.join(F.broadcast(few), keys, how))


def new_rows(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not present yet."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def exists_labels(sources: Mapping[str, tuple[DataFrame, Column]], key: str) -> DataFrame:
    """One row per key seen in any source; label true where any row of its source meets the condition.

    The sources are stacked as sparse flags and reduced in one aggregate, so the key universe, the labels and the
    joins between them cost a single shuffle with map-side combine.
    """
    stacked = None
    for name, (df, condition) in sources.items():
        flags = [(condition if other == name else F.lit(None).cast("boolean")).alias(other) for other in sources]
        part = df.where(F.col(key).isNotNull()).select(key, *flags)
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(key).agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in sources])


def scenarios(df: DataFrame, values: Sequence, out: str) -> DataFrame:
    """Every row under every scenario value; the values are literals, so the growth factor is fixed."""
    return df.withColumn(out, F.explode(F.array(*[F.lit(v) for v in values])))


def side_by_side(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put two result tables next to one another by group key."""
    return left.join(right, key)


def method_agreement(gaps: DataFrame, anomalies: DataFrame, key: str, gap: str, anomaly: str,
                     excluded: Sequence[str] = ()) -> DataFrame:
    """Do the forecast gap and the anomaly score agree on each season?

    A positive gap with an anomaly, or any other gap with a normal score, is agreement; an excluded season has no
    verdict. ``anomaly`` is a boolean column of ``anomalies``.
    """
    joined = gaps.join(anomalies.select(key, anomaly), key, "left")
    positive = F.col(gap) > 0
    left_out = F.col(key).isin(*excluded) if excluded else F.lit(False)
    direction = F.when(positive, "Positive").otherwise("Negative")
    verdict = (F.when(left_out, "N/A")
               .when(positive & F.col(anomaly), "Yes — both methods flag")
               .when(~is_true(positive) & ~F.col(anomaly), "Yes — both methods normal")
               .otherwise("Partial — methods diverge"))
    return joined.withColumns({"gap_direction": direction, "method_agreement": verdict})
