"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.session import durable

ROWS_PER_BUCKET = 50_000
#: A side of a join is broadcast up to this many narrow rows, and only after they were counted.
BROADCAST_ROWS = 50_000


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not use yet (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """128 bits that name the content of a row; nulls differ from empty values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("\x1f", *parts))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame (written before, narrow), marked for broadcast if it is counted to be small; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with their number from 0 without gaps in the long ``name``, which is the same each time it is worked out.

    Rows that come straight and whole from Parquet files are numbered by file, in the order of the writing tasks, and place
    in the file, without a copy; others are written to the shared folder first and numbered in their own order. A row per
    file or partition reaches the driver."""
    part, at = free_name(df, "__part"), free_name(df, "__at")
    rows = None
    try:
        rows = df.select("*", F.col("_metadata.file_name").alias(part), F.col("_metadata.row_index").alias(at))
    except AnalysisException:  # not from files that number their rows
        pass
    counts = lambda x: x.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).collect()
    counted = counts(rows) if rows is not None else []
    if rows is None or any(r["n"] != r["last"] + 1 for r in counted):  # some rows of a file were left out or repeated
        i = F.monotonically_increasing_id()
        rows = durable(df.select("*", i.alias(at)).select("*", F.shiftright(at, 33).cast("string").alias(part))
                       .withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1)))
        counted = counts(rows)
    # Names start with the number of the writing task; a task's later files have later names.
    number = lambda r: (int(m[1]) if (m := re.match(r"(?:part-)?(\d+)", r[part])) else 0, r[part])
    before, total = [], 0
    for r in sorted(counted, key=number):
        before.append((r[part], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(before, f"`{part}` string, `__before` long")
    return (rows.join(F.broadcast(starts), part).withColumn(name, F.col("__before") + F.col(at))
            .select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"`{name}`")))


def with_running(df: DataFrame, group: str, ties: list[Column], weight: Column, index: str, before: str,
                 rows_per_bucket: int = ROWS_PER_BUCKET, rank: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps and add the weight of the rows before each, also for a group
    that holds most of the rows: rows go to hash buckets of about ``rows_per_bucket`` rows, a small table carries the
    totals from bucket to bucket, and only one bucket of one group is sorted in a task.

    The order inside a group is by the hash of ``ties`` and then ``ties``, or by ``rank`` where that is given: whole
    numbers from 0 without gaps over the whole frame. Equal rows are interchangeable.
    """
    w, bucket = free_name(df, "__w"), free_name(df, "__bucket")
    rows = df.select(F.count(F.lit(1)).alias("n")).head()["n"]
    buckets = max(1, math.ceil(rows / rows_per_bucket))
    spread = F.xxhash64(*ties) if rank is None else rank
    dealt = F.pmod(spread, F.lit(buckets)) if rank is None else F.floor(spread / F.lit(rows_per_bucket))
    keyed = df.withColumn(w, weight.cast("long")).withColumn(bucket, dealt.cast("int"))
    totals = keyed.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"), F.sum(w).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(group).alias("__g"), F.col(bucket).alias("__b"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows_before"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__weight_before"))
    inside = Window.partitionBy("__g", "__b").orderBy(spread, *ties)
    return (
        keyed.join(offsets, (F.col(group).eqNullSafe(F.col("__g"))) & (F.col(bucket) == F.col("__b")))
        .withColumn(index, F.col("__rows_before") + F.row_number().over(inside) - 1)
        .withColumn(before, F.col("__weight_before")
                    + F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(w))
        .drop(w, bucket, "__g", "__b", "__rows_before", "__weight_before")
    )
