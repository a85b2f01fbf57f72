"""Readers and writers for flat extracts and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BOM = "﻿"


def unique_headers(names: Sequence[str]) -> list[str]:
    """Strip a byte-order mark and number repeated names: ``YEAR, YEAR`` becomes ``YEAR, YEAR.1``."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        name = (name or "").replace(BOM, "")
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, sep: str = ",",
               dates: Mapping[str, str] | None = None, drop_bad_dates: bool = False) -> DataFrame:
    """Read delimited text with a header.

    With a schema the columns are typed by position at the scan. Without one every column is text and the header row
    (one row, read on the driver) names them, repeated names made unique. ``dates`` maps columns to a parse pattern;
    what does not parse becomes null and can be dropped.
    """
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
    if schema is None:
        head = reader.option("header", False).csv(path).first()
        names = unique_headers([str(v) if v is not None else f"_c{i}" for i, v in enumerate(head)])
        raw = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        df = reader.option("header", True).schema(raw).csv(path).toDF(*names)
    else:
        df = reader.option("header", True).schema(schema).csv(path)
    for col, pattern in (dates or {}).items():
        df = df.withColumn(col, F.try_to_timestamp(F.col(col).cast("string"), F.lit(pattern)).cast("date"))
    return df.dropna(subset=list(dates)) if dates and drop_bad_dates else df


def dedupe_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_headers(df.columns))


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def register(df: DataFrame, name: str) -> None:
    """Offer a frame to ``spark.sql`` under ``name``, replacing an older one."""
    df.createOrReplaceTempView(name)


def tagged_union(frames: Mapping[str, DataFrame], tag_col: str) -> DataFrame:
    """Stack frames under one another with a column that names the source."""
    out = None
    for tag, df in frames.items():
        tagged = df.withColumn(tag_col, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = (),
                sep: str = ",") -> None:
    """Write a result table. Text for hand-over, Parquet for intermediates."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("sep", sep).csv(path)
    else:
        writer.format(fmt).save(path)


def write_panels(panels: Mapping[str, DataFrame], root: str, fmt: str = "parquet",
                 partition_by: Sequence[str] = ()) -> None:
    """Write several panels cut from one cleaned frame. Persist that frame first, so it is computed once."""
    for name, df in panels.items():
        write_table(df, f"{root}/{name}", fmt, partition_by)
