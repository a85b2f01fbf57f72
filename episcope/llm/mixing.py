"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.llm.common import free_name, numbered, with_running
from episcope.session import durable

OTHER = "*"
MAX_PERIOD = 100_000
#: A file of the mix holds about so many bytes of text at most.
PART_BYTES = 128 << 20


def period_slots(weights: dict[str, int]) -> dict[str, list[int]]:
    """One period of the schedule: the slots that each source's blocks get, for integer weights that sum to the period.

    Block j (from 0) of a source with weight p is released at floor(j Q / p) and due by ceil((j + 1) Q / p). In each slot
    the released block with the earliest deadline goes first, ties by source name. All blocks keep their deadlines, so
    after t slots a source has had less than one block more or less than t p / Q. Lags are zero at the period's end and the
    schedule repeats.
    """
    period = sum(weights.values())
    if any(w <= 0 for w in weights.values()) or not 0 < period <= MAX_PERIOD:
        raise ValueError(f"weights are positive whole numbers that sum to {MAX_PERIOD} at most")
    releases = [(0, name, 0) for name in weights]
    heapq.heapify(releases)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {name: [] for name in weights}
    for slot in range(period):
        while releases and releases[0][0] <= slot:
            _, name, j = heapq.heappop(releases)
            heapq.heappush(ready, (-(-(j + 1) * period // weights[name]), name, j))
        due, name, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        slots[name].append(slot)
        if j + 1 < weights[name]:
            heapq.heappush(releases, ((j + 1) * period // weights[name], name, j + 1))
    return slots


def mix(df: DataFrame, weights: dict[str, int], block_bytes: int, source: str = "source", doc_id: str = "doc_id",
        text: str = "text", size: Column | None = None) -> DataFrame:
    """All rows with their place in the mix: ``mix_source``, ``size``, ``start`` (bytes of the source before the row),
    ``block``, ``release``, ``deadline``, ``slot`` and ``position`` (the block's rank in the mix, from 0).

    Weights are shares of bytes, in whole numbers. Each source is cut into blocks of ``block_bytes``; a row belongs to
    the block it starts in. Sources without a weight and null sources form one source ``*``, which needs a weight when
    there are such rows. When a source runs out, its slots fall away and the rest keep their weights to each other; no
    row is dropped or repeated. Inside a source rows come in hash order of id, size and text. Sizes are the text's UTF-8
    bytes, at least 1 (null and empty texts too). Added columns that clash with the frame's are the caller's to avoid.
    """
    if OTHER not in weights:
        weights = {**weights, OTHER: 1}
    period, slots = sum(weights.values()), period_slots(weights)
    names = sorted(weights)
    col = F.col(f"`{source}`")
    named = F.when(col.isin([n for n in names if n != OTHER]), col).otherwise(F.lit(OTHER))
    weight = F.greatest(F.coalesce(size if size is not None else F.octet_length(text), F.lit(0)), F.lit(1)).cast("long")
    rows = df.withColumn("mix_source", named).withColumn("size", weight)
    index = free_name(rows, "__index")
    ties = [F.col(f"`{doc_id}`"), F.col("size"), F.xxhash64(text)]
    placed = with_running(rows, "mix_source", ties, F.col("size"), index, "start").drop(index)

    # A row per named source: how many blocks it has. A source whose last rows start in block b has b + 1 blocks.
    totals = {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.sum("size").alias("n")).collect()}
    blocks = [-(-totals.get(n, 0) // block_bytes) for n in names]
    spark = df.sparkSession
    of_source = spark.createDataFrame([(n, weights[n], slots[n]) for n in names], "mix_source string, p long, slots array<long>")
    earlier, count = [], dict.fromkeys(names, 0)
    owner = {s: n for n, own in slots.items() for s in own}
    for s in range(period):
        earlier.append((s, [count[n] for n in names]))
        count[owner[s]] += 1
    at_slot = spark.createDataFrame(earlier, "in_period long, earlier array<long>")
    shares = F.array(*[F.lit(weights[n]).cast("long") for n in names])
    most = F.array(*[F.lit(b).cast("long") for b in blocks])
    q = F.lit(period).cast("long")
    cycle, j = F.floor(F.col("block") / F.col("p")), F.col("block") % F.col("p")
    full = F.zip_with(F.col("earlier"), shares, lambda e, p: F.floor(F.col("slot") / q) * p + e)
    before = F.aggregate(F.zip_with(full, most, lambda e, m: F.least(e, m)), F.lit(0).cast("long"), lambda a, b: a + b)
    return (
        placed.withColumn("block", F.floor(F.col("start") / F.lit(block_bytes)))
        .join(F.broadcast(of_source), "mix_source")  # at most MAX_PERIOD slots in all
        .withColumn("release", cycle * q + F.floor(j * q / F.col("p")))
        .withColumn("deadline", cycle * q + F.ceil((j + 1) * q / F.col("p")))
        .withColumn("in_period", F.element_at("slots", (j + 1).cast("int")))
        .withColumn("slot", cycle * q + F.col("in_period"))
        .drop("slots", "p")
        .join(F.broadcast(at_slot), "in_period")  # at most MAX_PERIOD rows of a count per source
        .withColumn("position", before)
        .drop("in_period", "earlier")
    )


def mixed(df: DataFrame, weights: dict[str, int], block_bytes: int, source: str = "source", doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """The rows in the order of the mix: sorted ranges of positions, so files written from them hold the mix in turn.

    Places are found on narrow rows (number, source, id, size and hash of the text). The rows themselves are shuffled twice:
    once to meet their place, once to the partition that holds it; a partition takes a range of whole blocks.
    """
    row, body = free_name(df, "__row"), F.col(f"`{text}`")
    rows = numbered(df, row)
    narrow = durable(rows.select(F.col(row).alias("row__"), F.col(f"`{source}`").alias("source__"), F.col(f"`{doc_id}`").alias("id__"),
                                 F.octet_length(body).alias("bytes__"), F.hex(F.xxhash64(body)).alias("hash__")))
    placed = mix(narrow, weights, block_bytes, "source__", "id__", "hash__", F.col("bytes__"))
    placed = durable(placed.select(F.col("row__").alias(row), F.col("position").alias("position__"), F.col("start").alias("start__")))
    blocks = (placed.agg(F.max("position__")).head()[0] or 0) + 1
    total = blocks * block_bytes
    parts = max(1, min(blocks, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))))
    part = F.floor(F.col("position__") * parts / blocks).cast("int")
    return (rows.join(placed, row).repartitionById(parts, part).sortWithinPartitions("position__", "start__")
            .select(*[F.col(f"`{c}`") for c in df.columns]))


def ranked_as_stored(df: DataFrame, name: str = "mix_rank") -> DataFrame:
    """The rows with their number from 0 in the order in which ``mixed`` wrote them: by file and place in the file. A
    frame that is not read straight from Parquet files is numbered in its own order."""
    return numbered(df, name)
