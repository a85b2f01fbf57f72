"""Sharding by a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.llm.common import free_name, numbered, small_side, with_running
from episcope.session import durable

UNIT = 1 << 48
BINS = 1 << 12
#: A median is settled when what lies in the bin it falls into is at most this share of a leaf.
TOLERANCE = 0.002
#: A group of equal texts above this share of a leaf is split between leaves, row by row.
HEAVY = 0.01
ADDED = ["size", "text_crc32", "shard", "slot"]


def text_coordinate(c: Column) -> Column:
    """The first six UTF-8 bytes as a number below 2^48, which keeps the order of strings; null is 0."""
    six = F.rpad(F.substring(F.hex(F.coalesce(c.cast("string"), F.lit(""))), 1, 12), 12, "0")
    return F.conv(six, 16, 10).cast("long")


def number_coordinate(c: Column) -> Column:
    """A non-negative number on a logarithmic scale below 2^48; null is 0."""
    return F.least(F.floor(F.log2(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * (UNIT >> 6)),
                   F.lit(UNIT - 1)).cast("long")


def _by_node(rows: dict[int, dict], leaves: int, fields: str) -> Column:
    """What the driver knows of a point's node, as a constant array over the node numbers (at most one per leaf)."""
    entries = [rows.get(n) for n in range(leaves)]
    return F.element_at(F.from_json(F.lit(json.dumps(entries)), f"array<struct<{fields}>>"), F.col("node") + 1)


def _descend(points: DataFrame, cuts: dict[int, dict], leaves: int) -> DataFrame:
    """Points of split nodes move to the left or right child; a node is named by the number of its first leaf."""
    cut = _by_node(cuts, leaves, "axis:int,at:long,edge:long,right:int")
    c = F.element_at("coords", F.col("__cut.axis") + 1)
    left = (c < F.col("__cut.at")) | ((c == F.col("__cut.at")) & (F.col("tie") <= F.col("__cut.edge")))
    return (points.withColumn("__cut", cut)
            .withColumn("node", F.when(F.col("__cut").isNull() | left, F.col("node")).otherwise(F.col("__cut.right")))
            .drop("__cut"))


def _spans(points: DataFrame, dims: int) -> list[int]:
    """The whole table's span of each dimension, at least 1."""
    c = lambda d: F.element_at("coords", d + 1)
    return [max(1, x) for x in points.agg(*[(F.max(c(d)) - F.min(c(d))).alias(f"s{d}") for d in range(dims)]).head()]


def _medians(points: DataFrame, nodes: dict[int, int], dims: int, leaves: int, leaf: float, whole: list[int]) -> dict[int, dict]:
    """For each node of more than one leaf the axis (whose span is the largest part of the ``whole`` one) and the cut: points below ``at`` on the axis go left, those at it go
    left up to the tie value ``edge``; ``right`` is the first leaf of the right side.

    All nodes of a level are settled together. A histogram of 4096 bins per node finds the bin that the weighted median
    falls into, which is refined until one coordinate is left, or until it holds next to nothing; points with that very
    coordinate are cut by their tie value in the same way. The driver gets one row per node from each pass.
    """
    here = points.withColumn("leaves", F.element_at(
        F.from_json(F.lit(json.dumps([nodes.get(n, 0) for n in range(leaves)])), "array<int>"), F.col("node") + 1)).where("leaves > 1")
    coord = lambda d: F.element_at("coords", d + 1)
    spans = here.groupBy("node").agg(F.sum("weight").alias("w"), *[x for d in range(dims) for x in (
        F.min(coord(d)).alias(f"lo{d}"), F.max(coord(d)).alias(f"hi{d}"))]).collect()
    state, cuts = {}, {}
    for r in spans:
        axis = max(range(dims), key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / whole[d], -d))
        left = nodes[r["node"]] // 2
        state[r["node"]] = {"axis": axis, "want": float(r["w"]) * left / nodes[r["node"]], "lo": r[f"lo{axis}"],
                            "hi": r[f"hi{axis}"], "at": None, "right": r["node"] + left}
    while state:
        for s in state.values():
            s["step"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BINS))
        asked = _by_node(state, leaves, "axis:int,at:long,lo:long,hi:long,step:long,want:double")
        value = F.element_at("coords", F.col("s.axis") + 1)
        value = F.when(F.col("s.at").isNull(), value).when(value == F.col("s.at"), F.col("tie"))
        sums = (here.withColumn("s", asked).where("s is not null").withColumn("value", value)
                .where("value between s.lo and s.hi")
                .groupBy("node", F.col("s.want").alias("want"), F.expr("(value - s.lo) div s.step").alias("bin"))
                .agg(F.sum("weight").alias("w"), F.min("value").alias("lo"), F.max("value").alias("hi")))
        upto = Window.partitionBy("node").orderBy("bin")  # at most BINS rows
        # The bound of a sum of doubles may miss the last bin by a rounding; there the last bin counts.
        found = (sums.withColumn("upto", F.sum("w").over(upto)).withColumn("enough", F.col("upto") >= F.col("want"))
                 .groupBy("node").agg(F.min(F.when(F.col("enough"), F.struct("bin", "w", "upto", "lo", "hi"))).alias("f"),
                                      F.max(F.struct("bin", "w", "upto", "lo", "hi")).alias("l"))
                 .select("node", F.coalesce("f", "l").alias("f")).select("node", "f.*").collect())
        for r in found:
            n, w = r["node"], r["w"]
            s, lo, hi = state[n], r["lo"], r["hi"]  # the values that do occur in the bin
            s["want"] -= r["upto"] - w
            if w <= TOLERANCE * leaf or (s["at"] is not None and lo == hi):
                edge = hi if 2 * s["want"] >= w else lo - 1  # the nearer border of the bin
                # Without ties to cut, every point up to the edge goes left: the next coordinate and no tie value.
                at, edge = (s["at"], edge) if s["at"] is not None else (edge + 1, -1)
                cuts[n] = {"axis": s["axis"], "at": at, "edge": edge, "right": s["right"]}
                del state[n]
            elif lo == hi:
                s.update(at=lo, lo=0, hi=UNIT - 1)
            else:
                s.update(lo=lo, hi=hi)
    return cuts


def shard_table(df: DataFrame, carry: list[str], coordinates: list[Column], size: Column, shards: int | None = None,
                target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", order: str | None = None,
                heavy: float = HEAVY) -> DataFrame:
    """The carried columns of all rows with ``size``, ``text_crc32``, ``shard`` (leaves from left to right) and ``slot``
    (gapless from 0 within the shard, in hash order or in that of the column ``order``, which numbers all rows from 0). Give
    the number of shards, or the bytes a leaf should reach.

    Nodes split along the dimension that is widest in terms of the whole table's span of it, at the weighted median (or at
    the share of leaves that the left side takes), until each leaf has its bytes. Points are groups of equal texts, which
    stay together under the metadata of their smallest id; a group above the share ``heavy`` of a leaf is cut between leaves
    row by row instead, so copies of one text cannot overload a shard. Null texts count as empty; null metadata lies at the
    low end; rows with null or repeated ids are rows like others. An empty table gives an empty result; with too few texts
    some shards stay empty. The four added columns replace carried ones of the same name. Texts are read once, for their
    size and hashes, and never shuffled.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    dims = len(coordinates)
    held = [c for c in carry if c.lower() not in ADDED]
    # Carried columns travel in one struct: their names cannot clash with those used here.
    rows = durable(df.select(
        F.struct(*[F.col(f"`{c}`") for c in held], F.lit(0).alias(free_name(df, "__one"))).alias("row"),
        F.col(f"`{order}`").alias("rank") if order else F.lit(None).cast("long").alias("rank"),
        size.cast("long").alias("weight"), F.crc32(body).alias("crc"), F.col(f"`{doc_id}`").alias("id"),
        F.array(*coordinates).alias("own_coords"),
        F.struct(F.xxhash64(body), F.hash(body), F.length(body)).alias("g")))  # two hashes and the length name a text
    groups = durable(rows.groupBy("g").agg(
        F.sum("weight").alias("gw"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct(F.col("id").isNull(), "id", "own_coords"))["own_coords"].alias("coords")))
    found = groups.agg(F.sum("gw").alias("w"), F.sum("copies").alias("n")).head()
    total, n = found["w"] or 0, found["n"] or 0
    leaves = shards if shards is not None else max(1, math.ceil(total / target_bytes))
    leaf = total / leaves
    cut_up = (F.col("copies") > 1) & (F.col("gw") > F.lit(heavy * leaf))
    tie = F.shiftrightunsigned(F.when(cut_up, F.xxhash64("g", "id")).otherwise(F.xxhash64("g")), 16)

    # Only groups to be cut need their rows; the others are one point each.
    whole = groups.where(~cut_up).select(F.col("gw").alias("weight"), "coords", F.shiftrightunsigned(F.xxhash64("g"), 16).alias("tie"))
    cut = rows.select("g", "weight", "id").join(small_side(durable(groups.where(cut_up))), "g").select("weight", "coords", tie.alias("tie"))
    points = durable(whole.unionByName(cut).withColumn("node", F.lit(0)))
    nodes, levels, spans = {0: leaves}, [], _spans(points, dims) if total else []
    while total and any(k > 1 for k in nodes.values()):
        cuts = _medians(points, nodes, dims, leaves, leaf, spans)
        levels.append(cuts)
        points = durable(_descend(points, cuts, leaves))
        nodes = {k: v for i, own in nodes.items() for k, v in (((i, own // 2), (i + own // 2, own - own // 2)) if own > 1 else ((i, own),))}
    # Groups that hold a hundredth of the rows, fewer than a hundred by arithmetic, meet their rows by broadcast.
    many = F.col("copies") * 100 > F.lit(n)
    hot = groups.where(many)
    apart = F.broadcast(hot.select("g"))
    placed = (rows.join(apart, "g", "left_anti").join(groups.where(~many), "g")
              .unionByName(rows.join(F.broadcast(hot), "g")))
    placed = placed.select("row", "rank", "weight", "crc", "id", "coords", tie.alias("tie"), F.lit(0).alias("node"))
    for cuts in levels:
        placed = _descend(placed, cuts, leaves)
    placed = durable(placed.select("row", "rank", "weight", "crc", F.col("node").alias("shard"), "id"))
    slots = with_running(placed, "shard", [F.col("id"), F.col("crc"), F.col("weight")], F.col("weight"), "slot", "bytes_before",
                         rank=F.col("rank") if order else None)
    return slots.select(*[F.col(f"row.`{c}`") for c in held], F.col("weight").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot")


def kd_shards(df: DataFrame, coordinates: list[Column], size: Column, shards: int | None = None,
              target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", order: str | None = None,
              heavy: float = HEAVY) -> DataFrame:
    """All columns of all rows with the columns of ``shard_table``, which are found on narrow rows; the rows themselves are
    shuffled once, to meet them. ``order`` must number the rows from 0 without gaps, and so names them; without it they are
    numbered as they are stored."""
    row = order or free_name(df, "__row")
    rows = df if order else numbered(df, row)
    placed = shard_table(rows, [row], coordinates, size, shards, target_bytes, doc_id, text, order, heavy)
    held = [c for c in df.columns if c.lower() not in ADDED]
    return (rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*held, row])]).join(durable(placed), row)
            .select(*[F.col(f"`{c}`") for c in held], *ADDED))
