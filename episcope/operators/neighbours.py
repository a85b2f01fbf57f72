"""Exact nearest neighbours and the oversampling that builds on them.

Equal vectors are compared once. Points are assigned to the nearest of a fixed number of pivots. From the pivot distances
alone every query gets a radius that surely holds enough points, and the triangle inequality rules out the cells it cannot
reach. What remains is compared block by block; blocks and query batches have a bounded size, so no task ever holds a whole
cell or class, and only the best per block leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.expr import hashed_unit
from episcope.operators.joins import enrich
from episcope.operators.ordered import positions
from episcope.session import durable


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray, pairs: int = 100_000) -> np.ndarray:
    """Euclidean distances by products; where these cancel (points close together, far from the origin) by differences."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    sq = norms - 2.0 * a @ b.T
    row, col = np.nonzero(sq < 1e-6 * norms)
    for at in range(0, len(row), pairs):
        i, j = row[at:at + pairs], col[at:at + pairs]
        sq[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(np.maximum(sq, 0.0))


def _offer(batches: Iterator[pd.DataFrame], centre: np.ndarray, far: np.ndarray, near: np.ndarray, size: np.ndarray,
           inside: np.ndarray, need: int) -> Iterator[pd.DataFrame]:
    """The blocks that each query may have to look at; ``inside`` says which cells have points in which block."""
    for b in batches:
        d = _distances(_matrix(b["vec"]), centre)
        upper, lower = d + far, np.maximum(d - far, near - d)
        order = upper.argsort(1)
        filled = np.take_along_axis(np.broadcast_to(size, d.shape), order, 1).cumsum(1) >= need
        first = np.where(filled.any(1), filled.argmax(1), d.shape[1] - 1)
        radius = np.take_along_axis(upper, np.take_along_axis(order, first[:, None], 1), 1)
        met = (lower <= radius).astype("float32") @ inside > 0
        yield pd.DataFrame({"q": b["q"], "vec": b["vec"], "blk": [np.flatnonzero(r).astype("int32") for r in met]})


def _smallest(row: np.ndarray, col: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Where the k smallest distances of each row are, ties to the smaller column, ordered by row."""
    order = np.lexsort((col, dist, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


def _nearest(queries: np.ndarray, points: np.ndarray, k: int, rows: int = 256, cols: int = 2048,
             pairs: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance (nine digits) of the k nearest points of each query, ties to the smaller column.

    Squares from products only pass over points that are too far even with the largest error of the product; the others are
    compared by differences in double precision. The matrix of one step has ``rows * cols`` entries. Vectors that are not
    finite take no part.
    """
    fine = [np.flatnonzero(np.isfinite(m).all(1)) for m in (queries, points)]
    if len(fine[0]) < len(queries) or len(fine[1]) < len(points):
        row, col, dist = _nearest(queries[fine[0]], points[fine[1]], k, rows, cols, pairs)
        return fine[0][row], fine[1][col], dist
    if not len(queries) or not len(points):
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
    middle = points.mean(0)  # norms and with them the errors are small around it
    q, p = queries - middle, points - middle
    q_sq, p_sq = (q * q).sum(1), (p * p).sum(1)
    single = q_sq.max() + p_sq.max() < 1e30
    kind = np.float32 if single else np.float64
    error = 8.0 * (points.shape[1] + 4) * np.finfo(kind).eps
    # The product of (-2 q, 1, |q|^2) and (p, |p|^2, 1) is the squared distance.
    left = np.column_stack([-2.0 * q, np.ones(len(q)), q_sq]).astype(kind)
    right = np.column_stack([p, p_sq, np.ones(len(p))]).astype(kind)
    above = lambda d, slack: np.nextafter(((d + 2e-9) ** 2 + slack).astype(kind), kind(np.inf))
    out = []
    for lo in range(0, len(queries), rows):
        mine, some = queries[lo:lo + rows], left[lo:lo + rows]
        row, col, dist = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        limit = np.full(len(mine), np.inf)  # the k-th distance so far
        for at in range(0, len(points), cols):
            sq = some @ right[at:at + cols].T
            slack = error * (q_sq[lo:lo + rows] + p_sq[at:at + cols].max()) + 1e-30
            bar = above(limit, slack)
            start = np.flatnonzero(np.isinf(limit))
            if len(start) and sq.shape[1] > k:
                kth = np.partition(sq[start], k - 1, 1)[:, k - 1].astype("float64")
                bar[start] = above(np.sqrt(np.maximum(kth + slack[start], 0.0)), slack[start])
            i, j = np.divmod(np.flatnonzero(sq <= bar[:, None]), sq.shape[1])
            if not len(i):
                continue
            near = points[at:at + cols]
            d = np.concatenate([np.sqrt(((mine[i[x:x + pairs]] - near[j[x:x + pairs]]) ** 2).sum(1)) for x in range(0, len(i), pairs)])
            row, col, dist = np.r_[row, i], np.r_[col, j + at], np.r_[dist, np.round(d, 9)]
            keep = _smallest(row, col, dist, k)
            row, col, dist = row[keep], col[keep], dist[keep]
            last = np.flatnonzero(np.bincount(row, minlength=len(mine)) >= k)
            limit[last] = dist[np.searchsorted(row, last, "right") - 1]
        out.append((row + lo, col, dist))
    return tuple(np.concatenate(x) for x in zip(*out))


def _layout(size: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share a block, large ones are cut into several."""
    first, count, at, used = [], [], 0, 0
    for n in size:
        if used and used + n > block:
            at, used = at + 1, 0
        first.append(at)
        count.append(max(1, math.ceil(n / block)))
        if n > block:
            at += count[-1]
        else:
            used += n
    return np.array(first), np.array(count)


#: Blocks to a side at least, so that a small search is spread too, and the rows below which a block is not cut for that.
SIDE, SMALL = 6, 1024


def _nearest_distinct(queries: DataFrame, points: DataFrame, k: int, n_pivots: int, block: int) -> DataFrame:
    """The k nearest of distinct vectors: ``queries`` has ``q, vec``, ``points`` has ``p, id, vec``; ties go to the smaller
    id. Columns ``q, p, id, dist``. Both frames are read several times."""
    n, n_queries = points.count(), queries.count()
    pivots = _matrix(points.orderBy(F.xxhash64("id"), "id").limit(n_pivots).toPandas()["vec"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = _distances(_matrix(b["vec"]), pivots)
            yield b.assign(cell=d.argmin(1).astype("int32"), reach=d.min(1))

    # A little slack on radii keeps rounding from ever excluding a true neighbour.
    placed = durable(points.select("p", "id", "vec").mapInPandas(
        assign, "p long, id long, vec array<double>, cell int, reach double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("far"),
                                       F.min("reach").alias("near")).orderBy("cell").toPandas()
    ids, size = cells["cell"].to_numpy(), cells["n"].to_numpy()
    centre = pivots[ids]
    far, near = cells["far"].to_numpy() * (1 + 1e-9) + 1e-6, cells["near"].to_numpy() * (1 - 1e-9) - 1e-6
    first, count = _layout(size, min(block, max(SMALL, math.ceil(n / SIDE))))
    blocks = int((first + count).max())
    inside = np.zeros((len(ids), blocks), "float32")
    for c, (a, m) in enumerate(zip(first, count)):
        inside[c, a:a + m] = 1
    batches_n = max(1, math.ceil(n_queries / min(block, max(SMALL, math.ceil(n_queries / SIDE)))))

    asked = queries.select("q", "vec").mapInPandas(
        lambda batches: _offer(batches, centre, far, near, size, inside, k), "q long, vec array<double>, blk array<int>")
    asked = asked.select("q", "vec", F.explode("blk").alias("blk"), F.pmod(F.xxhash64("q"), F.lit(batches_n)).cast("int").alias("batch"))
    lookup = lambda v: F.create_map(*[F.lit(int(x)) for kv in zip(ids, v) for x in kv])
    own = F.element_at(lookup(first), F.col("cell")) + F.pmod(F.xxhash64("p", F.lit(1)), F.element_at(lookup(count), F.col("cell")))
    offered = placed.select("p", "id", "vec", own.cast("int").alias("blk"),
                            F.explode(F.sequence(F.lit(0), F.lit(batches_n - 1))).alias("batch"))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"q": [], "p": [], "id": [], "dist": []})
        p = p.sort_values("id", kind="stable")
        row, col, dist = _nearest(_matrix(q["vec"]), _matrix(p["vec"]), min(k, len(p)))
        return pd.DataFrame({"q": q["q"].to_numpy()[row], "p": p["p"].to_numpy()[col], "id": p["id"].to_numpy()[col], "dist": dist})

    # The work of a pair of blocks is not in its bytes: as many tasks as pairs, which adaptive planning leaves alone.
    keys, parts = ["blk", "batch"], min(blocks * batches_n, 4096)
    found = asked.repartition(parts, *keys).groupBy(*keys).cogroup(offered.repartition(parts, *keys).groupBy(*keys)).applyInPandas(
        best, "q long, p long, id long, dist double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))  # k rows per block met
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def nearest_neighbours(queries: DataFrame, points: DataFrame, k: int, n_pivots: int = 64, block: int = 32768) -> DataFrame:
    """The k nearest points of every query, itself left out: columns ``qid, rank, pid, dist``.

    Both frames have a unique ``id`` (long) and a ``vec`` (array of doubles). Ties go to the smaller id. The result is
    exact; the work shrinks with how well the cells separate the data and with the number of equal vectors. Among distinct
    vectors without structure it stays quadratic, in tasks of ``block`` queries and ``block`` points at most.
    """
    if points.isEmpty() or queries.isEmpty():
        return points.sparkSession.createDataFrame([], "qid long, rank int, pid long, dist double")
    need = k + 1  # the query itself is among them
    # Equal vectors: the smallest ids are all that can be among the nearest.
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    copies = points.groupBy("id", "vec").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank).where(F.col("rank") <= need)
    held = durable(copies.groupBy("vec").agg(F.min("id").alias("id"), F.array_sort(F.collect_list(F.struct("id", "n"))).alias("own"))
                   .withColumn("p", F.monotonically_increasing_id()))
    vectors = durable(queries.select("vec").distinct().withColumn("q", F.monotonically_increasing_id()))
    # A vector that is not among the nearest by distance and smallest id has k other points before all of its own.
    found = durable(_nearest_distinct(vectors, held, need, n_pivots, block))
    met = enrich(found.select("q", "p", "dist"), held.select("p", "own"), "p").select("q", "dist", F.explode("own").alias("o"))
    order = F.row_number().over(Window.partitionBy("q").orderBy("dist", "o.id"))  # k + 1 times k + 1 rows
    met = met.withColumn("rank", order).where(F.col("rank") <= need).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("dist", F.col("o.id").alias("pid"), "o.n"))).alias("near"))
    lists = durable(met.join(vectors, "q").select("vec", "near"))
    others = F.filter("near", lambda x: F.coalesce(x["pid"] != F.col("id"), F.lit(True)))
    # A point that is given several times counts as often.
    each = F.flatten(F.transform(others, lambda x: F.array_repeat(x, F.least(x["n"], F.lit(k)).cast("int"))))
    rows = enrich(queries.select("id", "vec"), lists, "vec", "inner").select(
        F.col("id").alias("qid"), F.explode(F.slice(each, 1, k)).alias("x")).select("qid", "x.pid", "x.dist")
    final = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "pid"))  # k rows to a query
    return rows.withColumn("rank", final).where(F.col("rank") <= k).select("qid", "rank", "pid", "dist")


def _class_sizes(df: DataFrame, label: str, minority) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == minority), F.count_if(F.col(label) != minority)).first()
    return row[0], row[1]


def _copies(df: DataFrame, key: str, total: int, count: int, seed: int) -> DataFrame:
    """Spread ``total`` copies over ``count`` rows as evenly as possible; the remainder goes by hash order."""
    each, rest = divmod(total, count)
    drawn = positions(df.withColumn("__h", hashed_unit(seed, key)), [], "__h", "__pos", tie=[key])
    times = F.lit(each) + F.when(F.col("__pos") <= rest, 1).otherwise(0)
    return drawn.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("__h", "__pos")


def oversample(df: DataFrame, key: str, label: str, ratio: float, seed: int, minority=1) -> DataFrame:
    """Repeat minority rows until they are ``ratio`` times the majority."""
    few, many = _class_sizes(df, label, minority)
    extra = int(ratio * many) - few
    if extra <= 0 or few == 0:
        return df
    again = _copies(df.where(F.col(label) == minority), key, extra, few, seed).drop("copy")
    return df.unionByName(again)


def smote(df: DataFrame, key: str, label: str, features: str, ratio: float, k: int = 5, seed: int = 42, minority=1,
          borderline: bool = False, m: int = 10) -> DataFrame:
    """Add synthetic minority rows between a minority row and one of its k nearest minority rows.

    Every base row gets the same number of synthetic rows (one more for a hashed remainder). ``borderline`` uses as
    base only rows of which at least half, but not all, of the ``m`` nearest rows of any class are majority rows.
    Columns: the key (null for synthetic rows), the label, and the feature array.
    """
    real = df.select(F.col(key).cast("long").alias(key), label, F.col(features).cast("array<double>").alias(features))
    few, many = _class_sizes(real, label, minority)
    extra = int(ratio * many) - few
    if extra <= 0 or few < 2:
        return real
    rare = durable(real.where(F.col(label) == minority).select(F.col(key).alias("id"), F.col(features).alias("vec")))
    base = rare
    if borderline:
        everyone = real.select(F.col(key).alias("id"), F.col(features).alias("vec"))
        around = nearest_neighbours(rare, everyone, m)
        labelled = enrich(around, real.select(F.col(key).alias("pid"), (F.col(label) != minority).alias("other")), "pid")
        danger = labelled.groupBy(F.col("qid").alias("id")).agg(F.count_if("other").alias("others"), F.count(F.lit(1)).alias("n"))
        danger = danger.where((F.col("others") * 2 >= F.col("n")) & (F.col("others") < F.col("n")))
        base = rare.join(danger.select("id"), "id", "left_semi")
    neighbours = durable(nearest_neighbours(base, rare, k))
    met = neighbours.groupBy(F.col("qid").alias("id")).agg(F.max("rank").alias("n_near"))
    base = durable(base.join(met, "id"))
    n_base = base.count()
    if n_base == 0:
        return real
    plan = _copies(base, "id", extra, n_base, seed)
    plan = plan.withColumn("rank", (F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.col("n_near")) + 1).cast("int"))
    chosen = plan.join(neighbours.select(F.col("qid").alias("id"), "rank", "pid"), ["id", "rank"])
    pairs = enrich(chosen, rare.select(F.col("id").alias("pid"), F.col("vec").alias("other")), "pid")
    u = hashed_unit(seed + 1, "id", "copy")
    made = pairs.withColumn("u", u).select(
        F.lit(None).cast("long").alias(key), F.lit(minority).cast(dict(real.dtypes)[label]).alias(label),
        F.zip_with("vec", "other", lambda a, b: a + F.col("u") * (b - a)).alias(features))
    return real.unionByName(made)


RESAMPLERS: Sequence[str] = ("none", "oversample", "smote", "borderline")


def resample(df: DataFrame, method: str, key: str, label: str, features: str, ratio: float, seed: int) -> DataFrame:
    if method == "none":
        return df
    if method == "oversample":
        return oversample(df, key, label, ratio, seed)
    return smote(df, key, label, features, ratio, seed=seed, borderline=method == "borderline")
