"""Isolation forest: trees are grown in parallel on small hashed samples, rows are scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import hashed_unit
from episcope.operators.ordered import positions, quantiles
from episcope.session import durable

SAMPLE = 256
TREE_SCHEMA = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """One random tree as parallel node lists; leaves carry their expected path length."""
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    feature, cut, left, right, length = [], [], [], [], []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        low, high = x[rows].min(0), x[rows].max(0)
        open_features = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or len(open_features) == 0
        f = -1 if leaf else int(rng.choice(open_features))
        c = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
        for column, v in zip((feature, cut, left, right, length),
                             (f, c, -1, -1, depth + average_path(len(rows)) if leaf else 0.0)):
            column.append(v)
        if not leaf:
            goes_left = x[rows, f] <= c
            todo.append((rows[goes_left], depth + 1, node, False))
            todo.append((rows[~goes_left], depth + 1, node, True))
    return feature, cut, left, right, length


@dataclass
class Forest:
    """Node arrays per tree. Its size is trees x nodes of a 256-row tree, whatever the size of the data."""

    features: list[str]
    sample: int
    trees: list[tuple[np.ndarray, ...]]


def fit_forest(train: DataFrame, key: str, features: Sequence[str], n_trees: int = 500, seed: int = 88,
               sample: int = SAMPLE) -> Forest:
    """Grow the trees, one task group per tree with ``sample`` rows each (all rows, if there are fewer).

    A tree draws hash-order numbers without replacement, so the sample is the same on any cluster.
    """
    cols = list(features)
    rows = train.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    n = rows.count()
    if n == 0:
        raise ValueError("no complete training rows")
    # A hashed pool of a few times the rows the trees need; only the pool is numbered, the table is just read.
    pool = durable(rows.where(hashed_unit(seed, key) < F.lit(min(1.0, max(4.0 * n_trees * sample, 10_000.0) / n))))
    size = pool.count()
    per_tree = min(size, sample)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tree in frame["id"]:
                drawn = np.random.default_rng([seed, int(tree), 1]).choice(size, per_tree, replace=False)
                yield pd.DataFrame({"tree": int(tree), "pos": drawn + 1})

    drawn = rows.sparkSession.range(n_trees).mapInPandas(draw, "tree int, pos long")
    numbered = positions(pool.withColumn("__h", hashed_unit(seed + 1, key)), [], "__h", "pos", tie=[key])
    sampled = numbered.join(F.broadcast(drawn), "pos")  # trees x sample rows

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(key)[cols].to_numpy()
        f, c, le, ri, ln = _grow(x, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [f], "cut": [c], "left": [le], "right": [ri], "length": [ln]})

    grown = sampled.groupBy("tree").applyInPandas(build, TREE_SCHEMA).toPandas().sort_values("tree")
    trees = [tuple(np.asarray(r[c]) for c in ("feature", "cut", "left", "right", "length")) for _, r in grown.iterrows()]
    return Forest(cols, per_tree, trees)


def score_forest(df: DataFrame, forest: Forest, out: str = "anomaly_score") -> DataFrame:
    """Score in (-1, 0); the lower, the easier a row is to isolate. Rows with missing features have no score."""
    trees, scale = df.sparkSession.sparkContext.broadcast(forest.trees), average_path(forest.sample)
    width = max(len(t[0]) for t in forest.trees)

    @F.pandas_udf("double")
    def path(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype="float64", na_value=np.nan) for s in batch])
            total = np.zeros(len(x))
            row = np.arange(len(x))
            for feature, cut, left, right, length in trees.value:
                node = np.zeros(len(x), dtype="int64")
                for _ in range(width):
                    f = feature[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[row, np.maximum(f, 0)] <= cut[node]
                    node = np.where(inner, np.where(go_left, left[node], right[node]), node)
                total += length[node]
            score = -np.power(2.0, -total / len(trees.value) / scale) if scale else np.full(len(x), -1.0)
            yield pd.Series(np.where(np.isnan(x).any(1), np.nan, score))

    value = path(*[F.col(c).cast("double") for c in forest.features])
    return df.withColumn(out, value).withColumn(out, F.when(~F.isnan(out), F.col(out)))


def contamination_cuts(train_scores: DataFrame, levels: Sequence[float], score: str = "anomaly_score") -> DataFrame:
    """One row: the training-score quantile of every contamination level. The scores are written out, not recomputed."""
    return quantiles(durable(train_scores.select(score)), [], score, {f"c{i}": c for i, c in enumerate(levels)})


def isolation_forest(train: DataFrame, df: DataFrame, key: str, features: Sequence[str], n_trees: int = 500,
                     contamination: float = 0.10, seed: int = 88) -> DataFrame:
    """Scores for all rows from trees grown on the baseline rows, with the anomaly flag at one contamination level."""
    forest = fit_forest(train, key, features, n_trees, seed)
    cut = contamination_cuts(score_forest(train, forest), [contamination]).scalar()
    return score_forest(df, forest).withColumn("anomaly", F.col("anomaly_score") < cut)


def contamination_sweep(train: DataFrame, df: DataFrame, key: str, features: Sequence[str],
                        levels: Sequence[float] = (0.05, 0.10, 0.15), n_trees: int = 500, seed: int = 88,
                        excluded: Sequence[str] = ()) -> DataFrame:
    """Flags at several contamination levels, one forest for all, and whether a row is flagged at every level.

    Excluded keys get a row that says so.
    """
    forest = fit_forest(train, key, features, n_trees, seed)
    cuts = contamination_cuts(score_forest(train, forest), levels)
    rows = score_forest(df, forest).select(key, "anomaly_score")
    names = [f"flag_{int(round(c * 100)):02d}" for c in levels]
    flags = [F.when(F.col("anomaly_score") < cuts.select(f"c{i}").scalar(), "Anomaly").otherwise("Normal").alias(n)
             for i, n in enumerate(names)]
    table = rows.select(key, "anomaly_score", *flags)
    every = F.lit(True)
    for n in names:
        every = every & (F.col(n) == "Anomaly")
    table = table.withColumn("robust_anomaly", F.when(every, "Yes").otherwise("No"))
    if not excluded:
        return table
    notes = df.sparkSession.createDataFrame([(e,) for e in excluded], f"{key} string").select(
        key, F.lit(None).cast("double").alias("anomaly_score"), *[F.lit("EXCLUDED").alias(n) for n in names],
        F.lit("N/A").alias("robust_anomaly"))
    return table.withColumn(key, F.col(key).cast("string")).unionByName(notes)
