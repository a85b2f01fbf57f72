"""Trees grown in one task against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from episcope.operators import learning, trees
from episcope.session import durable

def tree(**changes):
    return DecisionTreeClassifier(**{"labelCol": "y", "weightCol": "w", "maxDepth": 5, "minInstancesPerNode": 10, "seed": 42, **changes})


def forest(**changes):
    return RandomForestClassifier(**{"labelCol": "y", "weightCol": "w", "numTrees": 12, "maxDepth": 6, "minInstancesPerNode": 4, "seed": 42, **changes})


def boosted(**changes):
    return GBTClassifier(**{"labelCol": "y", "maxIter": 6, "stepSize": 0.05, "maxDepth": 4, "minInstancesPerNode": 5, "subsamplingRate": 0.8,
                            "seed": 42, **changes})


def rows(spark, n, seed=1, levels=None, partitions=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) if levels is None else rng.integers(0, levels, (n, 5)).astype(float)
    x[:, 3] = np.where(rng.random(n) < 0.4, 0.0, x[:, 3])  # a feature with many zeros
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x[:, 0] - x[:, 1] * (x[:, 3] > 0)))).astype(int)
    df = spark.createDataFrame([(int(a), 2.5 if a else 0.75, b) for a, b in zip(y, x.tolist())], "y int, w double, f array<double>")
    return durable(df.select("y", "w", array_to_vector("f").alias("features")).repartition(partitions))


def scores(model, df):
    return np.array([r["score"] for r in learning.scored(model, df).select("score").collect()])


@pytest.mark.parametrize("kind, changes", [
    (tree, {}), (forest, {}), (forest, {"numTrees": 3}), (forest, {"maxMemoryInMB": 0, "numTrees": 5, "maxDepth": 3}), (boosted, {}),
    (boosted, {"subsamplingRate": 1.0}), (boosted, {"featureSubsetStrategy": "0.7", "weightCol": "w", "minInstancesPerNode": 3})])
def test_same_scores_as_spark(spark, kind, changes):
    df, estimator = rows(spark, 900), kind(**changes)
    ours = trees.fit(estimator, df)
    assert isinstance(ours, trees.TreeModel)
    assert scores(ours, df) == pytest.approx(scores(estimator.fit(df), df), rel=1e-9)


def test_memory_groups_of_a_forest(spark):
    """Above Spark's memory bound the nodes of a level are taken in several groups."""
    df, estimator = rows(spark, 900), forest(maxMemoryInMB=1, numTrees=60, minInstancesPerNode=1, maxDepth=8)
    assert scores(trees.fit(estimator, df), df) == pytest.approx(scores(estimator.fit(df), df), rel=1e-9)


@pytest.mark.parametrize("n", [12_000, 30_000])
def test_same_thresholds_as_spark_from_a_sample(spark, n):
    df, estimator = rows(spark, n), tree(seed=7)
    assert scores(trees.fit(estimator, df), df) == pytest.approx(scores(estimator.fit(df), df), rel=1e-9)


def test_two_level_features(spark):
    n, rng = 600, np.random.default_rng(7)
    df = spark.createDataFrame([(i, "abc"[i % 3], float(v), int(v + (i % 3 == 1) > 0.8)) for i, v in enumerate(rng.normal(size=n))], "id int, c string, x double, y int")
    own = learning.prepare(df, learning.preprocessor(categorical=["c"], scaled=["x"]), "id", "y")
    assert trees.binary_slots(own.rows, "features") == [0, 1, 2]
    for estimator in (boosted(), forest(weightCol="balanced_weight")):
        assert scores(trees.fit(estimator, own.rows), own.rows) == pytest.approx(scores(estimator.fit(own.rows), own.rows), rel=1e-9)


def test_a_boosted_fit_is_a_few_jobs(spark):
    df, sc = rows(spark, 400), spark.sparkContext
    sc.setJobGroup("one task", "fit")
    learning.Prepared(learning.PipelineModel(stages=[]), df).fit(boosted(maxIter=30))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("one task")) < 12


def test_many_partitions_are_merged(spark):
    """Equal binned rows are one with their count, and nothing is lost."""
    df = rows(spark, 3000, levels=4, partitions=5)
    for estimator in (tree(), boosted(subsamplingRate=1.0)):
        ours = trees.fit(estimator, df)
        assert isinstance(ours, trees.TreeModel)
        assert scores(ours, df) == pytest.approx(scores(estimator.fit(df), df), rel=1e-6)
    x = df.select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y"), "w")
    merged = trees.merge_binned(x, [np.array([0.5, 1.5, 2.5])] * 5)
    assert merged.agg(F.sum("n")).first()[0] == 3000 and merged.count() == x.distinct().count() < 3000
    for estimator in (forest(numTrees=60), boosted()):  # other draws, the same size of model
        mine, theirs = scores(trees.fit(estimator, df), df), scores(estimator.fit(df), df)
        assert np.abs(mine - theirs).mean() < 0.05 and np.corrcoef(mine, theirs)[0, 1] > 0.95
        assert (mine == scores(trees.fit(estimator, df.repartition(3)), df)).all()


def test_draws_stand_for_all_rows_of_a_kind(spark, monkeypatch):
    """A bootstrap draws as many rows as there are; a share draws that share of them."""
    seen = []
    grow = trees._Grower.grow
    monkeypatch.setattr(trees._Grower, "grow", lambda self, rows, channels, seed: (seen.append([[c.copy() for c in x] for x in channels]), grow(self, rows, channels, seed))[1])
    bins, y, w = np.array([[0, 0, 1, 1]], "uint8"), np.array([0.0, 1, 0, 1]), np.ones(4)
    count = np.array([40_000, 10_000, 10_000, 40_000])
    for kind, share in ((forest, 1.0), (boosted, 0.8)):
        seen.clear()
        trees.fit_arrays(bins, y, w, [np.array([0.5])], trees.spec_of(kind()), count=count)
        drawn = [c[0].sum() for channels in seen for c in channels] if kind is forest else [channels[0][3].sum() for channels in seen]
        assert drawn == pytest.approx([share * 100_000] * len(drawn), rel=0.02) and len(set(drawn)) > 1


def test_too_many_kinds_are_left_to_spark(spark, monkeypatch):
    df = rows(spark, 500, partitions=3)
    monkeypatch.setattr(trees, "KINDS_IN_TASK", 100)
    assert not isinstance(trees.fit(tree(), df), trees.TreeModel)
    assert not isinstance(trees.fit(tree(), df.where("y = 0")), trees.TreeModel)  # one class only
    assert trees.spec_of(tree(impurity="entropy")) is None and trees.spec_of(learning.StringIndexer()) is None


def test_scores_are_kept_apart_when_memory_is_small(spark, monkeypatch):
    monkeypatch.setattr(trees, "REMEMBERED", 10)
    df, model = rows(spark, 900), tree().fit(rows(spark, 900))
    ours = trees.fit(tree(), df)
    assert scores(ours, df) == pytest.approx(scores(model, df), rel=1e-9) and scores(ours, df.where("false")).size == 0


def test_permutation_scores_each_kind_once(spark, monkeypatch):
    """Same importances as from the scores of every row, but equal rows are scored once."""
    n, rng = 1500, np.random.default_rng(3)
    a, b = rng.integers(0, 6, n), rng.integers(0, 4, n)
    y = (rng.random(n) < 0.1 + 0.12 * a).astype(int)
    df = durable(spark.createDataFrame([(i, int(v), float(p), float(q) if q else None) for i, (v, p, q) in enumerate(zip(y, a, b))], "id long, y int, a double, b double"))
    chain = learning.Pipeline(stages=[learning.VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep")]).fit(df)
    model = learning.PipelineModel(stages=[*chain.stages, tree(weightCol="w", minInstancesPerNode=1).fit(
        chain.transform(df.fillna(0.0)).withColumn("w", F.lit(1.0)))])
    whole = learning.scored(model, df).select("y", "score")
    full = learning.metrics.auc(whole, "y", "score").first()["roc_auc"]
    want = {}
    for i, c in enumerate(["a", "b"]):
        ordered = df.withColumn("h", learning.hashed_unit(42 + i, "id")).toPandas().sort_values(["h", "id"])
        moved = ordered[c].shift(1)
        moved.iloc[0] = ordered[c].iloc[0]
        rows = [(int(v), *(None if x != x else float(x) for x in z)) for v, *z in zip(ordered.y, *[moved if k == c else ordered[k] for k in ("a", "b")])]
        mixed = spark.createDataFrame(rows, "y int, a double, b double")
        want[c] = full - learning.metrics.auc(learning.scored(model, mixed), "y", "score").first()["roc_auc"]
    seen, scored = [], learning.scored
    monkeypatch.setattr(learning, "scored", lambda m, d: (seen.append(d.count()), scored(m, d))[1])
    got = {r["feature"]: r["importance"] for r in learning.permutation_importance(model, df, "id", "y", ["a", "b"]).collect()}
    assert got == pytest.approx(want, rel=1e-9) and got["a"] > 0.05
    assert len(seen) == 3 and max(seen) <= 2 * 6 * 4
    kinds = learning.shuffled_kinds(df, "id", ["a", "b"])
    assert [k.agg(F.sum("__n")).first()[0] for k in kinds] == [n] * 3


def test_auc_of_counted_rows(spark):
    df = spark.createDataFrame([(1, 0.9, 3), (0, 0.9, 1), (1, 0.2, 2), (0, 0.1, 5), (None, 0.5, 7)], "y int, s double, n long")
    each = df.select("y", "s", F.explode(F.sequence(F.lit(1), "n")))
    assert learning.metrics.auc(df, "y", "s", count="n").collect() == learning.metrics.auc(each, "y", "s").collect()


def test_evaluation_over_many_partitions_needs_no_job_per_level(spark, monkeypatch):
    """Training rows of several partitions are merged for every model, resampled ones too; metrics count all rows."""
    n, rng = 1200, np.random.default_rng(5)
    a = rng.integers(0, 8, n)
    df = spark.createDataFrame([(i, float(v), int(rng.random() < 0.05 + 0.05 * v)) for i, v in enumerate(a)], "id long, a double, y int")
    split = learning.stratified_split(df, "id", "y", {"train": 0.7, "valid": 0.15, "test": 0.15})
    monkeypatch.setattr(learning, "ROWS_PER_PARTITION", 200)
    for kind in (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier):
        monkeypatch.setattr(kind, "fit", lambda *args: pytest.fail("Spark's own fit runs jobs for every level"))
    models = {"RandomForest": forest(weightCol="balanced_weight"), "GradientBoosting": boosted(), "BoostedWeighted": boosted(weightCol="positive_weight")}
    got = learning.fit_and_eval(split, "split", "id", "y", models, learning.preprocessor(scaled=["a"])).toPandas().set_index(["model", "split"])
    train = split.where("split = 'train'").groupBy("y").count().toPandas().set_index("y")["count"]
    assert len(got) == 9 and (got.roc_auc > 0.6).all()
    assert got.total["BoostedWeighted", "train"] == train.sum() and got.total["RandomForest", "train"] == train[0] + int(0.7 * train[0])
    assert all(got.total[m, "valid"] + got.total[m, "test"] + train.sum() == n for m in models)
