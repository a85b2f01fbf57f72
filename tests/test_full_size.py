"""Registered queries run their operators at the published sizes, with every model."""

import inspect

import pytest
from pyspark.ml.classification import DecisionTreeClassifier

import __spark_entry__ as entry
from episcope.operators import anomaly, learning, resample

MODELS = ["DecisionTree", "RandomForest", "GradientBoosting", "BoostedWeighted"]


class Reached(Exception):
    pass


def arguments(monkeypatch, spark, sf, module, function, query):
    """What the query hands to the operator, defaults included."""
    seen, signature = {}, inspect.signature(getattr(module, function))

    def stand_in(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Reached
    monkeypatch.setattr(module, function, stand_in)
    with pytest.raises(Reached):
        entry.queries()[query](spark, sf)
    return seen


@pytest.mark.parametrize("query, module, function, name, value", [
    ("season_anomalies", anomaly, "isolation_forest", "n_trees", 500), ("contamination_sweep", anomaly, "contamination_sweep", "n_trees", 500),
    ("customer_anomalies", anomaly, "isolation_forest", "n_trees", 500), ("triage_forest", learning, "text_forest", "trees", 100),
    ("bootstrap_median_diff", resample, "bootstrap_median_diff", "replicates", 8000)])
def test_published_counts(monkeypatch, spark, sf, query, module, function, name, value):
    assert arguments(monkeypatch, spark, sf, module, function, query)[name] == value


@pytest.mark.parametrize("query", ["fit_and_eval", "cross_validate", "imbalance_table"])
def test_every_model_at_its_size(monkeypatch, spark, sf, query):
    models = arguments(monkeypatch, spark, sf, learning, query, query)["models"]
    assert list(models) == MODELS and models["RandomForest"].getNumTrees() == 300
    assert [models[m].getMaxIter() for m in MODELS[2:]] == [200, 500]


def test_forest_of_importances(monkeypatch, spark, sf):
    seen = []
    monkeypatch.setattr(learning, "feature_names", lambda rows: [])
    monkeypatch.setattr(learning, "importances", lambda model, names: seen.append(model.getNumTrees))
    entry.queries()["feature_importance"](spark, sf)
    assert seen == [300]


def test_permutation_for_every_model(monkeypatch, spark, sf):
    small = DecisionTreeClassifier(labelCol="debt", maxDepth=1)
    monkeypatch.setattr(learning, "tree_models", lambda label, weights: dict.fromkeys(MODELS, small))
    monkeypatch.setattr(learning, "permutation_importance", lambda *args: spark.range(1))
    assert [r["model"] for r in entry.queries()["permutation_importance"](spark, sf).collect()] == MODELS
