"""Splits, resampling, tree models and anomaly scores on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episcope.functions.expr import days_since, flag
from episcope.operators import anomaly, learning, metrics, neighbours, rules
from episcope.operators.filters import stratum
from episcope.plans import surveillance
from episcope.session import durable
from workbook.panels import rounded
from workbook.registry import query, table
from workbook.tables import AS_OF, PANEL_DIMS, SUPPRESSED, panel, registry


@query("stratified_split", """WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderstatus, 'train' AS split, CAST(round(n * 0.7e0) AS BIGINT) AS n FROM n
UNION ALL SELECT o_orderstatus, 'valid', CAST(round(n * 0.85e0) - round(n * 0.7e0) AS BIGINT) FROM n
UNION ALL SELECT o_orderstatus, 'test', CAST(n - round(n * 0.85e0) AS BIGINT) FROM n""")
def stratified_split(spark, sf):
    out = learning.stratified_split(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus",
                                    {"train": 0.7, "valid": 0.15, "test": 0.15})
    return out.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_split_rows")
def stratified_split_rows(spark, sf):
    return learning.stratified_split(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus",
                                     {"train": 0.8, "test": 0.2}).select("o_orderkey", "o_orderstatus", "split")


@query("stratified_folds", """WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderstatus, CAST(f AS INTEGER) AS fold, CAST(floor((n - f + 4) / 5) AS BIGINT) AS n FROM n, range(5) AS t(f)""")
def stratified_folds(spark, sf):
    return learning.stratified_folds(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus").groupBy(
        "o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("split_balance", """SELECT l_linestatus, count(*) AS total, count(*) FILTER (WHERE l_returnflag <> 'R') AS negative,
  count(*) FILTER (WHERE l_returnflag = 'R') AS positive,
  round(count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*), 6) AS prevalence,
  round(count(*) FILTER (WHERE l_returnflag <> 'R') / count(*) FILTER (WHERE l_returnflag = 'R'), 6) AS imbalance_ratio
FROM lineitem GROUP BY 1""")
def split_balance(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", flag(F.col("l_returnflag") == "R"))
    return rounded(learning.split_table(li, "l_linestatus", "y"))


@query("class_weights", """SELECT o_orderpriority, count(*) AS n,
  round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*)), 8) AS weight
FROM orders GROUP BY 1""")
def class_weights(spark, sf):
    return rounded(learning.class_weights(table(spark, sf, "orders"), "o_orderpriority"), 8)


def _debt(spark, sf):
    """Customers with a small positive class: in debt or not."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", flag(F.col("c_acctbal") < 0).alias("debt"), "c_mktsegment",
                    (F.col("c_nationkey") % 3).cast("string").alias("zone"), F.col("c_nationkey").cast("double").alias("nation"),
                    (F.col("c_custkey") % 97).cast("double").alias("slot"), flag(F.col("c_nationkey") > 12).alias("far"))


def _debt_vectors(spark, sf):
    rows = _debt(spark, sf)
    return _debt_chain().fit(rows).transform(rows).select("c_custkey", "debt", "features")


@query("oversample", """WITH n AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS few,
  count(*) FILTER (WHERE c_acctbal >= 0) AS many FROM customer)
SELECT 0 AS debt, many AS n FROM n UNION ALL SELECT 1, CAST(floor(many * 0.7e0) AS BIGINT) FROM n""")
def oversample(spark, sf):
    return neighbours.oversample(_debt(spark, sf), "c_custkey", "debt", 0.7, 42).groupBy("debt").agg(
        F.count(F.lit(1)).alias("n"))


@query("nearest_neighbours", """WITH d AS (
  SELECT a.vec_id AS qid, b.vec_id AS pid,
    round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, pid) AS rank FROM d)
SELECT qid, CAST(rank AS INTEGER) AS rank, pid, round(dist, 6) AS dist FROM r WHERE rank <= 5""")
def nearest_neighbours(spark, sf):
    points = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                                   F.col("embedding").cast("array<double>").alias("vec"))
    return neighbours.nearest_neighbours(points, points, 5).withColumn("dist", F.round("dist", 6))


def _rare_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", flag(F.col("label") == 0).alias("rare"), "embedding")


@query("smote", """WITH n AS (SELECT count(*) FILTER (WHERE label = 0) AS few, count(*) FILTER (WHERE label <> 0) AS many
  FROM embeddings)
SELECT 0 AS rare, false AS synthetic, many AS n FROM n UNION ALL SELECT 1, false, few FROM n
UNION ALL SELECT 1, true, CAST(floor(many * 0.7e0) AS BIGINT) - few FROM n""")
def smote(spark, sf):
    out = neighbours.smote(_rare_vectors(spark, sf), "vec_id", "rare", "embedding", 0.7)
    return out.groupBy("rare", F.col("vec_id").isNull().alias("synthetic")).agg(F.count(F.lit(1)).alias("n"))


@query("smote_rows")
def smote_rows(spark, sf):
    return neighbours.smote(_rare_vectors(spark, sf), "vec_id", "rare", "embedding", 0.7)


@query("smote_borderline")
def smote_borderline(spark, sf):
    return neighbours.smote(_rare_vectors(spark, sf), "vec_id", "rare", "embedding", 0.7, borderline=True)


@query("feature_vectors")
def feature_vectors(spark, sf):
    return _debt_vectors(spark, sf).withColumn("features", vector_to_array("features"))


def _debt_chain(**changes):
    return learning.preprocessor(**{"categorical": ["c_mktsegment", "zone"], "passthrough": ["far"], "scaled": ["nation", "slot"], **changes})


@query("fit_and_eval")
def fit_and_eval(spark, sf):
    split = learning.stratified_split(_debt(spark, sf), "c_custkey", "debt", {"train": 0.7, "valid": 0.15, "test": 0.15})
    return learning.fit_and_eval(split, "split", "c_custkey", "debt", learning.tree_models("debt", weights=True), _debt_chain())


@query("fold_training_rows", """WITH n AS (SELECT CAST(c_acctbal < 0 AS INTEGER) AS debt, count(*) AS n FROM customer GROUP BY 1),
t AS (SELECT fold, debt, n - ((n - fold - 1) // 5 + 1) AS n FROM n, (SELECT unnest(range(5)) AS fold)),
m AS (SELECT fold, max(n) FILTER (WHERE debt = 0) AS many, max(n) FILTER (WHERE debt = 1) AS few FROM t GROUP BY fold)
SELECT CAST(fold AS INTEGER) AS fold, 0 AS debt, many AS n, round((many + up) / (2.0e0 * many), 9) AS weight
FROM (SELECT *, CAST(floor(many * 0.7e0) AS BIGINT) AS up FROM m)
UNION ALL SELECT CAST(fold AS INTEGER), 1, up, round((many + up) / (2.0e0 * up), 9)
FROM (SELECT *, CAST(floor(many * 0.7e0) AS BIGINT) AS up FROM m)""")
def fold_training_rows(spark, sf):
    """Training rows of each fold after the resampling inside it, with the class weight that they give."""
    _, ready = learning.fold_rows(_debt(spark, sf), "c_custkey", "debt", _debt_chain(), resampling="smote")
    parts = [own.rows.select(F.lit(fold).alias("fold"), "debt", "balanced_weight") for fold, own in ready.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("fold", "debt").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("balanced_weight"), 9).alias("weight"))


@query("fold_support", """WITH n AS (SELECT CAST(c_acctbal < 0 AS INTEGER) AS debt, count(*) AS n FROM customer GROUP BY 1),
t AS (SELECT fold, debt, (n - fold - 1) // 5 + 1 AS n FROM n, (SELECT unnest(range(5)) AS fold))
SELECT 'DecisionTree' AS model, CAST(fold AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE debt = 1) AS BIGINT) AS positive
FROM t GROUP BY fold""")
def fold_support(spark, sf):
    """What each fold of the cross-validation is judged on."""
    tree = {"DecisionTree": learning.tree_models("debt", weights=True)["DecisionTree"]}
    folds = learning.cross_validate(_debt(spark, sf), "c_custkey", "debt", tree, _debt_chain(), resampling="smote")
    return folds.select("model", "fold", "total", (F.col("tp") + F.col("fn")).alias("positive"))


@query("cross_validate")
def cross_validate(spark, sf):
    folds = learning.cross_validate(_debt(spark, sf), "c_custkey", "debt", learning.tree_models("debt", weights=True),
                                    _debt_chain(), resampling="smote")
    return metrics.cv_summary(folds, ["accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc"], ["model"])


@query("imbalance_table")
def imbalance_table(spark, sf):
    split = durable(learning.stratified_split(_debt(spark, sf), "c_custkey", "debt", {"train": 0.7, "test": 0.3}))
    train, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'")
    return learning.imbalance_table(train, test, "c_custkey", "debt", learning.tree_models("debt", weights=True), _debt_chain())


@query("feature_importance")
def feature_importance(spark, sf):
    split = learning.stratified_split(_debt(spark, sf), "c_custkey", "debt", {"train": 0.7, "valid": 0.15, "test": 0.15})
    own = learning.prepare(split.where("split = 'train'"), _debt_chain(), "c_custkey", "debt", "smote")
    model = learning.tree_models("debt", weights=True)["RandomForest"].fit(own.rows)
    return learning.importances(model, learning.feature_names(own.chain.transform(split)))


@query("permutation_importance")
def permutation_importance(spark, sf):
    rows = _debt(spark, sf)
    own = learning.prepare(rows, _debt_chain(categorical=["c_mktsegment"]), "c_custkey", "debt")
    models, columns = learning.tree_models("debt", weights=True), ["c_mktsegment", "far", "nation", "slot"]
    kinds = learning.shuffled_kinds(rows, "c_custkey", columns, 42)

    def one(name):
        found = learning.permutation_importance(own.fit(models[name]), rows, "c_custkey", "debt", columns, 42, kinds)
        return found.withColumn("model", F.lit(name))

    return reduce(DataFrame.unionByName, learning.run_together([lambda n=n: one(n) for n in models]))


@query("triage_forest")
def triage_forest(spark, sf):
    """The forest is fitted on four fifths of the rows and judged on the others."""
    df = rules.triage_label(registry(spark, sf), AS_OF).where("triage_reason <> 'None'").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "triage_reason", "symptoms", "temp",
        days_since("arrival_date", AS_OF).alias("days_since_arrival"))
    split = durable(learning.stratified_split(df, "id", "triage_reason", {"train": 0.8, "test": 0.2}))
    model = learning.text_forest(split.where("split = 'train'"), "triage_reason", "symptoms", ["temp", "days_since_arrival"])
    return metrics.class_report(model.transform(split.where("split = 'test'")), "triage_reason", "predicted")


SEASON_FEATURES = ["peak_rate", "mean_rate", "cum_rate", "n_weeks", "peak_week", "cv"]


def _seasons(spark, sf):
    rows = stratum(panel(spark, sf), PANEL_DIMS, ["virus_cat"]).where("virus_cat <> 'Overall'")
    feats = surveillance.season_features(rows, ["season", "phase", "virus_cat"], excluded=SUPPRESSED)
    return durable(feats.withColumn("id", F.concat_ws("/", "season", "virus_cat")))


@query("season_anomalies")
def season_anomalies(spark, sf):
    rows = _seasons(spark, sf)
    return anomaly.isolation_forest(rows.where("phase = 'pre_pandemic'"), rows, "id", SEASON_FEATURES)


@query("contamination_sweep")
def contamination_sweep(spark, sf):
    rows = _seasons(spark, sf)
    return anomaly.contamination_sweep(rows.where("phase = 'pre_pandemic'"), rows, "id", SEASON_FEATURES,
                                       excluded=["1998-99"])


@query("customer_anomalies")
def customer_anomalies(spark, sf):
    rows = table(spark, sf, "customer")
    scores = anomaly.isolation_forest(rows, rows, "c_custkey", ["c_acctbal", "c_nationkey"])
    return scores.select("c_custkey", "anomaly_score", "anomaly")


@query("robust_levels", """WITH f AS (SELECT l_suppkey, t FROM lineitem, (SELECT unnest([45.0, 47.0, 49.0]) AS t)
  WHERE l_quantity > t GROUP BY 1, 2)
SELECT l_suppkey, count(t) = 3 AS robust FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN f USING (l_suppkey)
GROUP BY 1""")
def robust_levels(spark, sf):
    from episcope.operators.joins import scenarios
    from episcope.operators.tabulate import at_every_level
    top = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("top"))
    swept = scenarios(top, [45.0, 47.0, 49.0], "t")
    return at_every_level(swept, "l_suppkey", "t", F.col("top") > F.col("t"), 3)
