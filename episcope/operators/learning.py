"""Splits, feature pipelines, tree models and their evaluation with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import (CountVectorizer, IndexToString, OneHotEncoder, RegexTokenizer, StandardScaler,
                                StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episcope.functions.expr import hashed_unit
from episcope.operators import metrics, trees
from episcope.operators.neighbours import resample
from episcope.operators.ordered import positions, windowed
from episcope.session import durable


# --- splits and weights -----------------------------------------------------------------------------------------

def _hash_positions(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Row number in hash order within each label; the same rows get the same numbers on any partitioning."""
    return positions(df.withColumn("__h", hashed_unit(seed, key)), [label], "__h", "__pos", tie=[key]).drop("__h")


def stratified_split(df: DataFrame, key: str, label: str, fractions: Mapping[str, float], seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Name a split for every row so that each label is divided by the fractions up to one row."""
    placed = _hash_positions(df, key, label, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    share, column = 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        share += fractions[name]
        hit = F.col("__pos") <= F.round(F.col("__n") * F.lit(share))
        column = F.when(hit, name) if column is None else column.when(hit, name)
    column = F.lit(names[0]) if column is None else column.otherwise(names[-1])
    sizes = sizes.withColumnRenamed(label, "__label")
    # Rows without a label are a stratum of their own.
    return (placed.join(sizes, placed[label].eqNullSafe(sizes["__label"])).withColumn(out, column)
            .drop("__pos", "__n", "__label"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return _hash_positions(df, key, label, seed).withColumn(out, ((F.col("__pos") - 1) % k).cast("int")).drop("__pos")


def split_table(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows, positives, negatives, prevalence and imbalance per split."""
    out = df.groupBy(split).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 0).alias("negative"),
                                F.count_if(F.col(label) == 1).alias("positive"))
    return out.select("*", (F.col("positive") * 100.0 / F.col("total")).alias("prevalence"),
                      F.try_divide(F.col("negative"), F.col("positive")).alias("imbalance_ratio"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_class) per class."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = sizes.select(F.sum("n")).scalar(), sizes.select(F.count(F.lit(1))).scalar()
    return sizes.withColumn("weight", total / (classes * F.col("n")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the class weight of each row; rows without a label stay and have none."""
    return df.join(class_weights(df, label).select(label, F.col("weight").alias(out)), label, "left")


def with_training_weights(df: DataFrame, label: str, factor: float = 1.5) -> DataFrame:
    """Add both weights of a 0/1 label from the frame's own class counts: ``balanced_weight`` n / (2 * n_class) and
    ``positive_weight``, which is ``factor`` times the negatives per positive for positives and 1 for negatives."""
    neg, pos = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    share = lambda n: (neg + pos) / (2.0 * n) if n else 1.0
    hit = F.col(label) == 1
    return df.withColumns({
        "balanced_weight": F.when(hit, F.lit(share(pos))).otherwise(F.lit(share(neg))),
        "positive_weight": F.when(hit, F.lit(factor * neg / pos if pos else 1.0)).otherwise(F.lit(1.0))})


# --- features ---------------------------------------------------------------------------------------------------

def preprocessor(categorical: Sequence[str] = (), binary_words: Sequence[str] = (), passthrough: Sequence[str] = (),
                 scaled: Sequence[str] = (), text: str | None = None, out: str = "features") -> Pipeline:
    """One pipeline for the feature vector.

    Categories become one indicator per known level, an unknown level all zeros; two-level columns become a single 0/1
    index; numbers pass through or are standardised (sample SD); text becomes word counts. Fitted statistics come from
    the frame the pipeline is fitted on.
    """
    stages, parts = [], []
    for c in binary_words:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetAsc", handleInvalid="keep"))
        parts.append(f"{c}__i")
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetAsc", handleInvalid="keep"))
        # The indexer keeps a last slot for unknown levels, and dropping the last slot leaves zeros for it.
        stages.append(OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", dropLast=True, handleInvalid="error"))
        parts.append(f"{c}__v")
    parts += list(passthrough)
    if scaled:
        stages.append(VectorAssembler(inputCols=list(scaled), outputCol="__num"))
        stages.append(StandardScaler(inputCol="__num", outputCol="__std", withMean=True, withStd=True))
        parts.append("__std")
    if text:
        stages.append(RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\w\w+", gaps=False))
        stages.append(CountVectorizer(inputCol="__words", outputCol="__counts", vocabSize=(1 << 31) - 1))
        parts.append("__counts")
    stages.append(VectorAssembler(inputCols=parts, outputCol=out))
    return Pipeline(stages=stages)


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    """Names of the vector slots from the column's metadata."""
    attrs = df.schema[col].metadata.get("ml_attr", {})
    found = [a for kind in attrs.get("attrs", {}).values() for a in kind]
    if found:
        return [a.get("name", f"f{a['idx']}") for a in sorted(found, key=lambda a: a["idx"])]
    return [f"f{i}" for i in range(attrs.get("num_attrs", 0))]


# --- models -----------------------------------------------------------------------------------------------------

#: Models that weigh the positive class and are therefore fitted without resampling.
NOT_RESAMPLED = ("BoostedWeighted",)


def tree_models(label: str, seed: int = 42, weights: bool = False) -> dict[str, Estimator]:
    """The four tree models with their published sizes. The last one is the boosted model with more, slower and narrower
    trees. ``weights``: the first two take ``balanced_weight`` and the last ``positive_weight``."""
    # The published model sizes.
    balanced = {"weightCol": "balanced_weight"} if weights else {}
    positive = {"weightCol": "positive_weight"} if weights else {}
    return {
        "DecisionTree": DecisionTreeClassifier(labelCol=label, maxDepth=6, minInstancesPerNode=50, seed=seed, **balanced),
        "RandomForest": RandomForestClassifier(labelCol=label, numTrees=300, maxDepth=10, minInstancesPerNode=20,
                                               seed=seed, **balanced),
        "GradientBoosting": GBTClassifier(labelCol=label, maxIter=200, stepSize=0.05, maxDepth=5,
                                          minInstancesPerNode=20, subsamplingRate=0.8, seed=seed),
        "BoostedWeighted": GBTClassifier(labelCol=label, maxIter=500, stepSize=0.03, maxDepth=4,
                                         minInstancesPerNode=3, subsamplingRate=0.8, featureSubsetStrategy="0.7",
                                         seed=seed, **positive),
    }


def run_together(tasks: Sequence[Callable], threads: int = 8) -> list:
    """Results of independent driver steps that mostly wait for Spark jobs, submitted from a bounded number of threads. The
    first error is raised after the running ones have ended."""
    if not tasks:
        return []
    spark = SparkSession.active()
    with ThreadPoolExecutor(max_workers=min(threads, len(tasks))) as pool:
        return list(pool.map(lambda run: run(), [inheritable_thread_target(spark)(t) for t in tasks]))


@dataclass(frozen=True)
class Prepared:
    """A transformer chain that was fitted on training rows, and these rows transformed and resampled."""
    chain: PipelineModel
    rows: DataFrame

    def fit(self, estimator: Estimator) -> PipelineModel:
        """The chain with the model behind it. It holds no resampler, so rows to be judged are only transformed."""
        return PipelineModel(stages=[*self.chain.stages, trees.fit(estimator, self.rows)])


#: Fits of a grid that are submitted at once. A boosted model is a chain of thousands of short jobs that mostly wait, and every
#: fit of the grid is one, so more of them than cores keep the cores busy.
FIT_THREADS = 16
#: Training rows to a partition: many small fits run at once, so a small training set stays in one partition.
ROWS_PER_PARTITION = 50_000


def prepare(train: DataFrame, preproc: Pipeline, key: str, label: str, resampling: str = "none", ratio: float = 0.7,
            seed: int = 42, features: str = "features") -> Prepared:
    """Fit the chain on the training rows, transform and resample them, and weigh the result by its own class counts.

    Only these rows are read, so levels, means and deviations, neighbours and weights know nothing of other rows. The
    result is durable, and its order and partitions follow from the rows alone. Rows without a label take no part.
    """
    known = train.where(F.col(label).isNotNull())
    chain = preproc.fit(known)
    moved = chain.transform(known).select(key, label, F.col(features))
    if resampling != "none":
        # The transformers work row by row and resampling reads its input many times, so both results are kept.
        arrays = durable(moved.withColumn(features, vector_to_array(features)))
        moved = durable(resample(arrays, resampling, key, label, features, ratio, seed)).withColumn(features, array_to_vector(features))
    order = F.xxhash64(key, label, vector_to_array(features))
    parts = math.ceil(moved.count() / ROWS_PER_PARTITION) or 1
    rows = with_training_weights(moved, label).withColumn("__order", order).repartition(parts, "__order")
    return Prepared(chain, durable(rows.sortWithinPartitions("__order").drop("__order")))


def scored(model: Transformer, df: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class next to the input columns."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def _judged(fitted: Transformer, rows: DataFrame, label: str, /, **names) -> DataFrame:
    """Durable label and score of each row, with the grid cell's names."""
    return durable(scored(fitted, rows).select(label, "score", *[F.lit(v).alias(n) for n, v in names.items()]))


def fit_and_eval(df: DataFrame, split: str, key: str, label: str, models: Mapping[str, Estimator], preproc: Pipeline,
                 resampling: str = "smote", ratio: float = 0.7, min_recall: float = 0.70, seed: int = 42,
                 train: str = "train", valid: str = "valid", threads: int = 8) -> DataFrame:
    """Fit each model on the training rows, tune its threshold on the validation rows, and report all metrics per
    model and split. The chain is fitted on the training rows, which are resampled but for models with weights; training
    metrics are those of the resampled rows."""
    data = durable(df)
    kinds = sorted({"none" if n in NOT_RESAMPLED else resampling for n in models})
    rows = data.where(F.col(split) == train)
    ready = dict(zip(kinds, run_together([lambda k=k: prepare(rows, preproc, key, label, k, ratio, seed) for k in kinds], threads)))

    def cell(name: str, estimator: Estimator) -> DataFrame:
        own = ready["none" if name in NOT_RESAMPLED else resampling]
        model = own.fit(estimator)
        others = durable(scored(model, data.where(F.col(split) != train)).select(split, label, "score"))
        seen = scored(model.stages[-1], own.rows).select(F.lit(train).alias(split), label, "score")
        best = metrics.tune_threshold(others.where(F.col(split) == valid), label, "score", min_recall).first()["threshold"]
        both = others.unionByName(seen).withColumns({
            "model": F.lit(name), "threshold": F.lit(float(best)), "pred": (F.col("score") >= best).cast("int")})
        return durable(both)

    parts = run_together([lambda n=n, e=e: cell(n, e) for n, e in models.items()], threads)
    return metrics.binary_metrics(reduce(DataFrame.unionByName, parts), label, "pred", "score", ["model", split, "threshold"])


def fold_rows(df: DataFrame, key: str, label: str, preproc: Pipeline, k: int = 5, seed: int = 42, resampling: str = "none",
              ratio: float = 0.7, threads: int = 8) -> tuple[DataFrame, dict[int, Prepared]]:
    """All rows with their fold, and the prepared training rows of each fold, which are those of the other folds."""
    folded = durable(stratified_folds(df, key, label, k, seed))
    one = lambda f: prepare(folded.where(F.col("fold") != f), preproc, key, label, resampling, ratio, seed)
    return folded, dict(enumerate(run_together([lambda f=f: one(f) for f in range(k)], threads)))


def cross_validate(df: DataFrame, key: str, label: str, models: Mapping[str, Estimator], preproc: Pipeline, k: int = 5,
                   seed: int = 42, resampling: str = "none", ratio: float = 0.7, threads: int = FIT_THREADS) -> DataFrame:
    """Metrics per model and fold at threshold 0.5.

    Each fold has its own chain, fitted on its training rows and shared by the models; resampling touches the training rows
    only, and not those of models with weights. All fits of the grid are submitted together, and one aggregate judges them.
    """
    kinds = sorted({"none" if n in NOT_RESAMPLED else resampling for n in models})
    # Fold numbers are hashes of keys, so they are the same each time.
    made = run_together([lambda kind=kind: fold_rows(df, key, label, preproc, k, seed, kind, ratio, threads) for kind in kinds], threads)
    folded, ready = made[0][0], {kind: own for kind, (_, own) in zip(kinds, made)}

    def cell(fold: int, name: str) -> DataFrame:
        own = ready["none" if name in NOT_RESAMPLED else resampling][fold]
        return _judged(own.fit(models[name]), folded.where(F.col("fold") == fold), label, model=name, fold=fold)

    # The longest fits first, so that no thread is left with one at the end.
    cells = [(f, n) for n in reversed(list(models)) for f in range(k)]
    parts = run_together([lambda f=f, n=n: cell(f, n) for f, n in cells], threads)
    judged = reduce(DataFrame.unionByName, parts).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return metrics.binary_metrics(judged, label, "pred", "score", ["model", "fold"])


def imbalance_table(train: DataFrame, test: DataFrame, key: str, label: str, models: Mapping[str, Estimator], preproc: Pipeline,
                    methods: Sequence[str] = ("none", "smote", "borderline", "oversample"), ratio: float = 0.7,
                    seed: int = 42, threads: int = FIT_THREADS) -> DataFrame:
    """How much the choice of resampling matters: one row of metrics per model and method on the same test rows. The method
    ``none`` leaves it to the weights of the models that have some. Every method has one chain and one set of training rows,
    shared by the models; all fits are submitted together."""
    ready = dict(zip(methods, run_together(
        [lambda m=m: prepare(train, preproc, key, label, m, ratio, seed) for m in methods], threads)))
    held = durable(test)
    cells = [(m, n) for n in reversed(list(models)) for m in methods]
    parts = run_together([lambda m=m, n=n: _judged(ready[m].fit(models[n]), held, label, method=m, model=n) for m, n in cells], threads)
    judged = reduce(DataFrame.unionByName, parts).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return metrics.binary_metrics(judged, label, "pred", "score", ["model", "method"]).select(
        "method", "model", "roc_auc", "pr_auc", "recall", "precision", "f1_score")


#: Training rows above which a text forest merges equal ones, and the rows that they are then merged into at most, unless
#: more of them differ.
MERGED_ROWS = 500_000


def merge_equal(df: DataFrame, cols: Sequence[str], weight: str, limit: int) -> DataFrame:
    """Rows that are equal in ``cols`` as one row with the sum of their weights. Where this leaves fewer than ``limit`` rows, each
    is cut by a hash of the whole row into as many parts as fit, so that draws of rows stay draws of small shares."""
    kinds = df.select(*cols).distinct().count()
    part = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, limit // max(kinds, 1))))
    return df.groupBy(*cols, part.alias("__part")).agg(F.sum(weight).alias(weight)).drop("__part")


def text_forest(df: DataFrame, label: str, text: str, numbers: Sequence[str], seed: int = 42, trees: int = 100,
                depth: int = 30) -> Model:
    """Multi-class forest on word counts and scaled numbers with balanced class weights; adds ``predicted``. The published
    trees grow without a limit; 30 levels are the most that Spark grows.

    Class weights, words, means and deviations come from all rows. Above ``MERGED_ROWS`` the trees read equal rows as one
    with the sum of their weights; their bootstrap then draws such merged rows.
    """
    weighted = with_class_weights(df.where(F.col(label).isNotNull()), label)
    indexer = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(weighted)
    forest = RandomForestClassifier(labelCol="__y", featuresCol="features", weightCol="weight", numTrees=trees,
                                    maxDepth=depth, seed=seed, predictionCol="__p")
    chain = Pipeline(stages=[indexer, *preprocessor(scaled=numbers, text=text).getStages()]).fit(weighted)
    rows = weighted
    if df.count() > MERGED_ROWS:
        rows = durable(merge_equal(weighted, [label, text, *numbers], "weight", MERGED_ROWS))
    named = IndexToString(inputCol="__p", outputCol="predicted", labels=indexer.labels)
    return PipelineModel(stages=[*chain.stages, forest.fit(chain.transform(rows)), named])


def importances(model, names: Sequence[str]) -> DataFrame:
    """Impurity importance per named feature, largest first. The vector has one entry per feature."""
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def shuffled_kinds(df: DataFrame, key: str, columns: Sequence[str], seed: int = 42) -> list[DataFrame]:
    """Kinds of rows with their count ``__n``: of the rows as they are, and with each of the columns shuffled.

    A shuffle takes the value of the previous row in hash order, which is a random cyclic exchange that needs neither
    a join nor a sort of the whole table in one task. The rows' ``key`` orders them only. Rows that are equal in all
    other columns have equal scores, so they are counted here and scored once.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return durable(rows.groupBy(*[c for c in df.columns if c != key]).agg(F.count(F.lit(1)).alias("__n")))

    def mixed(i: int, c: str) -> DataFrame:
        moved = windowed(df.withColumn("__h", hashed_unit(seed + i, key)), [], "__h", 1,
                         {"__prev": lambda w: F.lag(F.struct(F.col(c).alias("v"))).over(w)}, tie=[key])
        # The first row keeps its value; a null that is shuffled in stays null.
        return moved.withColumn(c, F.when(F.col("__prev").isNull(), F.col(c)).otherwise(F.col("__prev.v"))).drop("__prev", "__h")

    return run_together([lambda: counted(df), *[lambda i=i, c=c: counted(mixed(i, c)) for i, c in enumerate(columns)]])


def permutation_importance(model: Transformer, df: DataFrame, key: str, label: str, columns: Sequence[str],
                           seed: int = 42, kinds: Sequence[DataFrame] | None = None) -> DataFrame:
    """Drop in ROC area when one input column is shuffled, largest first. Several models can share the
    :func:`shuffled_kinds` of the same rows, columns and seed. The ``key`` is no input of the model."""
    kinds = kinds or shuffled_kinds(df, key, columns, seed)

    def area(rows: DataFrame) -> DataFrame:
        return metrics.auc(durable(scored(model, rows).select(label, "score", "__n")), label, "score", count="__n")

    full, *parts = run_together([lambda k=k: area(k) for k in kinds])
    full = full.select("roc_auc").first()[0]
    rows = [p.select(F.lit(c).alias("feature"), (F.lit(full) - F.col("roc_auc")).alias("importance")) for c, p in zip(columns, parts)]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("importance"), "feature")
