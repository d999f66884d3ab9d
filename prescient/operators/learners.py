"""Classifier families, grid search with cross-validation, scoring.

Every family is the shared feature prefix (``features.build_stages``) plus
one pyspark.ml estimator, so the indexers are fitted inside each training
fold and validation rows never leak into them. Fitting is MLlib's own
distributed training (tree aggregation, L-BFGS); nothing here collects data.

The R-only learners of the study are re-aimed onto Spark:
linear SVM -> ``LinearSVC`` on standardised inputs; polynomial SVM ->
explicit ``PolynomialExpansion`` + ``LinearSVC``; radial SVM -> seeded
random Fourier features + ``LinearSVC``; boosted trees and parallel forest
-> the GBT/RF families (their grids are in ``tuning``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes,
                                       RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prescient.operators import features as fe
from prescient.session import cut_lineage

LABEL = fe.LABEL_IDX
FEAT = fe.INDEXED_FEATURES

# Estimator settings and grids of the study.
RF_TREES = 150
RF_MEMORY_MB = 1024
#: Weights (rows x trees, four bytes each) that one fit of a forest may hold.
FOREST_WEIGHTS = 250_000_000
#: A forest that is too large for one fit: trees of a group, whose statistics a processor's
#: cache nearly holds, and node ids (rows x trees, four bytes each) that a group may hold.
FOREST_GROUP, FOREST_IDS = 30, 100_000_000
#: A task of a fit that has more rows than this, and twice its share, has them dealt anew:
#: tasks of ``ROWS_DEALT`` rows at least and ``ROWS_HELD`` at most.
ROWS_UNEVEN, ROWS_DEALT, ROWS_HELD = 1 << 16, 1 << 14, 1 << 20
MAX_ITER = 150
RF_DEPTHS = [5, 10]
NB_SMOOTHING = [1.0, 2.0]
LR_REG = [0.3, 0.5]
GBT_DEPTHS = [5, 10]
MLP_HIDDEN = [[4, 5], [10, 10]]
SVM_C = [0.25, 0.5, 0.75, 1.0]
POLY_DEGREE = [1, 2, 3]
POLY_SCALE = [0.001, 0.01, 0.1]
RF_MTRY = list(range(2, 11))


# Forests of deep trees: cache each row's node id instead of shipping all 150
# trees to the executors at each level (same model, about half the time at
# depth 10); the cache is checkpointed to spark.checkpoint.dir every 10
# iterations. Boosting grows one tree per iteration, where the cache costs
# more than it saves (measured ~1.5x slower), so GBT does not use it.
TREE_EXEC = {"cacheNodeIds": True, "checkpointInterval": 10}


def rf(max_depth: int = 10, seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=LABEL, featuresCol=FEAT, numTrees=RF_TREES,
                                  maxDepth=max_depth, maxMemoryInMB=RF_MEMORY_MB, seed=seed,
                                  **TREE_EXEC)


def nb(smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(labelCol=LABEL, featuresCol=FEAT, smoothing=smoothing,
                      modelType="multinomial")


def lr(reg: float = 0.3) -> LogisticRegression:
    return LogisticRegression(labelCol=LABEL, featuresCol=FEAT, maxIter=MAX_ITER, regParam=reg)


def gbt(max_depth: int = 10, seed: int = 7) -> GBTClassifier:
    return GBTClassifier(labelCol=LABEL, featuresCol=FEAT, maxIter=MAX_ITER, maxDepth=max_depth,
                         seed=seed)


def mlp(n_inputs: int, hidden=(10, 10), features: str = FEAT, seed: int = 7):
    return MultilayerPerceptronClassifier(labelCol=LABEL, featuresCol=features, maxIter=MAX_ITER,
                                          layers=[n_inputs, *hidden, 2], seed=seed)


def families(n_inputs: int) -> dict:
    """name -> (estimator, param grid): the five families tuned by CV."""
    r, n, l, g = rf(), nb(), lr(), gbt()
    m = mlp(n_inputs)
    return {
        "RF": (r, ParamGridBuilder().addGrid(r.maxDepth, RF_DEPTHS).build()),
        "NB": (n, ParamGridBuilder().addGrid(n.smoothing, NB_SMOOTHING).build()),
        "LR": (l, ParamGridBuilder().addGrid(l.regParam, LR_REG).build()),
        "GBT": (g, ParamGridBuilder().addGrid(g.maxDepth, GBT_DEPTHS).build()),
        "MLP": (m, ParamGridBuilder().addGrid(
            m.layers, [[n_inputs, *h, 2] for h in MLP_HIDDEN]).build()),
    }


def pipeline(estimator, inputs: list[str] | None = None, extra: list | None = None) -> Pipeline:
    return Pipeline(stages=[*fe.build_stages(inputs), *(extra or []), estimator])


def fit(estimator, train: DataFrame):
    """Fit with the training table persisted while the stages read it.

    Every stage of a pipeline (indexers, vector indexer, the estimator's own
    passes) re-reads its input; persisting it for the fit computes it once
    (measured 18 s -> 7 s for the LR pipeline at sf0.1). A lost block is
    recomputed from lineage; the cache is released when the model exists.
    Rows that a file keeps in few large row groups are spread over the cluster first.
    """
    tr = train.persist(StorageLevel.MEMORY_AND_DISK)
    even = tr
    try:
        even = spread(tr)
        if even is not tr:
            even = even.persist(StorageLevel.MEMORY_AND_DISK)
            even.count()
            tr.unpersist()
        return estimator.fit(even)
    finally:
        if even is not tr:
            even.unpersist()
        tr.unpersist()


def dealt_tasks(largest: int, rows: int, cores: int) -> int:
    """Tasks to deal ``rows`` over, or 0 if the one of ``largest`` rows is no long one."""
    if largest <= max(ROWS_UNEVEN, 2 * rows // cores):
        return 0
    return min(max(cores, -(-rows // ROWS_HELD)), -(-rows // ROWS_DEALT))


def tasks_to_deal(rows: DataFrame) -> int:
    """``dealt_tasks`` for the tasks that ``rows`` are in."""
    found = rows.groupBy(F.spark_partition_id().alias("task")).count() \
        .agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    return dealt_tasks(found.largest or 0, found.rows or 0,
                       rows.sparkSession.sparkContext.defaultParallelism)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over the cluster if one task has far more than its share: a
    scan gives each row group to one task, and every pass of a fit takes as long as the
    longest. Others are returned as they are, without a shuffle."""
    tasks = tasks_to_deal(rows)
    return rows.repartition(tasks) if tasks else rows


def forest_groups(rows: int, trees: int) -> list[int]:
    """Trees of each fit, so that no fit holds more than ``FOREST_WEIGHTS`` weights; many
    trees that do not fit together are met in groups of ``FOREST_GROUP`` at most, as a row's
    visit to a node of each tree waits for memory where the trees' statistics are large."""
    most = max(1, min(trees, FOREST_WEIGHTS // max(rows, 1)))
    if most < trees:
        most = min(most, FOREST_GROUP)
    return [min(most, trees - i) for i in range(0, trees, most)]


def evened(rows: DataFrame) -> DataFrame:
    """``rows`` dealt anew if their tasks leave a fifth of the cluster idle: a pass takes as
    long as the longest task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    found = rows.groupBy(F.spark_partition_id().alias("task")).count() \
        .agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    n = found.rows or 0
    if (found.largest or 0) * cores <= 1.25 * n:
        return rows
    return rows.repartition(cores * -(-n // (cores * ROWS_HELD)))


def fit_forest(forest: RandomForestClassifier, train: DataFrame) -> PipelineModel:
    """Shared prefix and ``forest`` on ``train``. A fit holds a weight of each tree for
    each row, so on many rows the trees are fitted in groups of their own seeds, on rows
    that are dealt evenly, and put together: a forest's trees are independent."""
    rows = train.select(*fe.columns()).persist(StorageLevel.MEMORY_AND_DISK)
    even = rows
    try:
        prefix = Pipeline(stages=fe.build_stages()).fit(rows)
        n = rows.count()
        groups = forest_groups(n, forest.getNumTrees())
        if len(groups) == 1:
            return PipelineModel([*prefix.stages, forest.fit(prefix.transform(rows))])
        even = evened(rows)
        if even is not rows:
            even = even.persist(StorageLevel.MEMORY_AND_DISK)
            even.count()
            rows.unpersist()
        vectors = prefix.transform(even)
        models = [forest.copy().setNumTrees(k).setSeed(forest.getSeed() + i)
                  .setCacheNodeIds(n * k <= FOREST_IDS).fit(vectors)
                  for i, k in enumerate(groups)]
        return PipelineModel([*prefix.stages, _one_forest(forest, models)])
    finally:
        even.unpersist()
        rows.unpersist()


def _one_forest(forest, models: list) -> RandomForestClassificationModel:
    """The forest of all trees of ``models``."""
    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml.classification
    trees = [t for m in models for t in m._java_obj.trees()]
    held = gateway.new_array(ml.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        held[i] = t
    java = ml.RandomForestClassificationModel(
        f"{forest.uid}_all", held, models[0].numFeatures, models[0].numClasses)
    java.setFeaturesCol(forest.getFeaturesCol())
    java.set(java.getParam("numTrees"), len(trees))
    out = RandomForestClassificationModel(java)
    out._resetUid(java.uid())
    out._transfer_params_from_java()
    return out


def fit_or_load(estimator: Pipeline, train: DataFrame, path: str) -> PipelineModel:
    """Reuse a model a previous run finished saving, else fit and save it.

    Spark writes a model's metadata first and its stages after, so their markers
    say nothing about the whole. A marker of our own is written last, beside
    the model; a save that died half-way has none and is redone.
    """
    spark = train.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_MODEL_SAVED")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(done):
        return PipelineModel.load(path)
    model = fit(estimator, train)
    model.write().overwrite().save(path)
    fs.create(done, True).close()
    return model


def evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction",
                                             metricName="accuracy")


def grid_search(train: DataFrame, estimator, grid, fold_col: str | None = "fold",
                folds: int = 10, parallelism: int = 4, seed: int = 7,
                inputs: list[str] | None = None, extra: list | None = None):
    """k-fold CV over the grid of whole pipelines by ``CrossValidator`` (the prefix is
    fitted for every grid point; ``tuning.tune`` fits it once a fold), best by accuracy,
    refit on all training rows.

    With ``fold_col`` the folds are the given (deterministic) column.
    Returns (CrossValidatorModel, one row per grid point with its mean
    validation accuracy).
    """
    cv = CrossValidator(estimator=pipeline(estimator, inputs, extra), estimatorParamMaps=grid,
                        evaluator=evaluator(), numFolds=folds, parallelism=parallelism,
                        seed=seed, **({"foldCol": fold_col} if fold_col else {}))
    # CV reads its input twice per fold and grid point; write it once to the
    # shared checkpoint folder instead of recomputing its lineage each time
    model = cv.fit(cut_lineage(train))
    rows = [(i, ", ".join(f"{p.name}={v}" for p, v in pm.items()), float(m))
            for i, (pm, m) in enumerate(zip(grid, model.avgMetrics))]
    table = train.sparkSession.createDataFrame(rows, "grid_point int, params string, accuracy double")
    return model, table


def predictions(model: PipelineModel, test: DataFrame, classifier: str,
                keep: list[str]) -> DataFrame:
    """Long predictions: keep columns, classifier, predicted label string."""
    labels = _label_names(model)
    out = model.transform(test)
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return out.select(*keep, F.lit(classifier).alias("classifier"), lab.alias("prediction"))


def _label_names(model) -> list[str]:
    stages = model.stages if hasattr(model, "stages") else model.bestModel.stages
    for s in stages:
        if getattr(s, "getOutputCol", None) and s.getOutputCol() == LABEL:
            return list(s.labels)
    raise ValueError("no label indexer in pipeline")


def importances(model: PipelineModel, names: list[str]) -> DataFrame:
    """Tree feature importances (normalised to 1) with the slot names."""
    est = model.stages[-1]
    vals = est.featureImportances.toArray()
    spark = _active()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, vals)],
                                 "feature string, importance double")


def _active():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


# -- re-aimed SVMs ---------------------------------------------------------------

def svm_linear(c: float, n_train: int, features: str = "scaled") -> LinearSVC:
    """C of a soft-margin SVM maps to regParam = 1 / (C n)."""
    return LinearSVC(labelCol=LABEL, featuresCol=features, regParam=1.0 / (c * n_train),
                     maxIter=MAX_ITER, standardization=False)


def scaler(out: str = "scaled", inp: str = fe.FEATURES) -> StandardScaler:
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def poly_features(degree: int, inp: str = "scaled", out: str = "poly") -> PolynomialExpansion:
    return PolynomialExpansion(inputCol=inp, outputCol=out, degree=degree)


def random_fourier(df: DataFrame, inp: str, out: str, n_features: int, dim: int,
                   sigma: float, seed: int = 7) -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 1/sigma^2), b ~ U(0, 2 pi):
    a seeded random feature map whose inner products approximate the RBF
    kernel exp(-|x - y|^2 / (2 sigma^2)). Applied per Arrow batch."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 1.0 / sigma, size=(dim, n_features))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(col: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in col.to_numpy()]) if len(col) \
            else np.zeros((0, dim))
        z = scale * np.cos(x @ w + b)
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(rff(vector_to_array(inp))))
