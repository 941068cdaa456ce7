"""Models and evaluation.

All training is ``pyspark.ml`` on DataFrames: the fits run as Spark jobs
(tree aggregation per iteration), never on driver-side copies of the data.
Inputs to iterative fits are checkpointed by the callers, so an executor loss
recomputes from the checkpoint rather than from the whole lineage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reviewlens.functions.constants import (
    BIGRAM_MODEL, GRID_FOLDS, LOGISTIC_GRID, LOGISTIC_MODEL, MAIN_MODEL, PERCEPTRON_MODEL, SPLIT_SEED, SPLIT_WEIGHTS,
)
from reviewlens.functions.vectors import vector_element
from reviewlens.operators import boosting, ranks
from reviewlens.plans import textml
from reviewlens.sources.files import rows_to_frame


def random_split(df: DataFrame, weights: Sequence[float] = SPLIT_WEIGHTS, seed: int = SPLIT_SEED):
    """M1: seeded random split (default 80/20, seed 47)."""
    return df.randomSplit(list(weights), seed=seed)


def one_feature_logistic(feature: str, label: str = "label") -> Pipeline:
    """M3 + M4 + N10: assembler of one column + default logistic regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=[feature], outputCol="features"),
                            LogisticRegression(featuresCol="features", labelCol=label)])


def main_settings(max_iter: int = MAIN_MODEL["max_iter"], seed: int = SPLIT_SEED) -> boosting.Settings:
    """M6: the main model's settings for ``boosting.fit`` (leaf-wise trees, L1/L2 penalties)."""
    return boosting.Settings(learning_rate=MAIN_MODEL["step_size"], rounds=max_iter, num_leaves=MAIN_MODEL["num_leaves"],
                             lambda_l1=MAIN_MODEL["lambda_l1"], lambda_l2=MAIN_MODEL["lambda_l2"],
                             feature_fraction=MAIN_MODEL["feature_fraction"], seed=seed)


def main_gbt(max_iter: int = MAIN_MODEL["max_iter"], step_size: float = MAIN_MODEL["step_size"],
             feature_fraction: float = MAIN_MODEL["feature_fraction"], max_depth: int = 6,
             seed: int = SPLIT_SEED, weight_col: str | None = None) -> GBTClassifier:
    """Spark's own boosted trees beside M6 (``main_settings``): learning rate 0.05,
    feature fraction 0.85 per tree node, depth-limited trees, no leaf penalties."""
    kw = dict(featuresCol="features", labelCol="label", stepSize=step_size, maxIter=max_iter,
              maxDepth=max_depth, featureSubsetStrategy=str(feature_fraction), seed=seed)
    if weight_col:
        kw["weightCol"] = weight_col
    return GBTClassifier(**kw)


def bigram_gbt(max_iter: int = BIGRAM_MODEL["max_iter"], seed: int = SPLIT_SEED,
               vocab_size: int = BIGRAM_MODEL["vocab_size"], min_df: float = BIGRAM_MODEL["min_df"],
               max_df: float = BIGRAM_MODEL["max_df"]) -> Pipeline:
    """M5: tokens -> stop words -> bigrams -> counts -> boosted trees (10 rounds)."""
    stages = [textml.tokenizer(), textml.stop_words(),
              *textml.bigram_count_stages(vocab_size=vocab_size, min_df=min_df, max_df=max_df),
              GBTClassifier(featuresCol="rawFeatures_n", labelCol="label", maxIter=max_iter, seed=seed)]
    return Pipeline(stages=stages)


def spread(rows: DataFrame, most: int = 5_000) -> DataFrame:
    """Checkpointed rows in partitions of at most about ``most``: tree fits keep a whole number for every
    feature of every row, 40 KB a row at 10,000 bigrams, and a task reads its partition of them."""
    parts = -(-rows.count() // most)
    return rows if parts <= rows.rdd.getNumPartitions() else rows.repartition(parts).checkpoint(eager=True)


def logistic_full() -> LogisticRegression:
    """M7: logistic regression on the full feature vector."""
    return LogisticRegression(featuresCol="features", labelCol="label", **LOGISTIC_MODEL)


def random_forest(seed: int = SPLIT_SEED, weight_col: str | None = None) -> RandomForestClassifier:
    """M8: random forest with defaults (seeded)."""
    kw = {"weightCol": weight_col} if weight_col else {}
    return RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, **kw)


def perceptron(n_features: int, seed: int = SPLIT_SEED) -> MultilayerPerceptronClassifier:
    """M9: the notebook's [2, 2, 2] layers with the input layer set to the
    feature-vector size (the first layer must equal it)."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                          layers=[n_features, *PERCEPTRON_MODEL["hidden"], PERCEPTRON_MODEL["classes"]],
                                          maxIter=PERCEPTRON_MODEL["maxIter"], blockSize=PERCEPTRON_MODEL["blockSize"], seed=seed)


def cross_validated_logistic(parallelism: int = 4, seed: int = SPLIT_SEED) -> CrossValidator:
    """27-point grid x 3 folds, area under ROC."""
    lr = LogisticRegression(featuresCol="features", labelCol="label")
    grid = (ParamGridBuilder()
            .addGrid(lr.maxIter, LOGISTIC_GRID["maxIter"])
            .addGrid(lr.regParam, LOGISTIC_GRID["regParam"])
            .addGrid(lr.elasticNetParam, LOGISTIC_GRID["elasticNetParam"])
            .build())
    return CrossValidator(estimator=lr, estimatorParamMaps=grid,
                          evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0),
                          numFolds=GRID_FOLDS, parallelism=parallelism, seed=seed)


def class_weights(df: DataFrame, label: str = "label", out: str = "class_weight") -> DataFrame:
    """M19 re-aimed: balance the classes with per-row weights n / (2 * n_class)
    (the notebook's oversampling was an in-memory library; weights give the
    same balance without materialising synthetic rows). Class sizes come from
    one aggregate over the label, broadcast: a join that shuffles by label would
    send half of the table to one task."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.select(F.count(F.lit(1))).scalar()
    w = counts.select(label, (total / (F.lit(2.0) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), on=label, how="left")  # one row a class


def predictions_listing(pred: DataFrame, feature: str, label: str = "label") -> DataFrame:
    """M16 + C3: label, feature, prediction and P(label = 1)."""
    return pred.select(label, feature, F.col("prediction").cast("int").alias("prediction"),
                       vector_element("probability", 1).alias("probability"))


def prediction_counts(pred: DataFrame) -> DataFrame:
    """Rows per predicted class."""
    return pred.groupBy(F.col("prediction").cast("int").alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")).orderBy("prediction")


def binary_metrics_from_scores(scored: DataFrame, score: str, label: str = "label") -> dict[str, float]:
    """M11 + M14 from a score column (exact, evaluated on per-score counts)."""
    row = ranks.areas(scored, score, label).first()
    return {"areaUnderROC": row.area_under_roc or 0.0, "areaUnderPR": row.area_under_pr or 0.0}


def binary_metrics(pred: DataFrame, label: str = "label") -> dict[str, float]:
    """M11 + M14 on model output, scored by P(label = 1) (monotone in the
    model's raw margin)."""
    scored = pred.select(vector_element("probability", 1, "double").alias("_p1"), F.col(label))
    return binary_metrics_from_scores(scored, "_p1", label)


def feature_names(df: DataFrame, vector_col: str) -> list[str]:
    """Slot names of an assembled vector from its ML attribute metadata."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    slots = []
    for group in attrs.values():
        slots.extend((a["idx"], a["name"]) for a in group)
    slots.sort()
    n = meta.get("num_attrs", len(slots))
    names = {i: name for i, name in slots}
    return [names.get(i, f"f{i}") for i in range(n)]


def feature_importances(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """(index, feature, importance) of a tree model; one row per feature
    (the vector is model state of ``len(names)`` values, not data)."""
    imp = model.featureImportances.toArray()
    schema = T.StructType([T.StructField("index", T.IntegerType(), False),
                           T.StructField("feature", T.StringType(), False),
                           T.StructField("importance", T.DoubleType(), False)])
    return rows_to_frame(spark, [(i, names[i] if i < len(names) else f"f{i}", float(v))
                                 for i, v in enumerate(imp)], schema)

