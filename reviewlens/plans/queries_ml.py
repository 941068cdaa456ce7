"""Registered queries: models, evaluation, scoring, CSV round trip.

Model outputs cannot be re-stated in SQL, so these have no oracle (rows-only
check); the pytest suite checks their invariants (probabilities in [0, 1],
AUC in [0, 1], importances summing to 1, vector sizes).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.operators import eda, metrics, prep, sentiment
from reviewlens.plans import models, scoring, studies, textml
from reviewlens.plans import sqlforms as S
from reviewlens.plans.catalog import register
from reviewlens.plans.queries_eda import LT, length_rows
from reviewlens.plans.queries_text import benchmark_lexicon, scored_reviews
from reviewlens.schema import SUBMISSION
from reviewlens.session import checkpoint_dir
from reviewlens.sources import read_csv, reviews_from_documents, scoring_from_documents, texts_from_documents



def _study_rows(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    """Checkpointed length- or sentiment-study rows."""
    rows = length_rows(spark, sf_dir) if family == "length" else studies.scored_study(scored_reviews(spark, sf_dir))
    cols = ["reviewTot_length"] if family == "length" else list(sentiment.SCORES)
    return studies.numeric_label(rows.select("reviewID", "label", *cols)).checkpoint(eager=True)


def _family(feature: str) -> str:
    return "length" if feature == "reviewTot_length" else "sentiment"


def _predictions(rows: DataFrame, feature: str) -> DataFrame:
    train, test = models.random_split(rows)
    return models.one_feature_logistic(feature).fit(train).transform(test)


def _one_feature(spark: SparkSession, sf_dir: str, feature: str) -> DataFrame:
    return _predictions(_study_rows(spark, sf_dir, _family(feature)), feature)


def _listing(feature: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return models.predictions_listing(_one_feature(spark, sf_dir, feature), feature)
    return run


for _feat, _key_name in (("reviewTot_length", "m4_lr_length_predictions"),
                         ("compound_score", "m4_lr_compound_predictions"),
                         ("polarity_score", "m4_lr_polarity_predictions"),
                         ("sentiment_score", "m4_lr_subjectivity_predictions")):
    _fn = _listing(_feat)
    _fn.__doc__ = f"M4 + M16: one-feature logistic regression on {_feat}, holdout listing."
    register(_key_name)(_fn)


@register("m4_one_feature_model_metrics")
def m4_one_feature_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + M11 + M12 + M14: AUC, PR area and accuracy of the four one-feature models."""
    rows = {family: _study_rows(spark, sf_dir, family) for family in ("length", "sentiment")}
    out = []
    for feat in ("reviewTot_length", *sentiment.SCORES):
        pred = _predictions(rows[_family(feat)], feat).checkpoint(eager=True)
        areas = models.binary_metrics(pred)
        out.append((feat, float(areas["areaUnderROC"]), float(areas["areaUnderPR"]),
                    float(metrics.multiclass_metric(pred, "accuracy"))))
    return spark.createDataFrame(out, "feature string, auc double, area_under_pr double, accuracy double")


@register("m1_random_split_counts")
def m1_random_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: sizes of the seeded 80/20 random split of the length-study rows."""
    rows = length_rows(spark, sf_dir).select("reviewID", "label", "reviewTot_length").checkpoint(eager=True)
    train, test = models.random_split(rows)
    return train.select(F.lit("train").alias("part"), F.count(F.lit(1)).alias("rows")).unionByName(
        test.select(F.lit("test").alias("part"), F.count(F.lit(1)).alias("rows")))


@register("lg_feature_rows", S.with_ctes(S.REVIEWS, S.lg_features()) + S.LG_FEATURES_SELECT)
def lg_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's feature table (train mode)."""
    feats = _features(spark, sf_dir)
    return feats.select("reviewID", "reviewerID", "productId", "verified", "overall", "label", "reviewTime",
                        "year", "month", "day_of_week", "age", "review_count", "productId_count",
                        "reviews_per_product", "reviewers_per_product", "product_review_interval",
                        "reviewOrder", "polarity_score", "sentiment_score", "combined_text_length", "combined_text")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's training features; the cleaned text joins the narrow rows last."""
    narrow = studies.build_narrow_features(scored_reviews(spark, sf_dir), "train")
    return studies.with_cleaned_texts(narrow, texts_from_documents(spark, sf_dir))


def _vectors(spark: SparkSession, sf_dir: str) -> scoring.Vectors:
    return scoring.vectorize(_features(spark, sf_dir))


def _scoring_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = benchmark_lexicon(spark, sf_dir)
    scored = scoring_from_documents(spark, sf_dir, lambda d: studies.score_texts(d, lexicon))
    narrow = studies.build_narrow_features(scored, "score")
    return studies.with_cleaned_texts(narrow, texts_from_documents(spark, sf_dir))


@register("n3_n9_n7_feature_vectors")
def n3_n9_n7_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word2Vec document vectors, assembled and min-max scaled."""
    from pyspark.ml.functions import vector_to_array
    out = _vectors(spark, sf_dir).train.select("reviewID", vector_to_array("word2vec_features").alias("w2v"),
                                               vector_to_array("features").alias("features"))
    return out.select("reviewID", F.size("w2v").alias("w2v_size"), F.size("features").alias("n_features"),
                      F.array_min("features").alias("min_scaled"), F.array_max("features").alias("max_scaled"))


@register("n9_n7_scaled_scalars", LT + """,
r as (select min(overall) as o0, max(overall) as o1, min(month) as m0, max(month) as m1,
             min(reviewTot_length) as l0, max(reviewTot_length) as l1 from lt)
select reviewID, case when o1 > o0 then (overall - o0) / (o1 - o0) else 0.5 end as overall_scaled,
       case when m1 > m0 then (month - m0) / cast(m1 - m0 as double) else 0.5 end as month_scaled,
       case when l1 > l0 then (reviewTot_length - l0) / cast(l1 - l0 as double) else 0.5 end as length_scaled
from lt, r""")
def n9_n7_scaled_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N9 + N7: scalar features assembled and min-max scaled."""
    from pyspark.ml.functions import vector_to_array
    rows = textml.assembler(["overall", "month", "reviewTot_length"]).transform(
        length_rows(spark, sf_dir).select("reviewID", "overall", "month", "reviewTot_length").checkpoint(eager=True))
    v = textml.scaler().fit(rows).transform(rows).select("reviewID", vector_to_array("features").alias("v"))
    return v.select("reviewID", *[F.col("v")[i].alias(n) for i, n in
                                  enumerate(("overall_scaled", "month_scaled", "length_scaled"))])


# A11, M15, O3, O4, M17, M18, S5 and S6 are registered on the random forest at its
# defaults (M8). The main boosted trees (M6) take up to 2000 rounds, minutes even on
# small tables; the library fits them (``scoring.train_main_model``), and no smaller fit stands in.
def _forest(spark: SparkSession, sf_dir: str):
    v = _vectors(spark, sf_dir)
    return v, models.random_forest().fit(v.train)


@register("a11_prediction_counts")
def a11_prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout rows per predicted class."""
    v, forest = _forest(spark, sf_dir)
    return models.prediction_counts(forest.transform(v.holdout))


@register("m15_feature_importances")
def m15_feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each of the 112 assembled features."""
    v, forest = _forest(spark, sf_dir)
    return models.feature_importances(spark, forest, models.feature_names(v.train, "features_assembled"))


@register("o3_top20_feature_importances")
def o3_top20_feature_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the 20 most important features (top-k is the feature)."""
    return eda.top_k(m15_feature_importances(spark, sf_dir), "importance", 20, "index")


def _submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, forest = _forest(spark, sf_dir)
    return scoring.score_table(v.text_model, forest, _scoring_features(spark, sf_dir))


@register("m17_m18_submission")
def m17_m18_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 + M18 + C3: score the unlabelled table, (reviewID, P(label = 1))."""
    return scoring.submission(_submission(spark, sf_dir))


@register("m17_scored_ids", S.with_ctes(S.SCORING) + "select reviewID from scoring")
def m17_scored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unlabelled review gets its features, and none twice."""
    return _scoring_features(spark, sf_dir).select("reviewID")


@register("s5_s6_submission_csv_round_trip")
def s5_s6_submission_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S6: write the submission as one CSV with a header under the
    checkpoint directory, read it back with an explicit schema."""
    path = os.path.join(checkpoint_dir(spark), f"submission-{uuid.uuid4().hex}.csv")
    scoring.write_submission(_submission(spark, sf_dir), path)
    return read_csv(spark, path, SUBMISSION)


@register("o4_prediction_preview")
def o4_prediction_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five holdout predictions (preview; the limit is the feature)."""
    v, forest = _forest(spark, sf_dir)
    return models.predictions_listing(forest.transform(v.holdout), "combined_text_length").orderBy("combined_text_length").limit(5)


def _fit_and_report(v: scoring.Vectors, estimator, name: str) -> DataFrame:
    pred = estimator.fit(v.train).transform(v.holdout)
    return scoring.holdout_metrics(pred).select(F.lit(name).alias("model"), "*")


@register("m7_logistic_full_metrics")
def m7_logistic_full_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: logistic regression (maxIter 20, regParam 0.1) on the full vector."""
    return _fit_and_report(_vectors(spark, sf_dir), models.logistic_full(), "logistic_regression")


@register("m8_random_forest_metrics")
def m8_random_forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: random forest (defaults, seeded) on the full vector."""
    return _fit_and_report(_vectors(spark, sf_dir), models.random_forest(), "random_forest")


@register("m9_perceptron_metrics")
def m9_perceptron_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: multilayer perceptron [n_features, 2, 2], 10 iterations."""
    v = _vectors(spark, sf_dir)
    n = len(models.feature_names(v.train, "features_assembled"))
    return _fit_and_report(v, models.perceptron(n), "multilayer_perceptron")


@register("m10_cross_validated_logistic")
def m10_cross_validated_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """27-point grid x 3 folds; the mean cross-validated AUC of each grid
    point, and the holdout metrics of the best model on its row."""
    v = _vectors(spark, sf_dir)
    cv = models.cross_validated_logistic().fit(v.train)
    held = scoring.holdout_metrics(cv.bestModel.transform(v.holdout)).first()
    best = max(range(len(cv.avgMetrics)), key=cv.avgMetrics.__getitem__)
    rows = []
    for i, (params, auc) in enumerate(zip(cv.getEstimatorParamMaps(), cv.avgMetrics)):
        p = {k.name: x for k, x in params.items()}
        mine = (held.auc, held.area_under_pr, held.accuracy) if i == best else (None, None, None)
        rows.append((int(p["maxIter"]), float(p["regParam"]), float(p["elasticNetParam"]), float(auc), i == best, *mine))
    return spark.createDataFrame(rows, "maxIter int, regParam double, elasticNetParam double, cv_auc double, best boolean, "
                                       "holdout_auc double, holdout_area_under_pr double, holdout_accuracy double")


@register("m5_bigram_gbt_importances")
def m5_bigram_gbt_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: boosted trees (10 rounds) on bigram counts; importance of every bigram."""
    kept = prep.dedup_then_require(reviews_from_documents(
        spark, sf_dir, lambda d: d.withColumn("_has_text", F.col("reviewText").isNotNull()).drop("reviewText", "summary")))
    rows = studies.with_cleaned_texts(kept.select("reviewID", "label"), texts_from_documents(spark, sf_dir))
    model = models.bigram_gbt().fit(models.spread(studies.numeric_label(rows).checkpoint(eager=True)))
    return models.feature_importances(spark, model.stages[-1], model.stages[-2].vocabulary)


@register("m19_class_weights", LT + """,
c as (select label, count(*) as n from lt group by label)
select label, n, sum(n) over () / (2.0 * n) as class_weight from c""")
def m19_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19 re-aimed: rows and weight of each class."""
    rows = models.class_weights(length_rows(spark, sf_dir).select("reviewID", "label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("class_weight").alias("class_weight"))


@register("m19_class_weighted_forest_metrics")
def m19_class_weighted_forest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19 re-aimed: class-balanced weights, random forest, holdout metrics."""
    v = _vectors(spark, sf_dir)
    v.train = models.class_weights(v.train).checkpoint(eager=True)
    return _fit_and_report(v, models.random_forest(weight_col="class_weight"), "forest_class_weighted")


@register("n5_n6_n7_tfidf_vectors")
def n5_n6_n7_tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N5 + N6 + N7 (ML form): CountVectorizer -> IDF -> MinMaxScaler on the
    filtered tokens; per review the number of non-zero TF-IDF weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from reviewlens.plans.queries_tokens import text_rows
    rows = text_rows(spark, sf_dir).select("reviewID", "filtered").checkpoint(eager=True)
    model = Pipeline(stages=textml.tfidf_stages()).fit(rows)
    out = model.transform(rows).select("reviewID", vector_to_array("idfFeatures").alias("w"),
                                       vector_to_array("scaled_idfFeatures").alias("s"))
    return out.select("reviewID", F.size("w").alias("vocab_size"),
                      F.size(F.filter("w", lambda x: x > 0)).alias("nonzero_terms"),
                      F.array_max("s").alias("max_scaled"))


@register("s3_bernoulli_sample")
def s3_bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: seeded 70 % Bernoulli sample of the reviews (the model notebook's
    first step); depends on the input partitioning, unlike the hash sample."""
    from reviewlens.sources import bernoulli_sample
    rows = reviews_from_documents(spark, sf_dir, lambda d: d.drop("reviewText", "summary"))
    return bernoulli_sample(rows, 0.7).select("reviewID", "label")
