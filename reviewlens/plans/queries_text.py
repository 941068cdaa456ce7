"""Registered queries: sentiment study (Z1-Z3, B2-B5, A3, A7, A10, A12-A16,
M11-M13 SQL forms, E3, E4, E6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.functions import bins
from reviewlens.operators import eda, metrics, prep, sentiment
from reviewlens.plans import studies
from reviewlens.plans import sqlforms as S
from reviewlens.plans.catalog import register
from reviewlens.sources import reviews_from_documents

SA = S.with_ctes(S.REVIEWS, S.sentiment_study())


def benchmark_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon over the words of the small ``benchmark`` table."""
    return sentiment.fixture_lexicon(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), "text")


def scored_reviews(spark: SparkSession, sf_dir: str, label: bool = True) -> DataFrame:
    """Reviews with flags, lengths and scores computed on the document scan."""
    lexicon = benchmark_lexicon(spark, sf_dir)
    return reviews_from_documents(spark, sf_dir, lambda d: studies.score_texts(d, lexicon), label)


def sentiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment-study rows: scores -> dedup -> null drop -> rule prediction -> bins."""
    scored = studies.scored_study(scored_reviews(spark, sf_dir))
    return scored.withColumns({
        "Predicted_Label": bins.extremity_prediction("compound_score"),
        "Bin": bins.compound_bin("compound_score"),
        "Bin_Pol": bins.polarity_bin("polarity_score"),
        "Bin_Sen": bins.subjectivity_bin("sentiment_score"),
    })


@register("z1_z3_sentiment_scores", SA + """
select reviewID, label, compound_score, polarity_score, sentiment_score from sa""")
def z1_z3_sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound, polarity and subjectivity per review (lexicon join)."""
    return sentiment_rows(spark, sf_dir).select("reviewID", "label", "compound_score", "polarity_score",
                                                "sentiment_score")


@register("e6_compound_bin_label_counts", SA + """
select Bin, label, count(*) as count from sa group by Bin, label order by Bin, label""")
def e6_compound_bin_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + A3 / E6: label counts per compound bin."""
    return eda.group_counts(sentiment_rows(spark, sf_dir), ["Bin", "label"])


@register("e4_polarity_bin_label_counts", SA + """
select Bin_Pol, label, count(*) as count from sa group by Bin_Pol, label order by Bin_Pol, label""")
def e4_polarity_bin_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 + A3 / E4: label counts per polarity bin."""
    return eda.group_counts(sentiment_rows(spark, sf_dir), ["Bin_Pol", "label"])


@register("e3_subjectivity_bin_label_counts", SA + """
select Bin_Sen, label, count(*) as count from sa group by Bin_Sen, label order by Bin_Sen, label""")
def e3_subjectivity_bin_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 + A3 / E3: label counts per subjectivity bin (float32 edges)."""
    return eda.group_counts(sentiment_rows(spark, sf_dir), ["Bin_Sen", "label"])


@register("e4_helpful_rate_by_polarity_bin", SA + """
select Bin_Pol, count(*) as n, avg(cast(label as double)) as helpful_rate from sa group by Bin_Pol order by Bin_Pol""")
def e4_helpful_rate_by_polarity_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helpful rate per polarity bin."""
    return eda.helpful_rate_by(sentiment_rows(spark, sf_dir), "Bin_Pol")


@register("e3_helpful_rate_by_subjectivity_bin", SA + """
select Bin_Sen, count(*) as n, avg(cast(label as double)) as helpful_rate from sa group by Bin_Sen order by Bin_Sen""")
def e3_helpful_rate_by_subjectivity_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helpful rate per subjectivity bin."""
    return eda.helpful_rate_by(sentiment_rows(spark, sf_dir), "Bin_Sen")


@register("a12_compound_bin_pivot", SA + """
select Bin, count(*) filter (where label = 0) as label_0, count(*) filter (where label = 1) as label_1
from sa group by Bin order by Bin""")
def a12_compound_bin_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compound bin x label counts, pivoted and zero-filled."""
    return eda.pivot_counts(sentiment_rows(spark, sf_dir), "Bin", "label", [0, 1])


@register("a10_predicted_label_value_counts", SA + """
select Predicted_Label, count(*) as count from sa group by Predicted_Label order by count desc, Predicted_Label""")
def a10_predicted_label_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + B5: value counts of the rule prediction."""
    return eda.value_counts(sentiment_rows(spark, sf_dir), "Predicted_Label")


@register("a14_confusion_matrix", SA + """
, cells as (select l.label, p.predicted from (values (0), (1)) l(label), (values (0), (1)) p(predicted))
select c.label, c.predicted, count(sa.reviewID) as n
from cells c left join sa on sa.label = c.label and sa.Predicted_Label = c.predicted
group by c.label, c.predicted""".replace("\n, cells", ",\ncells"))
def a14_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix of the |compound| > 0.5 rule (all four cells)."""
    return metrics.confusion_matrix(sentiment_rows(spark, sf_dir), "label", "Predicted_Label")


@register("a15_rule_accuracy", SA + """
select avg(case when label = Predicted_Label then 1.0 else 0.0 end) as accuracy from sa where label is not null""")
def a15_rule_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the rule classifier."""
    return metrics.accuracy(sentiment_rows(spark, sf_dir), "label", "Predicted_Label")


REPORT_SQL = SA + """
, c as (select count(*) filter (where label = 0 and Predicted_Label = 0) as tn,
              count(*) filter (where label = 0 and Predicted_Label = 1) as fp,
              count(*) filter (where label = 1 and Predicted_Label = 0) as fn,
              count(*) filter (where label = 1 and Predicted_Label = 1) as tp from sa),
r as (select coalesce(tn / nullif(cast(tn + fn as double), 0), 0) as p0,
             coalesce(tn / nullif(cast(tn + fp as double), 0), 0) as r0,
             coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as p1,
             coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as r1,
             tn + fp as s0, tp + fn as s1, tn + fp + tp + fn as n,
             coalesce((tn + tp) / nullif(cast(tn + fp + tp + fn as double), 0), 0) as acc from c),
f as (select *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) as f0,
                coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) as f1,
                coalesce(s0 / nullif(cast(n as double), 0), 0) as w0,
                coalesce(s1 / nullif(cast(n as double), 0), 0) as w1 from r)
""".replace("\n, c as", ",\nc as")


@register("a16_classification_report", REPORT_SQL + """
select '0' as class, p0 as precision, r0 as recall, f0 as f1_score, s0 as support from f
union all select '1', p1, r1, f1, s1 from f
union all select 'accuracy', null, null, acc, n from f
union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from f
union all select 'weighted avg', w0 * p0 + w1 * p1, w0 * r0 + w1 * r1, w0 * f0 + w1 * f1, n from f""")
def a16_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision / recall / F1 / support per class, accuracy, averages."""
    return metrics.classification_report(sentiment_rows(spark, sf_dir), "label", "Predicted_Label")


@register("m12_m13_rule_metrics", REPORT_SQL + """
select acc as accuracy, w0 * p0 + w1 * p1 as weighted_precision, w0 * r0 + w1 * r1 as weighted_recall from f""")
def m12_m13_rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + M13: accuracy, weighted precision and recall via Spark ML's
    evaluator on the rule predictions."""
    with prep.persisted(sentiment_rows(spark, sf_dir).select("label", "Predicted_Label")) as rows:
        vals = [metrics.multiclass_metric(rows, m, "label", "Predicted_Label")
                for m in ("accuracy", "weightedPrecision", "weightedRecall")]
    return spark.createDataFrame([tuple(vals)], "accuracy double, weighted_precision double, weighted_recall double")


@register("a7_compound_corr", SA + """
select covar_pop(cast(compound_score as double), cast(label as double))
       / (stddev_pop(cast(compound_score as double)) * stddev_pop(cast(label as double))) as corr_compound_label
from sa""")
def a7_compound_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the compound score with the label."""
    rows = sentiment_rows(spark, sf_dir)
    return rows.agg(eda.safe_corr(F.col("compound_score").cast("double"), "label").alias("corr_compound_label"))


@register("a13_compound_histogram", SA + ", " + S.histogram_sql("sa", "compound_score"))
def a13_compound_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-bin histogram of the compound score."""
    return eda.histogram(sentiment_rows(spark, sf_dir), "compound_score")


@register("a13_polarity_histogram", SA + ", " + S.histogram_sql("sa", "polarity_score"))
def a13_polarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-bin histogram of the polarity score."""
    return eda.histogram(sentiment_rows(spark, sf_dir), "polarity_score")


@register("a13_subjectivity_histogram", SA + ", " + S.histogram_sql("sa", "sentiment_score"))
def a13_subjectivity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-bin histogram of the subjectivity score."""
    return eda.histogram(sentiment_rows(spark, sf_dir), "sentiment_score")


def _auc_frame(spark: SparkSession, value: float) -> DataFrame:
    return spark.createDataFrame([(float(value),)], "auc double")


@register("m11_auc_compound", SA + ", " + S.auc_sql("sa", "compound_score"))
def m11_auc_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact area under ROC of the compound score against the label."""
    return _auc_frame(spark, metrics.area_under_roc(sentiment_rows(spark, sf_dir), "compound_score"))


@register("m11_auc_polarity", SA + ", " + S.auc_sql("sa", "polarity_score"))
def m11_auc_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact area under ROC of the polarity score."""
    return _auc_frame(spark, metrics.area_under_roc(sentiment_rows(spark, sf_dir), "polarity_score"))
