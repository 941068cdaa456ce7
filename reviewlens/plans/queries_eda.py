"""Registered queries: length study, sentiment study, EDA and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlens.operators import eda, prep
from reviewlens.plans import sqlforms as S
from reviewlens.plans.catalog import register
from reviewlens.sources import reviews_from_documents


def length_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lengths and segments are computed on the document scan: no text in the joins
    return prep.dedup_then_require(reviews_from_documents(spark, sf_dir, prep.length_columns))


LT = S.with_ctes(S.REVIEWS, S.LENGTH_STUDY)


@register("e5_helpful_rate_by_length", LT + """
select segment_no, reviewTot_segment, count(*) as n, round(avg(cast(label as double)), 6) as helpful_rate
from lt group by segment_no, reviewTot_segment order by segment_no""")
def e5_helpful_rate_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 / A4 / B1 / O2: helpful rate per length segment, segment order."""
    return eda.segment_rates(length_rows(spark, sf_dir))


@register("a2_segment_counts", LT + """
select segment_no, reviewTot_segment, count(*) as count from lt
group by segment_no, reviewTot_segment order by segment_no""")
def a2_segment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 / O1: rows per length segment, ordered by segment number."""
    return eda.group_counts(length_rows(spark, sf_dir), ["segment_no", "reviewTot_segment"], "segment_no")


@register("a7_a8_a9_length_summary", LT + """
select count(reviewTot_length) as count, avg(reviewTot_length) as mean, stddev_samp(reviewTot_length) as stddev,
       min(reviewTot_length) as min, max(reviewTot_length) as max,
       covar_pop(reviewTot_length, cast(label as double))
         / (stddev_pop(reviewTot_length) * stddev_pop(cast(label as double))) as corr_label,
       quantile_disc(reviewTot_length, 0.25) as p25, quantile_disc(reviewTot_length, 0.5) as p50,
       quantile_disc(reviewTot_length, 0.75) as p75
from lt""")
def a7_a8_a9_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + A8 + A9: correlation with the label, describe and quartiles, one pass."""
    return eda.length_summary(length_rows(spark, sf_dir))


@register("a8_describe_length", LT + """
select count(reviewTot_length) as count, avg(reviewTot_length) as mean, stddev_samp(reviewTot_length) as stddev,
       min(reviewTot_length) as min, max(reviewTot_length) as max from lt""")
def a8_describe_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed describe of the review length."""
    return eda.describe_column(length_rows(spark, sf_dir), "reviewTot_length")


@register("a9_length_percentiles", LT + """
select quantile_disc(reviewTot_length, 0.25) as p25, quantile_disc(reviewTot_length, 0.5) as p50,
       quantile_disc(reviewTot_length, 0.75) as p75 from lt""")
def a9_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate quartiles of the review length."""
    return eda.percentiles(length_rows(spark, sf_dir), "reviewTot_length")


@register("e1_helpful_rate_by_year", LT + """
select year, count(*) as n, avg(cast(label as double)) as helpful_rate from lt group by year order by year""")
def e1_helpful_rate_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and helpful rate per review year."""
    return eda.helpful_rate_by(length_rows(spark, sf_dir), "year")


@register("e1_helpful_rate_by_age", LT + """
select age, count(*) as n, avg(cast(label as double)) as helpful_rate from lt group by age order by age""")
def e1_helpful_rate_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and helpful rate per review age (2023 - year)."""
    return eda.helpful_rate_by(length_rows(spark, sf_dir), "age")


@register("e1_helpful_rate_by_month", LT + """
select month, count(*) as n, avg(cast(label as double)) as helpful_rate from lt group by month order by month""")
def e1_helpful_rate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and helpful rate per calendar month."""
    return eda.helpful_rate_by(length_rows(spark, sf_dir), "month")


@register("e1_helpful_rate_by_day_of_week", LT + """
select day_of_week, count(*) as n, avg(cast(label as double)) as helpful_rate from lt
group by day_of_week order by day_of_week""")
def e1_helpful_rate_by_day_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and helpful rate per day of week (1 = Sunday)."""
    return eda.helpful_rate_by(length_rows(spark, sf_dir), "day_of_week")


@register("e2_length_ratio", LT + """
, by_label as (select label, avg(cast(reviewTot_length as double)) as mean_length from lt group by label)
select max(case when label = 1 then mean_length end) as mean_length_helpful,
       max(case when label = 0 then mean_length end) as mean_length_not_helpful,
       max(case when label = 1 then mean_length end) / max(case when label = 0 then mean_length end) as ratio
from by_label""".replace("\n, by_label", ",\nby_label"))
def e2_length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length helpful vs not helpful, and the ratio."""
    return eda.length_ratio(length_rows(spark, sf_dir), "reviewTot_length")


@register("a10_label_value_counts", LT + """
select label, count(*) as count from lt where label is not null group by label order by count desc, label""")
def a10_label_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: label value counts."""
    return eda.value_counts(length_rows(spark, sf_dir), "label")


@register("a13_length_histogram", LT + ", " + S.histogram_sql("lt", "reviewTot_length"))
def a13_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-bin equal-width histogram of the review length."""
    return eda.histogram(length_rows(spark, sf_dir), "reviewTot_length")


@register("m11_auc_length", LT + ", " + S.auc_sql("lt", "reviewTot_length"))
def m11_auc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact area under ROC of the review length against the label
    (what a one-feature logistic regression ranks by, up to direction)."""
    from reviewlens.operators import metrics
    auc = metrics.area_under_roc(length_rows(spark, sf_dir), "reviewTot_length")
    return spark.createDataFrame([(float(auc),)], "auc double")


LENGTH_ROW_SCHEMA = "reviewID string, label int, reviewTot_length int, segment_no int, reviewTot_segment string"


@register("s8_s6_length_rows_csv_round_trip", LT + """
select reviewID, label, reviewTot_length, segment_no, reviewTot_segment from lt""")
def s8_s6_length_rows_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + S6: length-study rows written as CSV (one file per partition,
    parallel) under the checkpoint directory and read back with a schema."""
    import os
    import uuid

    from reviewlens.session import checkpoint_dir
    from reviewlens.sources import read_csv, write_csv

    path = os.path.join(checkpoint_dir(spark), f"length-rows-{uuid.uuid4().hex}.csv")
    rows = length_rows(spark, sf_dir).select("reviewID", "label", "reviewTot_length", "segment_no",
                                             "reviewTot_segment")
    write_csv(rows, path)
    return read_csv(spark, path, LENGTH_ROW_SCHEMA)


@register("m14_pr_length", LT + """,
sc as (select cast(reviewTot_length as double) as s, label as y from lt where label is not null),
g as (select s, count(*) filter (where y = 1) as pos, count(*) as n from sc group by s),
c as (select s, sum(pos) over w as tp, sum(n) over w as k, row_number() over (order by s desc) as i from g
      window w as (order by s desc rows between unbounded preceding and current row)),
tot as (select cast(sum(pos) as double) as p from g),
pt as (select i, tp / p as recall, tp / cast(k as double) as prec from c, tot
       union all select 0, 0.0, tp / cast(k as double) from c where i = 1)
select sum((recall - prev_recall) * (prec + prev_prec) / 2) as area_under_pr
from (select recall, prec, lag(recall) over (order by i) as prev_recall, lag(prec) over (order by i) as prev_prec from pt)""")
def m14_pr_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the precision-recall curve of the review length."""
    from reviewlens.operators import metrics
    value = metrics.area_under_pr(length_rows(spark, sf_dir), "reviewTot_length")
    return spark.createDataFrame([(float(value),)], "area_under_pr double")
