"""Registered queries: sources, prep, dates, dedup, joins, windows (S1-S3, P1-P11,
D1-D5, J1-J3, A1, A5, A6, A17, W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.functions import dates, text
from reviewlens.operators import features, prep
from reviewlens.plans import sqlforms as S
from reviewlens.plans.catalog import register
from reviewlens.sources import (
    hash_fraction,
    hash_sample,
    reviews_from_documents,
    reviews_from_lineitems,
    scoring_from_documents,
)

W = S.with_ctes


def without_text(d: DataFrame) -> DataFrame:
    """For queries that use no text: it is dropped on the document scan."""
    return prep.drop_columns(d, ["reviewText", "summary"])


def text_flags(d: DataFrame) -> DataFrame:
    """Null marks instead of the texts, computed on the document scan."""
    return d.withColumns({c: F.when(F.col(c).isNotNull(), F.lit("")) for c in ("reviewText", "summary")})


@register("s1_scan_reviews", W(S.REVIEWS) + "select * from reviews")
def s1_scan_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training table view (explicit columns, whole texts)."""
    return reviews_from_documents(spark, sf_dir)


@register("s2_scan_scoring", W(S.SCORING) + "select * from scoring")
def s2_scan_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring table view (documents without a label)."""
    return scoring_from_documents(spark, sf_dir)


@register("s3_hash_sample", W(S.REVIEWS) + """
select reviewID, reviewerID, label,
       cast(cast('0x' || substring(md5(reviewID), 1, 4) as bigint) % 10 as bigint) as bucket
from reviews
where cast('0x' || substring(md5(reviewID), 1, 4) as bigint) % 10 < 7""")
def s3_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 / M2: repeatable 70 % sample on a key hash."""
    r = reviews_from_documents(spark, sf_dir, without_text)
    return hash_sample(r, "reviewID", 7).select("reviewID", "reviewerID", "label",
                                                  hash_fraction("reviewID").alias("bucket"))


@register("m2_hash_split_counts", W(S.REVIEWS) + """
select case when cast('0x' || substring(md5(reviewID), 1, 4) as bigint) % 10 < 8
            then 'train' else 'holdout' end as part,
       count(*) as rows, count(label) as labelled
from reviews group by 1""")
def m2_hash_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: sizes of the repeatable 80/20 split."""
    r = reviews_from_documents(spark, sf_dir, without_text)
    part = F.when(hash_fraction("reviewID") < 8, "train").otherwise("holdout")
    return r.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"),
                                             F.count("label").alias("labelled"))


@register("p1_review_columns", W(S.REVIEWS) + f"""
select reviewID, reviewerID, asin as productId, cast(verified as bigint) as verified, overall, label,
       {S.date_of('unixReviewTime')} as reviewTime,
       year({S.date_of('unixReviewTime')}) as year,
       month({S.date_of('unixReviewTime')}) as month,
       dayofweek({S.date_of('unixReviewTime')}) + 1 as day_of_week,
       2023 - year({S.date_of('unixReviewTime')}) as age,
       {S.combined()} as reviewTot
from reviews""")
def p1_review_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1/P2/P5/P7/P8 + D1-D4 + T1/T2: computed columns in one projection."""
    r = reviews_from_documents(spark, sf_dir)
    r = prep.cast_verified(r).withColumnRenamed("asin", "productId")
    r = prep.add_review_dates(r).withColumn("reviewTot", text.combine_text("reviewText", "summary"))
    return r.select("reviewID", "reviewerID", "productId", "verified", "overall", "label",
                    "reviewTime", F.col("year").cast("bigint").alias("year"),
                    F.col("month").cast("bigint").alias("month"),
                    F.col("day_of_week").cast("bigint").alias("day_of_week"),
                    F.col("age").cast("bigint").alias("age"), "reviewTot")


@register("p9_drop_missing", W(S.REVIEWS) + """
select reviewID, label from reviews where reviewText is not null and label is not null""")
def p9_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with text and label."""
    r = reviews_from_documents(spark, sf_dir, text_flags)
    return prep.drop_missing(r, ["reviewText", "label"]).select("reviewID", "label")


@register("p10_dedup_reviews", W(S.REVIEWS, S.dedup("reviews")) + """
select reviewID, reviewerID, asin, unixReviewTime from dedup""")
def p10_dedup_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: one review per (reviewer, product): latest, then smallest id."""
    r = reviews_from_documents(spark, sf_dir, without_text)
    return prep.dedup_latest(r, ["reviewerID", "asin"]).select("reviewID", "reviewerID", "asin", "unixReviewTime")


@register("p10_dedup_line_reviews", W(S.LINE_REVIEWS, S.dedup("line_reviews")) + """
select reviewerID, asin, unixReviewTime, reviewID from dedup""")
def p10_dedup_line_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 at volume (line items): keys, latest time and the surviving id."""
    r = reviews_from_lineitems(spark, sf_dir)
    return prep.dedup_latest(r, ["reviewerID", "asin"]).select("reviewerID", "asin", "unixReviewTime", "reviewID")


@register("p11_quality_report", W(S.REVIEWS) + """
select count(*) as rows, (select count(*) from (select distinct reviewerID, asin from reviews)) as distinct_keys,
       count(*) filter (where reviewText is null) as null_reviewText,
       count(*) filter (where summary is null) as null_summary,
       count(*) filter (where label is null) as null_label
from reviews""")
def p11_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct (reviewer, product) keys and nulls, one pass."""
    r = reviews_from_documents(spark, sf_dir, text_flags)
    return prep.quality_report(r, ["reviewerID", "asin"], ["reviewText", "summary", "label"])


@register("a17_row_counts", W(S.LINE_REVIEWS, S.dedup("line_reviews")) + """
select (select count(*) from line_reviews) as rows_before, (select count(*) from dedup) as rows_after""")
def a17_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after the dedup (line-item reviews)."""
    return prep.dedup_row_counts(reviews_from_lineitems(spark, sf_dir), ["reviewerID", "asin"])


@register("d5_review_dates", W(S.LINE_REVIEWS) + f"""
select reviewID, {S.date_of('unixReviewTime')} as reviewTime,
       year({S.date_of('unixReviewTime')}) as year, month({S.date_of('unixReviewTime')}) as month,
       dayofweek({S.date_of('unixReviewTime')}) + 1 as day_of_week,
       2023 - year({S.date_of('unixReviewTime')}) as age,
       datediff('day', date '2000-01-01', {S.date_of('unixReviewTime')}) as days_since_2000
from line_reviews""")
def d5_review_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D5 at volume: date, parts, age and a day difference."""
    r = reviews_from_lineitems(spark, sf_dir)
    r = prep.add_review_dates(r)
    return r.select("reviewID", "reviewTime", *[F.col(c).cast("bigint").alias(c) for c in
                                                  ("year", "month", "day_of_week", "age")],
                    dates.days_between("reviewTime", F.lit("2000-01-01").cast("date"))
                    .cast("bigint").alias("days_since_2000"))


@register("a1_reviewer_counts", W(S.LINE_REVIEWS) + """
select reviewerID, count(*) as review_count from line_reviews group by reviewerID""")
def a1_reviewer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: reviews per reviewer (partial + final hash aggregate)."""
    r = reviews_from_lineitems(spark, sf_dir)
    return r.groupBy("reviewerID").agg(F.count(F.lit(1)).alias("review_count"))


@register("j1_j2_counts_joined_back", W(S.LINE_REVIEWS) + """
, rc as (select reviewerID, count(*) as review_count from line_reviews group by reviewerID),
  pc as (select asin as productId, count(*) as productId_count from line_reviews group by asin)
select r.reviewID, r.reviewerID, r.asin as productId, rc.review_count, pc.productId_count
from line_reviews r left join rc on r.reviewerID = rc.reviewerID
left join pc on r.asin = pc.productId""".replace("\n, rc", ",\nrc"))
def j1_j2_counts_joined_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J2 (+ P5 rename): reviewer and product counts joined back (left)."""
    r = reviews_from_lineitems(spark, sf_dir)
    r = features.add_group_count(r, "reviewerID", "review_count").withColumnRenamed("asin", "productId")
    r = features.add_group_count(r, "productId", "productId_count")
    return r.select("reviewID", "reviewerID", "productId", "review_count", "productId_count")


PRODUCT_ROWS = f"""{S.dedup('line_reviews')},
prod as (select reviewID, reviewerID, asin as productId, {S.date_of('unixReviewTime')} as reviewTime
         from dedup)"""


@register("a5_a6_product_statistics", W(S.LINE_REVIEWS, PRODUCT_ROWS) + """
select productId, count(distinct reviewID) as reviews_per_product,
       count(distinct reviewerID) as reviewers_per_product,
       min(reviewTime) as product_earliest_review, max(reviewTime) as product_latest_review,
       datediff('day', min(reviewTime), max(reviewTime)) as product_review_interval
from prod group by productId""")
def a5_a6_product_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A6 + D5: distinct reviews / reviewers, first / last date per product."""
    r = reviews_from_lineitems(spark, sf_dir).withColumnRenamed("asin", "productId")
    r = prep.add_review_dates(prep.dedup_latest(r, ["reviewerID", "productId"]))
    st = features.product_statistics(r, deduplicated=True)
    return st.select("productId", "reviews_per_product", "reviewers_per_product", "product_earliest_review",
                     "product_latest_review", F.col("product_review_interval").cast("bigint").alias("product_review_interval"))


@register("j3_w1_product_features", W(S.LINE_REVIEWS, PRODUCT_ROWS) + """
, st as (select productId, count(distinct reviewID) as reviews_per_product,
              count(distinct reviewerID) as reviewers_per_product,
              datediff('day', min(reviewTime), max(reviewTime)) as product_review_interval
       from prod group by productId)
select p.productId, p.reviewerID, p.reviewID, p.reviewTime, st.reviews_per_product, st.reviewers_per_product,
       st.product_review_interval,
       row_number() over (partition by p.productId order by p.reviewTime desc, md5(p.reviewID), p.reviewID) as reviewOrder
from prod p join st on p.productId = st.productId""".replace("\n, st", ",\nst"))
def j3_w1_product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 (inner join back) + W1 (recency order) after the dedup, at volume."""
    r = reviews_from_lineitems(spark, sf_dir).withColumnRenamed("asin", "productId")
    r = prep.add_review_dates(prep.dedup_latest(r, ["reviewerID", "productId"]))
    out = features.product_features(r.select("productId", "reviewerID", "reviewID", "reviewTime"),
                                    deduplicated=True)
    return out.select("productId", "reviewerID", "reviewID", "reviewTime", "reviews_per_product",
                      "reviewers_per_product",
                      F.col("product_review_interval").cast("bigint").alias("product_review_interval"),
                      F.col("reviewOrder").cast("bigint").alias("reviewOrder"))


@register("w1_recency_order_hot_products", W(S.REVIEWS) + f"""
select reviewID, asin as productId, {S.date_of('unixReviewTime')} as reviewTime,
       row_number() over (partition by asin order by {S.date_of('unixReviewTime')} desc, md5(reviewID), reviewID) as reviewOrder
from reviews""")
def w1_recency_order_hot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on the document reviews: only 20 products, so every product is a hot
    group; the two-level order never holds a whole product in one task."""
    r = prep.add_review_dates(reviews_from_documents(spark, sf_dir, without_text)).withColumnRenamed("asin", "productId")
    out = features.recency_order(r.select("reviewID", "productId", "reviewTime"))
    return out.select("reviewID", "productId", "reviewTime", F.col("reviewOrder").cast("bigint").alias("reviewOrder"))


@register("p3_drop_list", W(S.LINE_REVIEWS) + """
select reviewID, reviewerID, overall from line_reviews""")
def p3_drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection by a list of columns to drop."""
    return prep.drop_columns(reviews_from_lineitems(spark, sf_dir), ["asin", "verified", "unixReviewTime", "image", "style"])
