"""Registered queries: bucketed review tables, point-in-time statistics, mergeable sketches,
synthetic minority rows, the logistic grid in lock step, word vectors and part-of-speech tags."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewlens.functions.constants import GRID_FOLDS, LOGISTIC_GRID
from reviewlens.operators import embeddings, logistic_grid, metrics, oversampling, point_in_time, prep, sketches, tagging
from reviewlens.plans import textml
from reviewlens.plans import sqlforms as S
from reviewlens.plans.catalog import register
from reviewlens.plans.queries_eda import LT, length_rows
from reviewlens.plans.queries_ml import _vectors
from reviewlens.plans.queries_prep import PRODUCT_ROWS, without_text
from reviewlens.plans.queries_tokens import TXT, text_rows
from reviewlens.session import checkpoint_dir
from reviewlens.sources import bucketed, reviews_from_documents, reviews_from_lineitems, scoring_from_documents
from reviewlens.sources.files import stored
from reviewlens.sources.fixtures import tagged_benchmark


# bucketed tables

def _bucketed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = os.path.join(checkpoint_dir(spark), f"bucketed-{uuid.uuid4().hex}")
    return spark.table(bucketed.write_reviews(rows, folder))


@register("j2_bucketed_product_counts", S.with_ctes(S.LINE_REVIEWS) + """
select reviewID, reviewerID, asin as productId, count(*) over (partition by asin) as productId_count from line_reviews""")
def j2_bucketed_product_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 on a table bucketed by product: counts joined back without a shuffle of the rows."""
    rows = prep.add_review_dates(reviews_from_lineitems(spark, sf_dir).withColumnRenamed("asin", "productId"))
    table = _bucketed(spark, rows.select("reviewID", "reviewerID", "productId", "reviewTime"))
    return bucketed.product_counts_joined_back(table).select("reviewID", "reviewerID", "productId", "productId_count")


@register("j3_w1_bucketed_product_features", S.with_ctes(S.LINE_REVIEWS, PRODUCT_ROWS) + """
select productId, reviewerID, reviewID, reviewTime, count(reviewID) over same as reviews_per_product,
       count(reviewerID) over same as reviewers_per_product,
       datediff('day', min(reviewTime) over same, max(reviewTime) over same) as product_review_interval,
       row_number() over (partition by productId order by reviewTime desc, md5(reviewID), reviewID) as reviewOrder
from prod window same as (partition by productId)""")
def j3_w1_bucketed_product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + W1 on a bucketed table of deduplicated reviews."""
    rows = reviews_from_lineitems(spark, sf_dir).withColumnRenamed("asin", "productId")
    rows = prep.add_review_dates(prep.dedup_latest(rows, ["reviewerID", "productId"]))
    out = bucketed.product_features(_bucketed(spark, rows.select("productId", "reviewerID", "reviewID", "reviewTime")))
    return out.select("productId", "reviewerID", "reviewID", "reviewTime", "reviews_per_product", "reviewers_per_product",
                      "product_review_interval", "reviewOrder")


# point-in-time statistics

POINT_IN_TIME = S.with_ctes(S.REVIEWS, S.SCORING) + f""",
known as (select asin as product, {S.date_of('unixReviewTime')} as day, reviewerID from reviews where label is not null),
first_seen as (select product, reviewerID, min(day) as day from known group by product, reviewerID),
daily as (
  select k.product, k.day, k.n, coalesce(f.n, 0) as new
  from (select product, day, count(*) as n from known group by product, day) k
  left join (select product, day, count(*) as n from first_seen group by product, day) f on f.product = k.product and f.day = k.day),
running as (
  select product, day, sum(n) over until as known_reviews, sum(new) over until as known_reviewers, min(day) over until as first_day
  from daily window until as (partition by product order by day)),
asked as (select reviewID, asin, {S.date_of('unixReviewTime')} as day from scoring)
select a.reviewID, coalesce(r.known_reviews, 0) as known_reviews, coalesce(r.known_reviewers, 0) as known_reviewers,
       coalesce(datediff('day', r.first_day, r.day), 0) as known_interval, r.product is not null as known
from asked a asof left join running r on a.asin = r.product and a.day > r.day"""


@register("m17_point_in_time_statistics", POINT_IN_TIME)
def m17_point_in_time_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring rows with the training table's product statistics as known before their day."""
    train = prep.add_review_dates(reviews_from_documents(spark, sf_dir, without_text).where("label is not null"))
    asked = prep.add_review_dates(scoring_from_documents(spark, sf_dir, without_text))
    daily = point_in_time.daily_statistics(train, "asin")
    return point_in_time.as_known(asked.select("reviewID", "asin", "reviewTime"), daily, "asin").select(
        "reviewID", "known_reviews", "known_reviewers", "known_interval", "known")


# sketches

@register("a9_merged_length_percentiles")
def a9_merged_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length quartiles of every segment, merged from a table of sketches by segment and day."""
    rows = length_rows(spark, sf_dir)
    fine = stored(sketches.percentile_sketches(rows, ["segment_no", "reviewTime"], "reviewTot_length"), "length-sketches")
    return sketches.quantiles(sketches.merged_percentiles(fine, ["segment_no"]))


@register("a5_merged_reviewers_per_product", S.with_ctes(S.LINE_REVIEWS) + """
select asin as productId, count(distinct reviewerID) as reviewers from line_reviews group by asin""")
def a5_merged_reviewers_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: reviewers of every product, merged from sketches by product and day (exact below 8,192 reviewers)."""
    rows = prep.add_review_dates(reviews_from_lineitems(spark, sf_dir).withColumnRenamed("asin", "productId"))
    fine = stored(sketches.distinct_sketches(rows, ["productId", "reviewTime"], "reviewerID"), "reviewer-sketches")
    return sketches.merged_distinct(fine, ["productId"]).select("productId", sketches.distinct_estimate().alias("reviewers"))


# synthetic minority rows

def _oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scalars = ["overall", "month", "day_of_week", "age", "reviewTot_length"]
    rows = textml.assembler(scalars, "features_assembled").transform(length_rows(spark, sf_dir).select("reviewID", "label", *scalars))
    rows = rows.checkpoint(eager=True)
    scaled = textml.scaler().fit(rows).transform(rows)
    return oversampling.oversample(scaled, "reviewID")


@register("m19_oversampled_class_counts", LT + """,
c as (select label, count(*) as n from lt group by label)
select label, max(n) over () as rows, max(n) over () - n as synthetic from c""")
def m19_oversampled_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every class after oversampling, and how many of them are synthetic."""
    return _oversampled(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if("synthetic").alias("synthetic"))


@register("m19_oversampled_rows")
def m19_oversampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with their synthetic companions, between which rows each lies and where."""
    return _oversampled(spark, sf_dir).select("id", "label", "synthetic", "base", "other", "share")


# the logistic grid in one iterative job

@register("m10_grid_in_lock_step")
def m10_grid_in_lock_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-validated AUC of the 27 grid points from fits in lock step; the best point's holdout metrics."""
    v = _vectors(spark, sf_dir)
    fold = F.pmod(F.xxhash64("reviewID"), F.lit(GRID_FOLDS))
    rows = logistic_grid.blocks(logistic_grid.grid_rows(v.train, "features", "label", fold)).checkpoint(eager=True)
    found, passes = logistic_grid.cross_validate(rows, LOGISTIC_GRID["regParam"], LOGISTIC_GRID["elasticNetParam"],
                                                 LOGISTIC_GRID["maxIter"], GRID_FOLDS)
    best = max(found, key=found.get)
    weights = logistic_grid.fit(rows, [logistic_grid.Problem(best[1], best[2], None)], [best[0]])[0][0][best[0]]
    held = logistic_grid.grid_rows(v.holdout, "features", "label", F.lit(0)).select("y", logistic_grid.margin("x", weights).alias("m"))
    area = metrics.area_under_roc(held, "m", "y")
    rows_out = [(*point, auc, point == best, area if point == best else None, passes)
                for point, auc in sorted(found.items())]
    return spark.createDataFrame(rows_out, "maxIter int, regParam double, elasticNetParam double, cv_auc double, best boolean, "
                                           "holdout_auc double, passes int")


# word vectors

def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(text_rows(spark, sf_dir).select("reviewID", "filtered"), "filtered-tokens")


@register("n3_positive_pmi", TXT + """,
known as (select word from (select unnest(filtered) as word from lg_filt) group by word having count(*) >= 5),
placed as (select reviewID, filtered, unnest(range(1, len(filtered) + 1)) as i from lg_filt),
once as (
  select least(filtered[i], filtered[i + d]) as a, greatest(filtered[i], filtered[i + d]) as b, count(*) as n
  from placed, range(1, 6) as x(d) where i + d <= len(filtered) group by 1, 2),
both_ways as (
  select a, b, case when a = b then 2 * n else n end as n from once union all select b, a, n from once where a <> b),
pairs as (select a, b, n from both_ways where a in (select word from known) and b in (select word from known)),
by_word as (select a as word, sum(n) as n from pairs group by a)
select a, b, p.n, ln(p.n * (select sum(n) from pairs)::double / (x.n::double * y.n)) as ppmi
from pairs p join by_word x on p.a = x.word join by_word y on p.b = y.word
where p.n * (select sum(n) from pairs)::double > x.n::double * y.n""")
def n3_positive_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive pointwise mutual information of all word pairs within five places."""
    rows = _filtered(spark, sf_dir)
    numbers = embeddings.word_numbers(rows, "filtered").checkpoint(eager=True)
    cells = embeddings.positive_cells(rows, "filtered", numbers)
    return embeddings.both_ways(cells, "a", "b", "n", "ppmi")


@register("n3_pmi_text_vectors")
def n3_pmi_text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text vectors as means of word vectors factored from the PMI table by least squares."""
    from pyspark.ml.functions import vector_to_array
    rows = _filtered(spark, sf_dir)
    vectors = embeddings.word_vectors(rows, "filtered")
    out = embeddings.text_vectors(rows, "reviewID", "filtered", vectors).select("reviewID", vector_to_array("text_vector").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("reviewID", F.size("v").alias("size"), norm.alias("norm"))


# part-of-speech tags

@register("t_part_of_speech_tags")
def t_part_of_speech_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of every word of every review, word/tag joined by spaces (the notebook's dormant tagger)."""
    transitions, emissions = tagged_benchmark(spark, sf_dir)
    emissions = emissions.checkpoint(eager=True)
    model = tagging.tagger(transitions, emissions)
    out = tagging.tag_words(text_rows(spark, sf_dir).select("reviewID", "words"), model, emissions, "reviewID", "words")
    marked = F.zip_with("words", "tags", lambda w, t: F.concat(w, F.lit("/"), t))
    return out.select("reviewID", F.size("tags").alias("n_tags"), F.array_join(marked, " ").alias("tagged_text"))
