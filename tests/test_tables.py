"""Bucketed tables, point-in-time statistics and sketches."""

import datetime as dt
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import features, point_in_time as pit, sketches as sk
from reviewlens.session import checkpoint_dir
from reviewlens.sources import bucketed


def reviews(spark, n=600):
    rows = [(f"r{i}", f"u{i * 7 % 90}", None if i % 97 == 0 else "hot" if i % 3 else f"p{i % 11}",
             None if i % 53 == 0 else dt.date(2020, 1, 1) + dt.timedelta(days=i * 13 % 40)) for i in range(n)]
    return spark.createDataFrame(rows, "reviewID string, reviewerID string, productId string, reviewTime date")


def folder(spark):
    return os.path.join(checkpoint_dir(spark).removeprefix("file:"), f"bucketed-{uuid.uuid4().hex}")


@pytest.mark.parametrize("slice_rows", [10, 100_000])
def test_bucketed_results_equal_the_shuffled_ones(spark, slice_rows):
    df = reviews(spark)
    name = bucketed.write_reviews(df, folder(spark), buckets=8, slice_rows=slice_rows)
    rows = spark.table(name)
    counted = bucketed.product_counts_joined_back(rows).select(*df.columns, "productId_count")
    assert sorted(map(str, counted.collect())) == sorted(map(str, features.add_group_count(df, "productId", "productId_count")
                                                         .select(*df.columns, "productId_count").collect()))
    got = bucketed.product_features(rows)
    want = features.product_features(df, deduplicated=True, slice_rows=slice_rows).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if slice_rows == 10:  # a hot product lies in many buckets
        assert rows.where("productId = 'hot'").select("slice").distinct().count() > 20


def detail_exchanges(df):
    """Inputs of exchanges that carry the review id."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert inputs
    return [x for x in inputs if "reviewID#" in x]


def test_no_exchange_on_the_detail_side(spark):
    name = bucketed.write_reviews(reviews(spark), folder(spark), buckets=8)
    for df in (bucketed.product_counts_joined_back(spark.table(name)), bucketed.product_features(spark.table(name))):
        assert "SelectedBucketsCount: 8 out of 8" in df._jdf.queryExecution().executedPlan().toString()
        assert detail_exchanges(df) == []


def test_folder_opens_again(spark):
    place = folder(spark)
    name = bucketed.write_reviews(reviews(spark), place, buckets=8)
    n = spark.table(name).count()
    spark.sql(f"drop table {name}")
    again = bucketed.open_reviews(spark, place, "reviewID string, reviewerID string, productId string, reviewTime date, slice long", buckets=8)
    assert spark.table(again).count() == n == 600
    assert detail_exchanges(bucketed.product_features(spark.table(again))) == []


def test_point_in_time_against_plain_loops(spark):
    train, asked = reviews(spark), reviews(spark, 200).withColumn("productId", F.when(F.col("reviewID") == "r4", "new").otherwise(F.col("productId")))
    got = {r.reviewID: r for r in pit.as_known(asked, pit.daily_statistics(train)).collect()}
    rows = train.collect()
    assert len(got) == 200
    for q in asked.collect():
        seen = [r for r in rows if r.productId is not None and r.productId == q.productId and r.reviewTime is not None
                and q.reviewTime is not None and r.reviewTime < q.reviewTime]
        r = got[q.reviewID]
        assert (r.known, r.known_reviews, r.known_reviewers) == (bool(seen), len(seen), len({x.reviewerID for x in seen}))
        days = [x.reviewTime for x in seen]
        assert r.known_interval == ((max(days) - min(days)).days if days else 0)
        assert (r.known_first, r.known_last) == ((min(days), max(days)) if days else (None, None))
    assert pit.as_known(asked.limit(0), pit.daily_statistics(train)).count() == 0
    assert all(not r.known for r in pit.as_known(asked, pit.daily_statistics(train.limit(0))).collect())


def test_percentile_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("v"), (F.col("id") % 5).alias("segment"),
                                    (F.col("id") % 31).alias("day")).repartition(5)
    fine = sk.percentile_sketches(df, ["segment", "day"], "v")
    probs = (0.01, 0.25, 0.5, 0.75, 0.99)
    for groups, rows in ((["segment"], 5), ([], 1)):
        merged = sk.quantiles(sk.merged_percentiles(fine, groups), probs).collect()
        rebuilt = sk.quantiles(sk.percentile_sketches(df, groups, "v"), probs).collect()
        assert len(merged) == len(rebuilt) == rows
        for table in (merged, rebuilt):
            for r in table:
                values = df.where(f"segment = {r.segment}") if groups else df
                for p in probs:
                    share = values.where(F.col("v") <= r[f"p{round(100 * p)}"]).count() / r.n
                    assert abs(share - p) <= sk.KLL_RANK_ERROR
    small = sk.merged_percentiles(sk.percentile_sketches(df.where("v < 90"), ["day"], "v"), [])
    assert sk.quantiles(small, (0.5,)).first().p50 in (44, 45) and small.first().n == 90
    assert sk.merged_percentiles(small, []).select(sk.rank_share(F.lit(44)).alias("s")).first().s == pytest.approx(0.5, abs=0.02)


def test_distinct_sketches_merge_within_their_error(spark):
    df = spark.range(80_000).select((F.col("id") * 31 % 30_000).alias("v"), (F.col("id") % 3).alias("product"), (F.col("id") % 7).alias("day"))
    fine = sk.distinct_sketches(df, ["product", "day"], "v")
    merged = {r["product"]: r.e for r in sk.merged_distinct(fine, ["product"]).select("product", sk.distinct_estimate().alias("e")).collect()}
    exact = {r["product"]: r.n for r in df.groupBy("product").agg(F.count_distinct("v").alias("n")).collect()}
    assert all(abs(merged[k] - n) <= sk.THETA_ERROR * n for k, n in exact.items())
    few = sk.merged_distinct(sk.distinct_sketches(df.where("v < 500"), ["product", "day"], "v"), [])
    assert few.select(sk.distinct_estimate().alias("e")).first().e == 500
    a = sk.merged_distinct(sk.distinct_sketches(df.where("v < 900"), ["day"], "v").withColumn("g", F.lit(1)), ["g"])
    b = sk.merged_distinct(sk.distinct_sketches(df.where("v between 600 and 1499"), ["day"], "v").withColumn("g", F.lit(1)), ["g"])
    r = sk.overlap(a, b, ["g"]).first()
    assert (r.either, r.both, r.left_only) == (1500, 300, 600)
