"""Review tables bucketed by product (J1-J3, W1 without a shuffle of the rows).

``write_reviews`` stores a review table once, bucketed by (product, slice) and sorted by date.
A product is one slice unless it holds over ``slice_rows`` rows; then it has a slice for each
day and, inside a day, for each part of the tie order, so one hot product fills many buckets.
Counts, statistics and the recency order then read whole buckets as they lie: what is shuffled
is one row a (product, slice).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewlens.operators.features import SLICE_ROWS, tie_order_key

BUCKETS = 64
KEY = ["productId", "slice"]


def _slices(df: DataFrame, product: str, date: str, tie: str, slice_rows: int) -> DataFrame:
    """``df`` with ``slice``: 0, or for large products a number that rises in recency order."""
    sizes = df.groupBy(F.col(product).alias("_p")).agg(F.count(F.lit(1)).alias("_rows"), F.max(date).alias("_latest"))
    joined = df.join(sizes, F.col(product).eqNullSafe(F.col("_p")))
    parts = F.ceil(F.col("_rows") / slice_rows).cast("long")
    day = F.coalesce(F.datediff(F.col("_latest"), F.col(date)), F.lit(1 << 20)).cast("long")  # rows without a date last
    share = F.conv(F.substring(tie_order_key(tie), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sub = F.coalesce(F.floor(share * parts), F.lit(0)).cast("long")
    return joined.withColumn("slice", F.when(parts == 1, F.lit(0)).otherwise(1 + day * (parts + 1) + sub).cast("long")).drop(
        "_p", "_rows", "_latest")


def write_reviews(df: DataFrame, folder: str, product: str = "productId", date: str = "reviewTime", tie: str = "reviewID",
                  buckets: int = BUCKETS, slice_rows: int = SLICE_ROWS) -> str:
    """Writes ``df`` to ``folder`` and returns the table's name in this session's catalog.

    The folder outlives the session; ``open_reviews`` names it again. Each task writes one bucket.
    """
    spark = df.sparkSession
    name = table_name(folder)
    rows = _slices(df, product, date, tie, slice_rows).withColumnRenamed(product, "productId")
    (rows.repartition(buckets, *KEY).write.mode("overwrite").option("path", folder).format("parquet")
     .bucketBy(buckets, *KEY).sortBy("productId", "slice", date).saveAsTable(name))
    return name


def table_name(folder: str) -> str:
    return "bucketed_reviews_" + hashlib.md5(folder.encode()).hexdigest()


def open_reviews(spark: SparkSession, folder: str, schema: str, date: str = "reviewTime", buckets: int = BUCKETS) -> str:
    """Names a folder written earlier; ``schema`` in DDL, with ``productId`` and ``slice``."""
    name = table_name(folder)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (productId, slice) "
              f"SORTED BY (productId, slice, {date}) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return name


def product_counts_joined_back(rows: DataFrame, out: str = "productId_count") -> DataFrame:
    """J2 on a bucketed table: rows per product on every row (a null product gets null)."""
    per_slice = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("productId")
    sums = per_slice.select(*KEY, F.sum("_n").over(whole).alias(out))
    return rows.join(sums.hint("merge"), KEY, "left").drop("slice")


def product_features(rows: DataFrame, date: str = "reviewTime", tie: str = "reviewID", reviewer: str = "reviewerID") -> DataFrame:
    """J3 + W1 on a bucketed table of deduplicated reviews: statistics and recency order on every row.

    Rows without a product vanish. Per-slice aggregates and the numbering stay in their buckets; offsets and
    statistics are windows over one row a slice.
    """
    rows = rows.where(F.col("productId").isNotNull())
    per_slice = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.count(tie).alias("_reviews"),
                                       F.count(reviewer).alias("_reviewers"), F.min(date).alias("_first"), F.max(date).alias("_last"))
    whole = Window.partitionBy("productId")
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    stats = per_slice.select(
        *KEY, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_reviews").over(whole).alias("reviews_per_product"), F.sum("_reviewers").over(whole).alias("reviewers_per_product"),
        F.min("_first").over(whole).alias("product_earliest_review"), F.max("_last").over(whole).alias("product_latest_review"))
    stats = stats.withColumn("product_review_interval", F.datediff("product_latest_review", "product_earliest_review"))
    inside = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last(date), F.asc_nulls_first(tie_order_key(tie)), F.asc_nulls_first(tie))
    joined = rows.join(stats.hint("merge"), KEY)
    return joined.withColumn("reviewOrder", (F.row_number().over(inside) + F.col("_before")).cast("int")).drop("_before", "slice")
