"""Reviewer / product features: A1 + J1/J2 (counts joined back), A5/A6 + J3
(product statistics), W1 (recency order), and the model's feature build.

Scale notes
-----------
* Counts are ``groupBy`` + join back (partial aggregation on the map side), not
  ``count() over (partition by key)``: a window would sort a hot key's rows in
  one task and give null keys a count. A hot key on the detail side of the join
  is split by AQE's skew-join handling; a small side is broadcast by AQE from
  its measured runtime size.
* W1 numbers rows inside slices of a product. A product of up to
  ``SLICE_ROWS`` rows is one slice; a larger one is sliced by day and, inside a
  day, by the leading bits of the tie order, into parts of about that size. The
  offsets table has one row for each slice - close to the number of products -
  and carries the product statistics, so no task holds a hot product or day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def add_group_count(df: DataFrame, key: str, out: str) -> DataFrame:
    """A1 + J1/J2: rows per ``key`` joined back (left; a null key gets null)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, on=key, how="left")


def product_statistics(df: DataFrame, product: str = "productId", date: str = "reviewTime",
                       review_id: str = "reviewID", reviewer: str = "reviewerID",
                       deduplicated: bool = False) -> DataFrame:
    """A5 + A6: per product distinct reviews, distinct reviewers, first / last
    review date and the interval between them (D5).

    After a dedup on (reviewer, product) with unique review ids, each non-null
    reviewer and id occurs once per product, so both distinct counts are plain
    counts and the ``Expand`` of the input is skipped.
    """
    reviewers = F.count(reviewer) if deduplicated else F.count_distinct(reviewer)
    reviews = F.count(review_id) if deduplicated else F.count_distinct(review_id)
    return (
        df.groupBy(product)
        .agg(
            reviews.alias("reviews_per_product"),
            reviewers.alias("reviewers_per_product"),
            F.min(date).alias("product_earliest_review"),
            F.max(date).alias("product_latest_review"),
        )
        .withColumn("product_review_interval",
                    F.datediff("product_latest_review", "product_earliest_review"))
    )


# Rows that one slice of a product may hold, about; larger products are sliced.
SLICE_ROWS = 100_000

_KEYS = ["_kp", "_np", "_day", "_sub"]
_PRODUCT = ["_kp", "_np"]


def tie_order_key(tie: str) -> Column:
    """Deterministic tie order inside a day: md5 of the id (then the id)."""
    return F.md5(F.col(tie).cast("string"))


def _product_keys(df: DataFrame, product: str) -> DataFrame:
    """Non-null columns for a nullable product, so that joins and windows share
    one partitioning: (value or '', is null)."""
    return df.withColumns({"_kp": F.coalesce(F.col(product).cast("string"), F.lit("")), "_np": F.col(product).isNull()})


def _sliced(keyed: DataFrame, sizes: DataFrame, date: str, tie: str, slice_rows: int) -> DataFrame:
    """Adds ``_day`` and ``_sub``: slices in the order of the numbering. A product
    with one part has one slice; others have days since the latest (null dates
    last) and, by the tie order's first 32 bits, as many parts of each day."""
    parts = F.ceil(F.col("_rows") / slice_rows).cast("long")
    fraction = F.conv(F.substring(tie_order_key(tie), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    day = F.coalesce(F.datediff(F.col("_latest"), F.col(date)), F.lit(2**31 - 1))
    sub = F.coalesce(F.floor(fraction * parts), F.lit(-1))
    return keyed.join(sizes, _PRODUCT).withColumns({
        "_day": F.when(parts == 1, F.lit(0)).otherwise(day),
        "_sub": F.when(parts == 1, F.lit(0)).otherwise(sub),
    }).drop("_rows", "_latest")


def _offsets(sliced: DataFrame) -> DataFrame:
    """(keys..., _before): rows of the same product in earlier slices."""
    per_slice = sliced.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*_PRODUCT).orderBy("_day", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(*_KEYS, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def _number_rows(sliced: DataFrame, offsets: DataFrame, date: str, tie: str, out: str) -> DataFrame:
    """Join the offsets on the slice keys and number rows inside the slice with a
    window partitioned by the same keys (no further shuffle)."""
    inside = Window.partitionBy(*_KEYS).orderBy(F.desc_nulls_last(date), F.asc_nulls_first(tie_order_key(tie)),
                                                F.asc_nulls_first(tie))
    joined = sliced.join(offsets, on=_KEYS, how="inner")
    return joined.withColumn(out, (F.row_number().over(inside) + F.col("_before")).cast("int")).drop("_before", *_KEYS)


def recency_order(df: DataFrame, product: str = "productId", date: str = "reviewTime",
                  tie: str = "reviewID", out: str = "reviewOrder", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``row_number`` within product, newest first; rows of the same day
    ordered by md5(tie), then tie.

    Equal to ``row_number() over (partition by product order by date desc,
    md5(tie), tie)``: rows in earlier slices plus the rank inside the slice.
    """
    keyed = _product_keys(df, product)
    sizes = keyed.groupBy(*_PRODUCT).agg(F.count(F.lit(1)).alias("_rows"), F.max(date).alias("_latest"))
    sliced = _sliced(keyed, sizes, date, tie, slice_rows)
    return _number_rows(sliced, _offsets(sliced), date, tie, out)


def product_features(df: DataFrame, product: str = "productId", date: str = "reviewTime",
                     review_id: str = "reviewID", reviewer: str = "reviewerID",
                     deduplicated: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """J3 + W1 together: product statistics (inner join: null products vanish)
    and the recency order. One aggregate per product gives the statistics and
    the slice counts, and one join brings both to the rows."""
    keyed = _product_keys(df.where(F.col(product).isNotNull()), product)
    reviewers = F.count(reviewer) if deduplicated else F.count_distinct(reviewer)
    reviews = F.count(review_id) if deduplicated else F.count_distinct(review_id)
    sizes = keyed.groupBy(*_PRODUCT).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(date).alias("_latest"), reviews.alias("reviews_per_product"),
        reviewers.alias("reviewers_per_product"), F.min(date).alias("product_earliest_review"),
        F.max(date).alias("product_latest_review"))
    sizes = sizes.withColumn("product_review_interval", F.datediff("product_latest_review", "product_earliest_review"))
    sliced = _sliced(keyed, sizes, date, review_id, slice_rows)
    return _number_rows(sliced, _offsets(sliced.select(*_KEYS)), date, review_id, "reviewOrder")
