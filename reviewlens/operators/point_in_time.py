"""Product statistics as known at a date (M17): an as-of join of scoring rows to the training table.

Statistics fitted on the training reviews, so that a scoring row sees no later review: reviews,
distinct reviewers, first and last date of its product over the days *before* the row's own. Rule for
products not known by then (and rows without product or date): no reviews, no reviewers, an interval
of 0 and ``known`` false.

The as-of step runs over distinct (product, day) pairs, never over rows: a product has at most one
row a day there, however hot it is. Rows meet their pair by an equi-join that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STATISTICS = ("known_reviews", "known_reviewers", "known_first", "known_last")


def daily_statistics(reviews: DataFrame, product: str = "productId", date: str = "reviewTime",
                     reviewer: str = "reviewerID") -> DataFrame:
    """``product, day`` with running statistics up to and including the day; rows without product or date are left out."""
    rows = reviews.where(F.col(product).isNotNull() & F.col(date).isNotNull()).select(
        F.col(product).alias("product"), F.col(date).alias("day"), F.col(reviewer).alias("reviewer"))
    # a reviewer counts on the first day
    first = rows.where(F.col("reviewer").isNotNull()).groupBy("product", "reviewer").agg(F.min("day").alias("day"))
    new = first.groupBy("product", "day").agg(F.count(F.lit(1)).alias("new"))
    per_day = rows.groupBy("product", "day").agg(F.count(F.lit(1)).alias("n")).join(new, ["product", "day"], "left")
    until = Window.partitionBy("product").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("product", "day", F.sum("n").over(until).alias("known_reviews"),
                          F.coalesce(F.sum("new").over(until), F.lit(0)).alias("known_reviewers"),
                          F.min("day").over(until).alias("known_first"), F.col("day").alias("known_last"))


def as_known(rows: DataFrame, daily: DataFrame, product: str = "productId", date: str = "reviewTime") -> DataFrame:
    """``rows`` with the statistics of the last day before their own, ``known_interval`` and ``known``."""
    asked = rows.select(F.col(product).alias("product"), F.col(date).alias("day")).where(
        F.col("product").isNotNull() & F.col("day").isNotNull()).distinct()
    values = F.struct(*STATISTICS)
    # of equal days the question (0) comes before the statistics (1), so it sees earlier days only
    events = daily.select("product", "day", F.lit(1).alias("kind"), values.alias("s")).unionByName(
        asked.select("product", "day", F.lit(0).alias("kind"), F.lit(None).alias("s")))
    before = Window.partitionBy("product").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    answers = (events.withColumn("s", F.last("s", ignorenulls=True).over(before)).where("kind = 0")
               .select("product", "day", "s.*"))
    joined = rows.join(answers, (F.col(product) == F.col("product")) & (F.col(date) == F.col("day")), "left").drop("product", "day")
    return joined.withColumns({
        "known": F.col("known_reviews").isNotNull(),
        "known_interval": F.coalesce(F.datediff("known_last", "known_first"), F.lit(0)),
        "known_reviews": F.coalesce("known_reviews", F.lit(0)),
        "known_reviewers": F.coalesce("known_reviewers", F.lit(0))})
