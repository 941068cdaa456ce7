"""Global running totals by two-level prefix sums.

Rows are range-partitioned by their order and written once with the number of their part. The
totals of the parts (one row a part) are summed first; inside a part a window adds up the rows
before. So no task sees more than its own range, and nothing but the parts' totals meets in one
task. Equal orders cannot be parted by range: count equal values first (``by_value``), then one
hot value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_totals(df: DataFrame, order: Sequence[Column], values: Sequence[str], suffix: str = "_before") -> DataFrame:
    """``df`` with ``<value>_before`` for each of ``values``: its sum over all rows earlier in the order.

    The order should be total: rows it leaves equal get their totals in any of their orders.
    Null values count as 0. An empty table gives no rows.
    """
    parts = (df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
             .checkpoint(eager=True))  # both levels must see the same ranges
    sums = parts.groupBy("_part").agg(*[F.sum(F.coalesce(v, F.lit(0))).alias(f"_all_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_all_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(F.broadcast(offsets), "_part")  # one row a part
    totals = {f"{v}{suffix}": F.col(f"_off_{v}") + F.coalesce(F.sum(F.coalesce(v, F.lit(0))).over(inside), F.lit(0))
              for v in values}
    return joined.withColumns(totals).drop("_part", *[f"_off_{v}" for v in values])


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """``df`` with the number of rows earlier in the (total) order: 0, 1, 2, ..."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, order, ["_one"]).withColumnRenamed("_one_before", out).drop("_one")


def by_value(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """``score, pos, neg`` for each distinct score: rows with label 1 and other labels (nulls and NaN are left out)."""
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    known = df.select(x.alias("score"), y.alias("y")).where(F.col("score").isNotNull() & F.col("y").isNotNull()
                                                           & ~F.isnan("score"))
    return known.groupBy("score").agg(F.count_if(F.col("y") > 0.5).alias("pos"), F.count_if(F.col("y") <= 0.5).alias("neg"))


def areas(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row: exact ``area_under_roc`` (ties count one half) and ``area_under_pr`` (trapezoids over
    the distinct scores, the first one's precision at recall 0). No positives or no negatives: the ROC area
    is null; no positives: the PR area is null."""
    down = running_totals(by_value(df, score, label), [F.desc("score")], ["pos", "neg"])
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    precision = tp / (tp + fp)
    first = F.col("pos_before") + F.col("neg_before") == 0
    earlier = F.when(first, precision).otherwise(F.col("pos_before") / F.greatest(F.col("pos_before") + F.col("neg_before"), F.lit(1)))
    sums = down.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"),
                    F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2.0)).alias("roc"),
                    F.sum(F.col("pos") * (precision + earlier) / 2.0).alias("pr"))
    return sums.select(F.try_divide(F.col("roc"), F.col("p").cast("double") * F.col("n")).alias("area_under_roc"),
                       F.try_divide(F.col("pr"), F.col("p").cast("double")).alias("area_under_pr"))


def areas_by(df: DataFrame, key: str, score: str, label: str = "label") -> DataFrame:
    """``key, area_under_roc`` of every key's rows, all in one global order (null without both classes)."""
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    counted = (df.select(key, x.alias("score"), y.alias("y")).where(F.col("score").isNotNull() & F.col("y").isNotNull())
               .groupBy(key, "score").agg(F.count_if(F.col("y") > 0.5).alias("pos"), F.count_if(F.col("y") <= 0.5).alias("neg")))
    down = running_totals(counted, [F.col(key), F.desc("score")], ["pos"])
    sums = down.groupBy(key).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("pos_before").alias("before"),
                                 F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2.0)).alias("roc"))
    inside = F.col("roc") - F.col("before").cast("double") * F.col("n")
    return sums.select(key, F.try_divide(inside, F.col("p").cast("double") * F.col("n")).alias("area_under_roc"))
