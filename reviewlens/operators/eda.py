"""Exploratory aggregates: A2-A13, E1-E6, O1-O4.

Every function returns a small aggregated DataFrame (chart-ready rows); no
column is collected to the driver. Global statistics are computed in one
aggregate pass (partial + final hash aggregation), and the histogram takes its
range from scalar subqueries instead of a driver round trip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reviewlens.functions.constants import HISTOGRAM_BINS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def helpful_rate_by(df: DataFrame, group: str | Sequence[str], label: str = "label",
                    order: str | Sequence[str] | None = None) -> DataFrame:
    """Rows and mean label per group, ordered (O1/O2)."""
    groups = [group] if isinstance(group, str) else list(group)
    out = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(label).cast("double")).alias("helpful_rate"),
    )
    order_cols = [order] if isinstance(order, str) else list(order or groups)
    return out.orderBy(*order_cols)


def segment_rates(df: DataFrame, label: str = "label") -> DataFrame:
    """E5: helpful rate per length segment, in segment order (not label text order)."""
    return helpful_rate_by(df, ["segment_no", "reviewTot_segment"], label, "segment_no")


def group_counts(df: DataFrame, group: str | Sequence[str], order: str | Sequence[str] | None = None) -> DataFrame:
    """Rows per group, ordered."""
    groups = [group] if isinstance(group, str) else list(group)
    out = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    order_cols = [order] if isinstance(order, str) else list(order or groups)
    return out.orderBy(*order_cols)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A10: non-null value counts, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def pivot_counts(df: DataFrame, index: str, column: str, values: Sequence, prefix: str = "label_") -> DataFrame:
    """Counts of ``index`` x ``column`` with listed column values, zero-filled."""
    p = df.groupBy(index).pivot(column, list(values)).count().na.fill(0)
    for v in values:
        p = p.withColumnRenamed(str(v), f"{prefix}{v}")
    return p.orderBy(index)


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation; null (not an ANSI error) for a constant column."""
    a, b = _c(x), _c(y).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def describe_column(df: DataFrame, col: str) -> DataFrame:
    """Typed ``describe`` (count, mean, stddev, min, max) in one pass."""
    x = F.col(col)
    return df.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("stddev"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def percentiles(df: DataFrame, col: str, probs: Sequence[float] = (0.25, 0.5, 0.75),
                accuracy: int = 10000) -> DataFrame:
    """Approximate percentiles (mergeable sketch, no global sort)."""
    arr = F.percentile_approx(F.col(col), list(probs), accuracy)
    names = [f"p{int(round(p * 100))}" for p in probs]
    return df.agg(arr.alias("_p")).select(*[F.col("_p")[i].alias(n) for i, n in enumerate(names)])


def length_summary(df: DataFrame, length: str = "reviewTot_length", label: str = "label") -> DataFrame:
    """A7 + A8 + A9 in one aggregate pass (the notebook runs four jobs)."""
    x = F.col(length)
    q = F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("stddev"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        safe_corr(x, label).alias("corr_label"), q.alias("_q"),
    ).select("count", "mean", "stddev", "min", "max", "corr_label",
             F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"))


def histogram(df: DataFrame, col: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram over [min, max] with all ``bins`` rows.

    Bin ``i`` covers [lo + i*w, lo + (i+1)*w), the last bin also includes the
    maximum. A constant column uses [v - 0.5, v + 0.5].

    The input is read once: its one column is checkpointed as it comes (8 bytes a row, reliable,
    eager, no shuffle). The range (scalar subqueries) and the bins are then computed from it, so an
    expensive upstream job (e.g. sentiment scoring) is not re-run for the min, the max and the
    bins. Only partial counts of the bins are shuffled, nothing passes through the driver.
    """
    x = F.col(col).cast("double")
    vals = df.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).checkpoint(eager=True)
    lo0 = vals.select(F.min("_x")).scalar()
    hi0 = vals.select(F.max("_x")).scalar()
    same = lo0 == hi0
    lo = F.when(same, lo0 - 0.5).otherwise(lo0)
    hi = F.when(same, hi0 + 0.5).otherwise(hi0)
    idx = F.least(F.lit(bins - 1), F.floor((F.col("_x") - lo) / (hi - lo) * bins)).cast("int")
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / bins
    # ``counts`` has at most ``bins`` rows, so broadcasting it is bounded.
    return (frame.join(F.broadcast(counts), "bin", "left")
                 .select("bin",
                         (lo + F.col("bin") * width).alias("bin_lo"),
                         (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                         F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                 .orderBy("bin"))


def length_ratio(df: DataFrame, length: str, label: str = "label") -> DataFrame:
    """Mean length of helpful vs not helpful and their ratio."""
    by = df.groupBy(label).agg(F.avg(F.col(length).cast("double")).alias("mean_length"))
    return by.agg(
        F.max(F.when(F.col(label) == 1, F.col("mean_length"))).alias("mean_length_helpful"),
        F.max(F.when(F.col(label) == 0, F.col("mean_length"))).alias("mean_length_not_helpful"),
    ).withColumn("ratio", F.try_divide("mean_length_helpful", "mean_length_not_helpful"))


def top_k(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """O3: the ``k`` largest rows by ``value`` (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(F.desc(value), F.asc(tie)).limit(k)
