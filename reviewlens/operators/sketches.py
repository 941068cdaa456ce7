"""Mergeable sketches kept as tables: percentiles (A9) and distinct counts (A5).

A sketch table has one row a group (segment and day, product and day) and is appended as days
arrive; coarser groups are merged from it without reading any review again. KLL sketches answer
quantiles and ranks, theta sketches distinct counts with unions, intersections and differences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

KLL_K = 400              # normalised rank error about 0.7 % (single-sided, 99 % of the time)
KLL_RANK_ERROR = 0.01
THETA_LG_K = 13          # 8,192 hashes: exact below, relative error about 1.1 % (one deviation) beyond
THETA_ERROR = 0.035      # three deviations


def percentile_sketches(df: DataFrame, groups: Sequence[str], value: str, k: int = KLL_K) -> DataFrame:
    """``groups``, ``n`` and a KLL sketch of the whole-number column ``value`` (nulls are left out)."""
    x = F.col(value).cast("long")
    return df.where(x.isNotNull()).groupBy(*groups).agg(F.count(x).alias("n"), F.kll_sketch_agg_bigint(x, F.lit(k)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of coarser ``groups`` (none: one row for all) from finer ones."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The sketches' groups, ``n`` and a column ``p<percent>`` for each of ``probs``."""
    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*rest, *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))).alias(f"p{round(100 * p)}") for p in probs])


def rank_share(value: Column) -> Column:
    """Share of a sketch's values (column ``sketch``) that are at most ``value``."""
    return F.kll_sketch_get_rank_bigint("sketch", value)


def distinct_sketches(df: DataFrame, groups: Sequence[str], value: str, lg_k: int = THETA_LG_K) -> DataFrame:
    """A5: ``groups`` and a theta sketch of the distinct values (nulls are left out)."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.theta_sketch_agg(F.col(value).cast("string"), lg_k).alias("sketch"))


def merged_distinct(sketches: DataFrame, groups: Sequence[str], lg_k: int = THETA_LG_K) -> DataFrame:
    """Unions: sketches of coarser ``groups`` from finer ones."""
    return sketches.groupBy(*groups).agg(F.theta_union_agg("sketch", lg_k).alias("sketch"))


def distinct_estimate(sketch: str = "sketch") -> Column:
    return F.theta_sketch_estimate(sketch)


def overlap(left: DataFrame, right: DataFrame, on: Sequence[str], lg_k: int = THETA_LG_K) -> DataFrame:
    """``on`` with the estimated sizes of both sides' union, intersection and the left side's rest."""
    a, b = left.select(*on, F.col("sketch").alias("a")), right.select(*on, F.col("sketch").alias("b"))
    return a.join(b, list(on)).select(
        *on, F.theta_sketch_estimate(F.theta_union("a", "b", lg_k)).alias("either"),
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("both"),
        F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("left_only"))
