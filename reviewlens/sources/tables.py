"""Scan a review table with an explicit column list.

The reference reads ``select *`` and caches it, which materialises every column.
Here callers name the columns they need, so the parquet scan's ``ReadSchema``
only carries those and filters on them are pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from reviewlens.schema import REVIEW_COLUMNS


def read_table(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read a catalog table name or a parquet path, projected to ``columns``."""
    if "/" in source or source.endswith(".parquet"):
        df = spark.read.parquet(source)
    else:
        df = spark.table(source)
    return df.select(*columns) if columns else df


def scan_reviews(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The training table (``label`` may be null)."""
    return read_table(spark, source, columns or REVIEW_COLUMNS)


def scan_scoring(spark: SparkSession, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The scoring table (no label is used)."""
    cols = columns or [c for c in REVIEW_COLUMNS if c != "label"]
    return read_table(spark, source, cols)
