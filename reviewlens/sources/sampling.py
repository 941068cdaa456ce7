"""S3 sampling and M1/M2 splits.

``bernoulli_sample`` is Spark's seeded sample. Its result depends on the input
partitioning, so it is not stable across runs on a changing cluster. The hash
forms decide per row from a hash of the key, so a row always lands on the same
side regardless of partitioning, executor loss or engine (DuckDB gives the same
split with the same expression).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 47) -> DataFrame:
    """S3: seeded Bernoulli sample (the reference samples 70 % unseeded)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_fraction(key: str | Column) -> Column:
    """Per-key bucket 0..9 from the first 16 bits of md5(key) (M2)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 4), 16, 10).cast("int") % 10


def hash_sample(df: DataFrame, key: str, tenths: int) -> DataFrame:
    """S3 hash form: keep rows whose key bucket is below ``tenths`` (of 10)."""
    return df.where(hash_fraction(key) < tenths)


def hash_split(df: DataFrame, key: str, train_tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """M2: repeatable train / holdout split on a key hash (default 80/20)."""
    bucket = hash_fraction(key)
    return df.where(bucket < train_tenths), df.where(bucket >= train_tenths)
