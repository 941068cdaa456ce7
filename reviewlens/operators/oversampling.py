"""Synthetic minority rows (M19): neighbours by locality-sensitive hashing, interpolation by hash.

* Neighbours: ``tables`` sets of random hyperplanes through the mean give each minority row a
  bucket per table; rows of one bucket are compared exactly. The number of hyperplanes follows from the
  row count, so that a bucket holds about ``bucket_rows``; larger buckets are cut into parts
  and every pair of parts is compared by a task of its own, so no bucket is capped. Up to ``bucket_rows`` minority
  rows there is one bucket and the neighbours are exact.
* Counts: the class gets exactly as many rows as the largest one. Each row gives
  ``need // rows`` synthetic rows and those first in a hash order one more (two-level ranks).
* A synthetic row lies between a row and one of its ``k`` neighbours, both chosen by
  md5 of (seed, id, copy): the same rows on any partitioning.

Rows need a unique ``id`` and a vector of one length. A minority of one row is repeated as it is.
Rows with a null label are kept and not counted. An empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.operators import ranks
from reviewlens.session import ship_package

BUCKET_ROWS = 2_000
TABLES = 10


def hash_share(*parts: Column) -> Column:
    """A number of [0, 1) from the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _buckets(rows: DataFrame, n: int, tables: int, bucket_rows: int, seed: int) -> DataFrame:
    """``id, x, t, bucket`` for every row and table; hyperplanes go through the mean of all rows."""
    bits = max(0, math.ceil(math.log2(n / bucket_rows))) if n else 0
    if not bits:
        return rows.select("id", "x", F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"))
    size = rows.select(F.max(F.size("x"))).first()[0]
    mean = np.array(rows.agg(F.array(*[F.avg(F.col("x")[k]) for k in range(size)])).first()[0])
    planes = np.random.default_rng(seed).normal(size=(size, tables * bits))
    shift = mean @ planes
    place = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            side = (x @ planes > shift).reshape(batch.num_rows, tables, bits)
            found = side @ place
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(x), t, np.int32)),
                                                  pa.array(found[:, t])], names=["id", "x", "t", "bucket"])
    return rows.mapInArrow(run, "id string, x array<double>, t int, bucket long")


def neighbours(rows: DataFrame, k: int = 5, tables: int = TABLES, bucket_rows: int = BUCKET_ROWS, seed: int = 47) -> DataFrame:
    """``id, place, other, distance``: the ``k`` nearest other rows found for each of ``rows`` (``id, x``)
    by Euclidean distance, nearest first (place 0), ties by id."""
    ship_package(rows.sparkSession)
    dealt = _buckets(rows, rows.count(), tables, bucket_rows, seed)
    sizes = dealt.groupBy("t", "bucket").count().select("t", "bucket", F.ceil(F.col("count") / (2 * bucket_rows)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    cut = (dealt.join(sizes, ["t", "bucket"]).withColumn("part", part)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .select("t", "bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "x"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", ignore_index=True)
        x, ids = np.stack(group["x"].to_numpy()), group["id"].to_numpy()
        norms, out = (x ** 2).sum(axis=1), []
        for a in range(0, len(x), 512):
            d = norms[a:a + 512, None] + norms - 2.0 * x[a:a + 512] @ x.T
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
            own = np.repeat(np.arange(a, a + len(d)), near.shape[1])
            out.append(pd.DataFrame({"id": ids[own], "other": ids[near.ravel()],
                                     "distance": np.sqrt(((x[own] - x[near.ravel()]) ** 2).sum(axis=1))}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "distance": []})

    found = cut.groupBy("t", "bucket", "p", "q").applyInPandas(nearest, "id string, other string, distance double").distinct()
    order = Window.partitionBy("id").orderBy("distance", "other")
    return (found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < k)
            .select("id", "place", "other", "distance"))


def oversample(df: DataFrame, id_col: str, features: str = "features", label: str = "label", k: int = 5, seed: int = 47,
               tables: int = TABLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``id, label, features, synthetic``: all rows of ``df`` and synthetic ones that bring every class to the
    size of the largest. ``base``, ``other`` and ``share`` say where a synthetic row lies."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(label).cast("double").alias("label"),
                     vector_to_array(features).alias("x")).checkpoint(eager=True)
    counts = {r.label: r["count"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    none = [F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("share")]
    out = rows.select("id", "label", "x", F.lit(False).alias("synthetic"), *none)
    for value, n in sorted(counts.items()):
        need = max(counts.values()) - n
        if need:
            own = rows.where(F.col("label") == value).select("id", "x")
            out = out.unionByName(_synthetic(own, n, need, k, seed, tables, bucket_rows).withColumn("label", F.lit(value)))
    return out.withColumn(features, array_to_vector("x")).select("id", "label", features, "synthetic", "base", "other", "share")


def _synthetic(own: DataFrame, n: int, need: int, k: int, seed: int, tables: int, bucket_rows: int) -> DataFrame:
    near = neighbours(own, k, tables, bucket_rows, seed).checkpoint(eager=True)
    ranked = ranks.global_rank(own.select("id", F.md5(F.concat(F.lit(f"{seed}/"), "id")).alias("h")), [F.col("h"), F.col("id")])
    copies = ranked.select("id", (F.lit(need // n) + (F.col("rank") < need % n).cast("int")).cast("int").alias("copies"))
    drawn = copies.where("copies > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    found = near.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    text = [F.lit(str(seed)), F.col("id"), F.col("copy").cast("string")]
    drawn = (drawn.join(found, "id", "left")
             .withColumn("place", F.floor(hash_share(*text, F.lit("neighbour")) * F.coalesce("k", F.lit(1))).cast("int"))
             .withColumn("share", hash_share(*text, F.lit("share"))))
    drawn = (drawn.join(near.select("id", "place", "other"), ["id", "place"], "left")
             .withColumn("other", F.coalesce("other", "id")))  # a lone row is repeated
    there = own.select(F.col("id").alias("other"), F.col("x").alias("to"))
    between = F.zip_with("x", "to", lambda a, b: a + F.col("share") * (b - a))
    return drawn.join(own, "id").join(there, "other").select(
        F.concat_ws("#", "id", F.col("copy").cast("string")).alias("id"), between.alias("x"), F.lit(True).alias("synthetic"),
        F.col("id").alias("base"), "other", "share")
