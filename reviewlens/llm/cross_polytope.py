"""Nearest neighbours by cross-polytope hashing.

A table's hash turns the direction of a vector by pseudo-rotations, each random
signs followed by a fast Hadamard transform, and names the nearest signed axis
(the coordinate of largest magnitude and its sign). Every vector is stored in
its bucket of each table; a query probes the ``probes`` axes nearest to it in each
table and the candidates found are ranked exactly by inner product of the
original vectors in double precision.

Equal vectors are searched once: they tie with each other for any query, so of a
group only the ``k + 1`` smallest ids can be answers. A bucket larger than twice the mean, or
than ``BLOCK_ROWS``, is cut into blocks, each searched by a task of its own; all
its rows stay candidates. Each block returns at most its ``k + 1`` best for a
query, so no list of pairs is made. A query whose buckets held fewer than ``k``
candidates is searched again in all buckets of one table, which is exact. Distinct vectors of equal score are ordered,
here and over all blocks, by the smallest id of each.

Vectors null, empty, zero, or with null or non-finite components take no part. Vectors of
different lengths are searched apart. Ids that repeat or are null: each row is a candidate,
null ids come last among equal scores; a query's own id is no candidate of it.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import stored

BLOCK_ROWS = 32_768
CELLS = 1 << 21  # scores held at a time in a block
ALL = 1 << 31  # probes: every axis
NO_ID = (1 << 63) - 1  # stands for a null id in the order of ties


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Three pseudo-rotations of the rows, padded with zeros to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for turn in range(3):
        signs = np.random.Generator(np.random.PCG64([seed, table, turn])).integers(0, 2, width) * 2 - 1
        y = hadamard(y * signs) / np.sqrt(width)
    return y


def axes(x: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row, nearest first; axis i + width is minus axis i."""
    y = rotated(x, table, seed)
    signed = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return signed.argmax(axis=1)[:, None]
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def hashed(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """``rep, least, v`` with one row for each table and probed ``bucket``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
            for table in range(tables):
                found = axes(x, table, seed, probes)
                rows = pa.array(np.repeat(np.arange(len(x)), found.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(rows) for c in batch.columns),
                     pa.array(np.full(found.size, table, np.int32)), pa.array(found.reshape(-1).astype(np.int32))],
                    names=["rep", "least", "v", "tbl", "bucket"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("rep", "least", "v").mapInArrow(run, f"rep long, least long, v {kind}, tbl int, bucket int")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the vectors that take part: single-precision ones as they are, others in double precision."""
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(
        vectors.schema[vector_col].dataType.elementType, T.FloatType)
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    return rows.filter(F.exists("v", lambda x: x != 0))


def indexed(index: DataFrame, tables: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The index's rows in their buckets, dealt to blocks; ``tbl, bucket, blocks``."""
    stored_at = hashed(index, tables, 1, seed)
    stored_at = stored(index.sparkSession, stored_at, "ann-index")
    counts = stored_at.groupBy("tbl", "bucket").agg(F.count(F.lit(1)).alias("n"))
    mean = counts.agg(F.coalesce(F.avg("n"), F.lit(1.0))).first()[0]
    block_rows = max(64, min(BLOCK_ROWS, int(2 * mean)))
    blocks = counts.select("tbl", "bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    # one row a bucket: tables * 2 * padded length, whatever the number of vectors
    blocks = F.broadcast(blocks)
    members = (stored_at.join(blocks, ["tbl", "bucket"])
               .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    return members, blocks


def search(queries: DataFrame, members: DataFrame, blocks: DataFrame, k: int, tables: int, probes: int,
           seed: int) -> DataFrame:
    """``rep, near, least, score``: distinct query vectors and their best ``k + 1`` distinct vectors (itself included)."""
    asked = (hashed(queries.withColumn("least", F.lit(NO_ID)), tables, probes, seed)
             .join(blocks, ["tbl", "bucket"])
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "near": [], "least": [], "score": []})
        # smallest id first, so that the order of columns breaks ties
        right = right.sort_values(["least", "rep"])
        q = np.stack(left["v"].to_numpy()).astype(np.float64)
        x = np.stack(right["v"].to_numpy()).astype(np.float64)
        ids, least, n = right["rep"].to_numpy(), right["least"].to_numpy(), min(k + 1, len(right))
        reps, out = left["rep"].to_numpy(), []
        # twice what a product's rounding can be off for any pair, so that it cannot cost an answer or a tie
        slack = 4 * np.finfo(np.float64).eps * x.shape[1] * np.linalg.norm(x, axis=1).max() * np.linalg.norm(q, axis=1)
        step = max(1, min(256, CELLS // len(x)))
        for at in range(0, len(q), step):
            dots = q[at:at + step] @ x.T
            reached = np.partition(dots, len(x) - n, axis=1)[:, len(x) - n] - slack[at:at + step]
            row, col = np.nonzero(dots >= reached[:, None])
            # sums in one fixed order: the same pair has the same score in every block
            exact = np.concatenate([(q[row[i:i + 65_536] + at] * x[col[i:i + 65_536]]).cumsum(axis=1)[:, -1]
                                    for i in range(0, len(row), 65_536)])
            order = np.lexsort((-exact, row))  # stable
            row, col, exact = row[order], col[order], exact[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < n
            row, col = row[kept] + at, col[kept]
            out.append(pd.DataFrame({"rep": reps[row], "near": ids[col], "least": least[col], "score": exact[kept]}))
        return pd.concat(out)

    keys = ["tbl", "bucket", "block"]
    found = (asked.select(*keys, "rep", "v").groupBy(*keys)
             .cogroup(members.filter(F.col("tbl") < tables).select(*keys, "rep", "least", "v").groupBy(*keys))
             .applyInPandas(best, "rep long, near long, least long, score double"))
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "least", "near")
    return (found.groupBy("rep", "near").agg(F.max("score").alias("score"), F.min("least").alias("least"))
            .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
            .select("rep", "near", "least", "score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 4, probes: int = 40, seed: int = 7,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found; ``is_query`` is a condition on column ``id``.

    Vectors of different lengths have no inner product: each length is searched among its own."""
    spark = vectors.sparkSession
    rows = stored(spark, usable(vectors, id_col, vector_col), "ann-vectors")
    lengths = sorted(r.d for r in rows.select(F.size("v").alias("d")).distinct().collect())  # a model has one or few
    parts = [_nearest(rows.filter(F.size("v") == d) if len(lengths) > 1 else rows, is_query, k, tables, probes, seed)
             for d in lengths or [0]]
    return reduce(DataFrame.unionByName, parts)


def _nearest(rows: DataFrame, is_query: Column, k: int, tables: int, probes: int, seed: int) -> DataFrame:
    """``nearest`` of rows (``id, v``) of one length."""
    spark = rows.sparkSession
    same = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    # only the k + 1 smallest ids of equal vectors can be answers; Spark keeps that many before the shuffle too
    members = (rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
               .withColumn("rep", F.xxhash64("v")))
    members = stored(spark, members, "ann-members")
    # never null, as pandas would make doubles of all ids in its block
    index = members.filter("place = 1").select("rep", F.coalesce("id", F.lit(NO_ID)).alias("least"), "v")
    queries = rows.filter(is_query).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("rep"), "v")
    asked = queries.groupBy("rep").agg(F.first("v").alias("v"))
    at = indexed(index, tables, seed)
    near = members.select(F.col("rep").alias("near"), "id")
    ranked = Window.partitionBy("rep").orderBy(F.desc("score"), F.col("id").asc_nulls_last())

    def listed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
        found = search(vectors, *at, k, tables, probes, seed)
        found = found.join(near, "near").withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1)
        found = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
        return stored(spark, found, "ann-lists")

    lists = listed(asked, tables, probes)
    # the query's own row is one of k + 1; rows beyond the k + 1 smallest ids of equal vectors do not change this minimum
    whole = lists.filter(F.size("near") >= min(k + 1, members.count()))
    short = stored(spark, asked.join(whole.select("rep"), "rep", "left_anti"), "ann-short")
    if not short.isEmpty():
        # every row lies on one axis of a table, so all axes of one find all rows
        lists = whole.unionByName(listed(short, 1, ALL))
    own = F.slice(F.filter("near", lambda x: ~x["id"].eqNullSafe(F.col("query_id"))), 1, k)
    return (queries.select("query_id", "rep").join(lists, "rep")
            .select("query_id", F.posexplode(own).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"),
                    F.col("x.score").alias("score")))
