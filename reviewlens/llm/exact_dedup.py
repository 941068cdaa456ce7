"""Exact deduplication against a persistent digest index.

The index is a Parquet table in a shared folder, bucketed and sorted by the SHA-256
digest of the normalised text (A-Z lower-cased, nothing else). A batch of new rows
is cut to one row a digest (largest id first; the window plans a partial limit, so a
hot digest leaves one row a map task), put through a sort-merge anti-join with the
index, whose buckets are read as they lie, and what remains is appended. An index
is opened again, in any session, by its folder and number of buckets.

Rows are named by ``batch`` and ``row``, so of rows with equal id and text exactly
one is kept, and a batch that is added twice changes nothing.

A null text counts as empty and equals an empty one. Null ids come after all others;
if all ids of equal texts are null, one of the rows is kept and ``keep_id`` is null.
An empty table gives no rows. Other columns travel with the rows under any name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reviewlens.llm.common import ascii_lower, fields_of, stored, whole_row

BUCKETS = 256        # for some 10**9 texts; 100 TB of documents ask for thousands
HOT_SHARE = 1000     # a digest of over 1 / HOT_SHARE of all rows is hot, so fewer than that many are


def digest(text: Column) -> Column:
    """32 bytes that name a text up to the case of A-Z."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """Digests met so far, with the row that stays for each: ``digest, keep_id, keep_batch, keep_row``."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.name = "digest_index_" + hashlib.md5(f"{folder}/{buckets}".encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} "
                  "(digest BINARY, keep_id BIGINT, keep_batch STRING, keep_row BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, rows: DataFrame) -> DataFrame:
        """Of ``rows`` (``digest, doc_id, row``, more), the first of each digest that the index lacks."""
        first = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last(), "row")
        new = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
        return new.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, new: DataFrame, batch: str) -> None:
        """Adds the digests of ``new``, which the index must lack. Behind ``unknown`` they are dealt by
        the buckets' own hash, so each task writes one file."""
        new.select("digest", F.col("doc_id").alias("keep_id"), F.lit(batch).alias("keep_batch"),
                   F.col("row").alias("keep_row")).write.insertInto(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """``digest, doc_id, row`` of every row, in one narrow pass. Store it before using it twice."""
    return docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long"),
                       F.monotonically_increasing_id().alias("row"))


def new_texts(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Rows of ``docs`` with a text that neither the index nor an earlier row has; the index learns them."""
    rows = docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long"),
                       F.monotonically_increasing_id().alias("row"), whole_row(docs))
    new = stored(index.spark, index.unknown(rows), "new-texts")
    index.append(new.select("digest", "doc_id", "row").repartition(index.buckets, "digest"), batch)
    return new.select(*fields_of(docs.columns))


def labels(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Each of ``rows`` (``digest, doc_id, batch, row``) with ``keep_id, group_size, kept``.

    Groups are counted before the shuffle. Rows of hot digests meet their group by a broadcast of
    fewer than ``HOT_SHARE`` rows, all others by a sort-merge join.
    """
    rows_in_all = rows.count()
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stored(index.spark, counts.join(index.table().hint("merge"), "digest"), "digest-groups")
    hot = F.col("group_size") * HOT_SHARE > rows_in_all
    hot_groups = F.broadcast(groups.filter(hot))
    found = rows.join(hot_groups, "digest").unionByName(
        rows.join(hot_groups.select("digest"), "digest", "left_anti").join(groups.filter(~hot), "digest"))
    kept = (F.col("row") == F.col("keep_row")) & (F.col("batch") == F.col("keep_batch"))
    return found.withColumn("kept", kept)


def deduplicate_in_batches(docs: DataFrame, index: DigestIndex, batches: int) -> DataFrame:
    """``docs`` arriving as ``batches`` ranges of ids, the largest first, so that of equal texts the
    largest id stays whichever batches they come in: one row a document with its label."""
    spark = index.spark
    rows = stored(spark, digests(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // batches))
    range_of = F.coalesce(F.expr(f"(doc_id - cast({low} as bigint)) div {width}"), F.lit(0))  # null ids come last
    rows = rows.withColumn("batch", range_of.cast("string"))
    for number in range(batches - 1, -1, -1):
        index.append(index.unknown(rows.filter(range_of == number)), str(number))
    return labels(rows, index)
