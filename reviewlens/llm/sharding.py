"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters the rows into memory-sized buckets by a seeded hash of id and
text and writes them down. Pass 2 brings each bucket together in a fixed order,
numbers its rows and gives them the places of a Fisher-Yates permutation from a
generator seeded by the bucket. Only numbers go to the Python workers; records
stay in Spark's sort, which spills. Buckets in a row give each record its place
0 .. n - 1; shard s takes the places from ``s * n // shards`` on, so counts are at
most one apart (law ``rows``). Shards are written as Parquet partitions.

A null text has no bytes. Repeated rows are kept; rows that repeat one id and text
over ``REPEATS`` times are dealt to several buckets by their position in the input, so
that no bucket grows with them. An empty table gives no rows. Extra columns travel
with the records under any name, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import fields_of, shared_folder, stored, whole_row

BUCKET_BYTES = 16 << 20
REPEATS = 1000       # rows of one id and text that may share a bucket
MAX_REPEATED = 100_000  # so many repeated rows' hashes are broadcast (2 MB), more are joined


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A permutation of 0 .. n - 1: from the end, each place swaps with a random earlier one or itself."""
    order = list(range(n))
    if n > 1:
        draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(n, 1, -1))
        for i, j in zip(range(n - 1, 0, -1), draws.tolist()):
            order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def scattered(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Pass 1: ``bucket, order, record`` of every row, written; the number of rows."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total, n = docs.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-total // bucket_bytes))
    rows = docs.select(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("key"),
                       F.monotonically_increasing_id().alias("row"), whole_row(docs))
    repeated = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > REPEATS)
                .select("key", F.ceil(F.col("times") / REPEATS).alias("parts")))
    repeated = stored(docs.sparkSession, repeated, "repeated-rows")
    few = repeated.limit(MAX_REPEATED + 1).count() <= MAX_REPEATED
    rows = rows.join(F.broadcast(repeated) if few else repeated, "key", "left")
    own = F.col("key").bitwiseXOR(F.when(F.col("parts").isNotNull(), F.xxhash64(F.pmod("row", "parts"))).otherwise(F.lit(0)))
    order = F.xxhash64(F.lit(seed + 1), "record.text").alias("order")  # the window must not send the text once more
    rows = rows.select(F.pmod(own, F.lit(buckets)).alias("bucket"), order, "record")
    return stored(docs.sparkSession, rows, "buckets", codec="zstd"), n


def permuted(seed: int):
    """Column function ``(bucket, rows of the bucket, number)``: the number's place in the bucket's permutation."""
    last: dict = {}

    @F.arrow_udf("long")
    def place(bucket: pa.Array, n: pa.Array, number: pa.Array) -> pa.Array:
        buckets, sizes = bucket.to_numpy(), n.to_numpy()
        out, numbers = np.empty(len(buckets), np.int64), number.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts, cuts[1:]):  # rows come sorted by bucket
            if b > a:
                key = (int(buckets[a]), int(sizes[a]))
                if last.get("key") != key:  # a batch goes on with the bucket that the last one ended in
                    last.update(key=key, order=fisher_yates(key[1], [seed, key[0]]))
                out[a:b] = last["order"][numbers[a:b]]
        return pa.array(out)

    return place


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes ``docs`` (needs ``doc_id``, ``text``) into shards in the shared folder and reads them back.

    There is one count for each bucket of ``bucket_bytes``, so their running sum in one task stays small.
    """
    spark, schema_in = docs.sparkSession, docs.schema
    rows, total = scattered(docs, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(spark, counts.select("bucket", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")),
                    "bucket-places")
    # a fixed order first: what arrives depends on the order of network fetches
    order = Window.partitionBy("bucket").orderBy("record.doc_id", "order")
    placed = (rows.join(counts, "bucket").withColumn("number", (F.row_number().over(order) - 1).cast("long"))
              .withColumn("place", permuted(seed)("bucket", "n", "number") + F.col("before")))
    # the last shard whose first place, s * n // shards, is not beyond this place
    shard = F.expr(f"cast(((place + 1) * {shards} - 1) div {max(total, 1)} as int)")
    first: Column = F.expr(f"cast(shard as bigint) * {total} div {shards}")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - first)
    folder = shared_folder(spark, "shards")
    out.select("record", "slot", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    kinds = T.StructType([T.StructField("record", schema_in), T.StructField("slot", T.LongType()),
                          T.StructField("shard", T.IntegerType())])
    own = fields_of([name for name in schema_in.names if name not in ("shard", "slot")])
    return spark.read.schema(kinds).parquet(folder).select(*own, "shard", "slot")
