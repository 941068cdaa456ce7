"""Helpers shared by the operators: shared folders, folds, code shipping."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlens.session import checkpoint_dir, configure, ship_package


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, a checkpoint folder and the package on the workers."""
    configure(spark)
    ship_package(spark)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the cluster's shared checkpoint folder."""
    base = checkpoint_dir(spark)
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there:
    cuts the lineage, survives lost executors and keeps column pruning."""
    folder = shared_folder(spark, name)
    df.write.option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds`` (null id: fold 0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_fold, max_rows: int) -> DataFrame:
    """Training rows ``(doc_id, text, y)``: labelled rows of the training folds.

    At most about ``max_rows`` of them, taken by a hash of the id; this is the
    only sample a classifier here is fitted on. The labels kept are bounded by
    that number, so they are broadcast and the texts are not shuffled.
    Several labels of one id: the larger counts. Null labels and ids are ignored.
    """
    known = (labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
             .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
             .filter(train_fold(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = known.count()
    if n > max_rows:
        scale = 1 << 30
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * max_rows / n))
    return (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .join(F.broadcast(known), "doc_id"))


def quoted(name: str) -> str:
    """A column name as it stands in an expression."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, alias: str = "record") -> Column:
    """All columns as one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*[F.col(quoted(name)).alias(name) for name in df.columns]).alias(alias)


def fields_of(names: list[str], record: str = "record") -> list[Column]:
    """The columns that ``whole_row`` put into ``record``."""
    return [F.col(f"{record}.{quoted(name)}").alias(name) for name in names]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. In a text of ASCII alone ``lower`` does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
