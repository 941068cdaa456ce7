"""Adapters that present the driver's generic tables as review tables.

Two shapes (see FIXTURES.md):

* ``reviews_from_documents`` - one review per document: text from ``documents``,
  reviewer / date / rating from the matching ``orders`` row, label from
  ``labels``. Texts are kept whole.
* ``reviews_from_lineitems`` - one review per line item, for relational
  operators at volume (joins, distinct counts, windows, dedup). No text.

Both read only the columns they use, so the scans are pruned. ``derive`` runs on
the document side (reviewID, asin, reviewText, summary) before the joins: a
query that needs lengths, flags or scores computes them there and drops the
text, so that the joins shuffle narrow rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reviewlens.functions.text import tokenize

Derive = Callable[[DataFrame], DataFrame]
FIXTURE_TAGS = ["ADJ", "ADV", "DET", "NOUN", "VERB"]


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _documents(spark: SparkSession, sf_dir: str, derive: Derive | None) -> DataFrame:
    d = _table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").select(
        F.col("doc_id").alias("_doc_id"), F.col("doc_id").cast("string").alias("reviewID"),
        F.col("source").alias("asin"), F.col("text").alias("reviewText"),
        F.concat_ws(" ", "lang", "source").alias("summary"))
    return derive(d) if derive else d


def _with_orders(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    o = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
               "o_orderpriority", "o_orderdate")
    return d.join(o, F.col("_doc_id") == F.col("o_orderkey"), "inner")


def _review_columns(d: DataFrame) -> list[Column]:
    more = [c for c in d.columns if c not in ("_doc_id", "reviewID", "asin")]
    return [
        F.col("reviewID"),
        F.col("o_custkey").cast("string").alias("reviewerID"),
        F.col("asin"),
        *[F.col(c) for c in more],
        (F.col("o_orderstatus") == "F").alias("verified"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("overall"),
        F.unix_timestamp("o_orderdate").alias("unixReviewTime"),
    ]


def reviews_from_documents(spark: SparkSession, sf_dir: str, derive: Derive | None = None,
                           label: bool = True) -> DataFrame:
    """Training-table view of ``documents`` joined to ``orders`` and, unless no
    label is wanted, ``labels``."""
    d = _documents(spark, sf_dir, derive)
    joined = _with_orders(spark, sf_dir, d)
    if not label:
        return joined.select(*_review_columns(d))
    lab = _table(spark, sf_dir, "labels", "doc_id", "quality")
    joined = joined.join(lab, F.col("_doc_id") == F.col("doc_id"), "left")
    return joined.select(*_review_columns(d), F.col("quality").cast("int").alias("label"))


def texts_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reviewID, reviewText, summary) straight from the document scan."""
    return _documents(spark, sf_dir, None).select("reviewID", "reviewText", "summary")


def scoring_from_documents(spark: SparkSession, sf_dir: str, derive: Derive | None = None) -> DataFrame:
    """Scoring-table view: documents that have no label row (left anti join)."""
    lab = _table(spark, sf_dir, "labels", "doc_id")
    d = _documents(spark, sf_dir, derive)
    unlabelled = d.join(lab, F.col("_doc_id") == F.col("doc_id"), "left_anti")
    return _with_orders(spark, sf_dir, unlabelled).select(*_review_columns(d))


def reviews_from_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational review view at volume: reviewer = customer, product = part.

    ``reviewID`` (order key and line number) is not unique in the fixture, so
    queries over this view return keys and aggregates, never a survivor's id.
    """
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    o = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "inner")
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("reviewID"),
        F.col("o_custkey").cast("string").alias("reviewerID"),
        F.col("l_partkey").cast("string").alias("asin"),
        (F.col("l_returnflag") == "N").alias("verified"),
        F.col("l_quantity").alias("overall"),
        F.unix_timestamp(F.col("o_orderdate")).alias("unixReviewTime"),
    )


def tagged_benchmark(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fixture tagger tables (previous, tag, n) and (tag, word, n): the words of the small ``benchmark``
    table, tagged by fixed arithmetic (the texts are invented words, so no tagged text exists)."""
    words = tokenize(F.col("text"))
    tag = lambda w: F.element_at(F.array(*[F.lit(t) for t in FIXTURE_TAGS]),
                                 (F.length(w) * 3 + F.ascii(w)) % len(FIXTURE_TAGS) + 1)
    texts = _table(spark, sf_dir, "benchmark", "text").select(words.alias("w"))
    tags = texts.select(F.concat(F.array(F.lit("<s>")), F.transform("w", tag)).alias("t"))
    steps = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.struct(
        F.get("t", i - 1).alias("previous"), F.get("t", i).alias("tag")))
    transitions = (tags.select(F.explode_outer(steps).alias("s")).select("s.*").where(F.col("tag").isNotNull())
                   .groupBy("previous", "tag").agg(F.count(F.lit(1)).alias("n")))
    emissions = (texts.select(F.explode_outer("w").alias("word")).where(F.col("word").isNotNull())
                 .groupBy(tag(F.col("word")).alias("tag"), "word").agg(F.count(F.lit(1)).alias("n")))
    return transitions, emissions
