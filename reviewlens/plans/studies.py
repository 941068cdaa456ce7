"""Feature builds of the studies, with text work ahead of every join.

``score_texts`` and ``model_texts`` turn the text columns of a review table into
narrow per-row columns (flags, lengths, sentiment scores); the texts themselves
go no further. They run on the whole table or, through an adapter's ``derive``
hook, on the side of a join that holds the texts.

The model's feature build then keeps the notebook's order where it changes results:

1. ``verified`` to int; reviewer and product counts joined back (J1, J2) on the
   table *before* the dedup.
2. train only: dedup on (reviewer, product) (P10). The narrow result is
   checkpointed, as the product aggregates and the numbering read it again.
3. dates (D1-D4); product statistics and recency order (J3 + W1) *after* the
   dedup but *before* the null drop.
4. train only: drop rows without text or label.
5. the regex-cleaned text (T3-T5) is attached at the end by one join on
   ``reviewID``, where a caller wants it.

``reviewID`` must be unique; both builds check it first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reviewlens.functions import text
from reviewlens.operators import features, prep, sentiment


def score_texts(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame | None = None) -> DataFrame:
    """``df`` without its texts, with ``_has_text``, ``combined_text_length`` and the
    Z1-Z3 scores of the lower-cased text and summary."""
    texts = df.select("reviewID", text.combine_text("reviewText", "summary").alias("reviewTot"))
    narrow = df.withColumns({
        "_has_text": F.col("reviewText").isNotNull(),
        "combined_text_length": text.text_length(text.combine_text("reviewText", "summary")),
    }).drop("reviewText", "summary")
    return sentiment.add_sentiment(narrow, sentiment.sentiment_scores(texts, lexicon, modifiers=modifiers))


def with_cleaned_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with ``combined_text`` of their (reviewID, reviewText, summary). Texts are cleaned behind the
    join, so only those of the rows that are left."""
    joined = rows.join(texts.select("reviewID", "reviewText", "summary"), on="reviewID", how="inner")
    return joined.select(*rows.columns, text.clean_text(text.combine_text("reviewText", "summary")).alias("combined_text"))


def build_features(df: DataFrame, lexicon: DataFrame, mode: str = "train", modifiers: DataFrame | None = None) -> DataFrame:
    """Model features of a review table (``mode`` is "train" or "score") with the cleaned text."""
    narrow = build_narrow_features(score_texts(df, lexicon, modifiers), mode)
    return with_cleaned_texts(narrow, df)


def build_narrow_features(scored: DataFrame, mode: str = "train") -> DataFrame:
    """Model features, without the text, of a table that went through ``score_texts``.

    Nulls of the feature columns get fixed values, since the assembler refuses
    them: ``verified`` 0, ``overall`` 0.0 (no rating given).
    """
    if mode not in ("train", "score"):
        raise ValueError("mode must be 'train' or 'score'")
    train = mode == "train"
    prep.require_unique(scored, "reviewID")
    r = prep.cast_verified(scored).withColumns({"verified": F.coalesce(F.col("verified").cast("int"), F.lit(0)),
                                                "overall": F.coalesce("overall", F.lit(0.0))})
    r = features.add_group_count(r, "reviewerID", "review_count")
    r = r.withColumnRenamed("asin", "productId")
    r = features.add_group_count(r, "productId", "productId_count")
    if train:
        r = prep.dedup_latest(r, ["reviewerID", "productId"])
    r = prep.add_review_dates(r).checkpoint(eager=True)
    r = features.product_features(r, deduplicated=train)
    if train:
        r = r.where(F.col("_has_text") & F.col("label").isNotNull())
    return r.drop("_has_text")


def length_feature_rows(df: DataFrame) -> DataFrame:
    """Length-study rows for the one-feature model (LT)."""
    return prep.length_study(df).select("reviewID", "label", "reviewTot_length")


def sentiment_study(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame | None = None) -> DataFrame:
    """Sentiment-study rows (SA): (reviewID, label, scores, reviewTime, year,
    month, day_of_week, age, reviewerID, asin) after dedup and null drop."""
    return scored_study(score_texts(df, lexicon, modifiers))


def scored_study(scored: DataFrame) -> DataFrame:
    """Sentiment-study rows of a table that went through ``score_texts``. The scores
    are per row, so the dedup keeps the same survivor as when scoring after it."""
    prep.require_unique(scored, "reviewID")
    return prep.dedup_then_require(scored)


def numeric_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Label as double (what ``pyspark.ml`` classifiers expect)."""
    return df.withColumn(label, F.col(label).cast("double"))


def prepare_for_text(df: DataFrame) -> DataFrame:
    """Rows for text-only models: dedup, null drop, cleaned combined text."""
    rows = prep.dedup_then_require(
        df.withColumns({"combined_text": text.clean_text(text.combine_text("reviewText", "summary")),
                        "_has_text": F.col("reviewText").isNotNull()}))
    return rows.select("reviewID", "label", "combined_text")
