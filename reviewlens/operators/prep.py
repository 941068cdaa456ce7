"""Row preparation: P1-P12 with D1-D4 and T1-T6 (review and text columns).

Per-row columns are computed *before* the dedup shuffle. They are deterministic
per row, so the result is the same as computing them afterwards, but Catalyst
can then prune the raw text out of the shuffle when only lengths, flags or
scores are used downstream. The null drop (P9) stays *after* the dedup, as in
the analysed notebooks: it is evaluated on flags computed per row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewlens.functions import bins, dates, text

_HAS_TEXT = "_has_text"


def cast_verified(df: DataFrame, col: str = "verified") -> DataFrame:
    """Boolean -> integer."""
    return df.withColumn(col, F.col(col).cast("int"))


def add_review_dates(df: DataFrame, epoch_col: str = "unixReviewTime", out: str = "reviewTime",
                     as_of_year: int | None = None) -> DataFrame:
    """D1-D4 + P2/P8: replace epoch seconds by a date and its parts, one Project."""
    # The date is projected first and the parts read the column, so the
    # format/parse of ``to_date(from_unixtime(...))`` runs once per row.
    with_date = df.withColumn(out, dates.epoch_to_date(epoch_col)).drop(epoch_col)
    parts = dates.date_parts(out) if as_of_year is None else dates.date_parts(out, as_of_year)
    return with_date.withColumns(parts)


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``.

    Written as ``IS NOT NULL`` predicates (pushed to the scan when directly over
    it). ``na.drop`` would also drop NaN and is not pushed down.
    """
    cond = None
    for c in cols:
        p = F.col(c).isNotNull()
        cond = p if cond is None else cond & p
    return df.where(cond) if cond is not None else df


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """P10: one row per key; the survivor is the latest review, then the
    smallest ``reviewID`` (the reference keeps an arbitrary row).

    Planned as ``row_number() == 1``: Spark inserts a partial
    ``WindowGroupLimit`` before the exchange, so a hot key is cut to one row per
    map task before it is shuffled.
    """
    order = list(order) if order else [F.desc_nulls_last("unixReviewTime"), F.asc("reviewID")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def quality_report(df: DataFrame, keys: Sequence[str], null_cols: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and nulls per column in one aggregate pass. A
    null in a key is a value like any other, as in the dedup."""
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.count_distinct(F.struct(*keys)).alias("distinct_keys")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in null_cols]
    return df.agg(*aggs)


def dedup_row_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after the dedup on ``keys``, in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_distinct(F.struct(*keys)).alias("rows_after"))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop-list projection; names the table does not have are ignored."""
    return df.drop(*cols)


def require_unique(df: DataFrame, id_col: str) -> None:
    """Fail if an id occurs twice: a join back by id would multiply its rows.
    One aggregate over the id column; nulls count as one id."""
    twice = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"{id_col} must be unique; {twice[0][0]!r} occurs {twice[0]['n']} times")


def dedup_then_require(df: DataFrame, dedup_keys: Sequence[str] = ("reviewerID", "asin"),
                       required: Sequence[str] = ("label",)) -> DataFrame:
    """P10 then P9: dedup, then dates, then drop rows without text (via the
    per-row flag) or without the other ``required`` columns."""
    kept = add_review_dates(dedup_latest(df, list(dedup_keys)))
    cond = F.col(_HAS_TEXT)
    for c in required:
        cond = cond & F.col(c).isNotNull()
    return kept.where(cond).drop(_HAS_TEXT, "reviewText", "summary")


def length_columns(df: DataFrame) -> DataFrame:
    """Per-row columns of the length study: ``reviewTot`` (punctuation collapsed),
    its length and B1 segment, and the flag the null rule uses."""
    collapsed = text.collapse_punctuation(text.combine_text("reviewText", "summary"))
    derived = df.withColumns({"reviewTot": collapsed, _HAS_TEXT: F.col("reviewText").isNotNull()})
    # length from the column, segments from the length column: each is computed
    # once per row instead of once per CASE branch.
    derived = derived.withColumn("reviewTot_length", text.text_length("reviewTot"))
    derived = derived.withColumns({
        "segment_no": bins.segment_number("reviewTot_length"),
        "reviewTot_segment": bins.segment_label("reviewTot_length"),
    })
    return derived.drop("reviewText", "summary")


def length_study(df: DataFrame, dedup_keys: Sequence[str] = ("reviewerID", "asin")) -> DataFrame:
    """Length study rows (LT): prep -> punctuation collapse -> length -> B1 segment."""
    return dedup_then_require(length_columns(df), dedup_keys)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> Iterator[DataFrame]:
    """``df`` kept by the executors inside a ``with`` block and released at its end, also after an error.

    For a table that several actions of one step read; what outlives the step, or must survive lost
    executors without being computed again, is checkpointed instead.
    """
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist(blocking=True)
