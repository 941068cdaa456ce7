"""Bucketing and the rule classifier, built from bounds lists.

Bin labels are strings: the reference mixes integer bins with an ``"Unknown"``
fallback, which under ANSI mode fails on the first row reaching the fallback.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from reviewlens.functions.constants import (
    COMPOUND_BIN_EDGES,
    EXTREMITY_THRESHOLD,
    LENGTH_SEGMENT_BOUNDS,
    LENGTH_SEGMENT_LABELS,
    POLARITY_BIN_EDGES,
    SUBJECTIVITY_BIN_EDGES,
    UNKNOWN_BIN,
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segment_number(length: str | Column, bounds: Sequence[int] = LENGTH_SEGMENT_BOUNDS) -> Column:
    """B1 number: 1 for ``< bounds[0]``, ..., ``len(bounds)+1`` for the top,
    ``len(bounds)+2`` when the length is null."""
    x = _c(length)
    expr = F.when(x < bounds[0], F.lit(1))
    for i, b in enumerate(bounds[1:], start=2):
        expr = expr.when(x < b, F.lit(i))
    expr = expr.when(x >= bounds[-1], F.lit(len(bounds) + 1))
    return expr.otherwise(F.lit(len(bounds) + 2))


def segment_label(length: str | Column, bounds: Sequence[int] = LENGTH_SEGMENT_BOUNDS,
                  labels: Sequence[str] = LENGTH_SEGMENT_LABELS) -> Column:
    """B1 label (text), aligned with :func:`segment_number`."""
    x = _c(length)
    expr = F.when(x < bounds[0], F.lit(labels[0]))
    for i, b in enumerate(bounds[1:], start=1):
        expr = expr.when(x < b, F.lit(labels[i]))
    expr = expr.when(x >= bounds[-1], F.lit(labels[len(bounds)]))
    return expr.otherwise(F.lit(labels[len(bounds) + 1]))


def right_closed_bin(score: str | Column, edges: Sequence[float]) -> Column:
    """Bins ``(-inf, e1], (e1, e2], ..., (e_last, inf)`` labelled "1".."n+1";
    null gives ``"Unknown"``. The score is compared as double, so a float score
    of exactly 0.2 (0.2000000029...) falls in the bin above 0.2."""
    x = _c(score).cast("double")
    expr = F.when(x <= edges[0], F.lit("1"))
    for i, e in enumerate(edges[1:], start=2):
        expr = expr.when(x <= e, F.lit(str(i)))
    expr = expr.when(x > edges[-1], F.lit(str(len(edges) + 1)))
    return expr.otherwise(F.lit(UNKNOWN_BIN))


def compound_bin(score: str | Column) -> Column:
    """B2: 8 compound-score bins."""
    return right_closed_bin(score, COMPOUND_BIN_EDGES)


def polarity_bin(score: str | Column) -> Column:
    """5 polarity bins."""
    return right_closed_bin(score, POLARITY_BIN_EDGES)


def subjectivity_bin(score: str | Column) -> Column:
    """5 subjectivity bins."""
    return right_closed_bin(score, SUBJECTIVITY_BIN_EDGES)


def extremity_prediction(score: str | Column, threshold: float = EXTREMITY_THRESHOLD) -> Column:
    """1 when ``|score| > threshold`` else 0 (null -> 0)."""
    x = _c(score)
    return F.when((x > threshold) | (x < -threshold), F.lit(1)).otherwise(F.lit(0))
