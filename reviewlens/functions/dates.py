"""Review dates.

``to_date(from_unixtime(x))`` depends on the session time zone;
``reviewlens.session.configure`` pins it to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewlens.functions.constants import AS_OF_YEAR


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_date(epoch_seconds: str | Column) -> Column:
    """Epoch seconds -> calendar date (session zone)."""
    return F.to_date(F.from_unixtime(_c(epoch_seconds)))


def date_parts(date: str | Column, as_of_year: int = AS_OF_YEAR) -> dict[str, Column]:
    """Year, month, day of week (1 = Sunday) and age in years."""
    d = _c(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day_of_week": F.dayofweek(d),
        "age": F.lit(as_of_year) - F.year(d),
    }


def days_between(end: str | Column, start: str | Column) -> Column:
    """Whole days from ``start`` to ``end``."""
    return F.datediff(_c(end), _c(start))
