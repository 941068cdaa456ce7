"""Read one element of an ML vector without a Python worker."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F


def vector_element(vec: str | Column, index: int, dtype: str = "float") -> Column:
    """Element ``index`` of a dense/sparse ML vector (e.g. P(label = 1))."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return vector_to_array(v)[index].cast(dtype)
