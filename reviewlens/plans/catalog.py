"""Query catalog: every registered query with its DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the driver's tables through the
fixture adapters and returns a DataFrame. ``oracle`` is the equivalent DuckDB
SQL, or ``None`` where the result is not expressible in SQL (model fits).
Doubles are rounded to 6 places on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from reviewlens.plans.columns import RESULT_COLUMNS
from reviewlens.session import configure


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def result_columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in RESULT_COLUMNS[name].split(", ")]


def typed(df: DataFrame, name: str) -> DataFrame:
    """Round doubles and floats to 6 places; cast to the declared result columns, if there are any."""
    if name not in RESULT_COLUMNS:
        return df.select(*[F.round(F.col(f.name).cast("double"), 6).alias(f.name)
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                           for f in df.schema.fields])
    cols = []
    for col, kind in result_columns(name):
        value = F.col(col).cast(kind)
        cols.append((F.round(value, 6) if kind == "double" else value).alias(col))
    return df.select(*cols)


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return typed(fn(spark, sf_dir), name)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: q.run for k, q in REGISTRY.items()}


_DUCK = {"string": "varchar"}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the registered queries, cast to their result columns."""
    _load()
    out = {}
    for name, query in REGISTRY.items():
        if query.oracle:
            cols = []
            for col, kind in result_columns(name):
                value = f'cast("{col}" as {_DUCK.get(kind, kind)})'
                cols.append(f'{f"round({value}, 6)" if kind == "double" else value} as "{col}"')
            out[name] = f"select {', '.join(cols)}\nfrom (\n{query.oracle}\n) as oracle_result"
    return out


def _load() -> None:
    # Import the modules that register queries (idempotent).
    from reviewlens.plans import queries_eda, queries_prep, queries_text, queries_tokens, queries_ml, queries_stores  # noqa: F401
