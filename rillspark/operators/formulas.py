"""Formulas as data: steps of named SQL expressions, evaluated in order.

A step is a mapping of new columns to expressions over the columns before it, so a set of formulas can be
read, listed and changed without code.  All steps of a set without a window become one
projection in Spark's plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = Sequence[Mapping[str, str]]


def evaluated(df: DataFrame, steps: Steps, numbers: Mapping[str, float] | None = None) -> DataFrame:
    """``df`` with all columns of the steps; ``{name}`` in an expression stands for a number."""
    for step in steps:
        df = df.withColumns({k: F.expr(v.format(**(numbers or {}))) for k, v in step.items()})
    return df


def with_missing(df: DataFrame, columns: Sequence[str], value: float | None = None) -> DataFrame:
    """``df`` with a constant double for each of the columns that it does not have."""
    return df.withColumns({c: F.lit(value).cast("double") for c in columns if c not in df.columns})


def as_statement(source: str, steps: Steps, numbers: Mapping[str, float] | None = None) -> str:
    """The same as nested SELECTs over a table or subquery, for an engine that is asked in SQL."""
    sql = f"SELECT * FROM {source}"
    for step in steps:
        sql = f"SELECT *, {', '.join(f'{v.format(**(numbers or {}))} AS {k}' for k, v in step.items())} FROM ({sql})"
    return sql
