"""Evaluating an expression once where it is used many times.

The optimizer copies a projected expression into every filter and lambda that reads it. For a pass over a whole text
that multiplies the work, so such values are bound first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once per row and that filters above do not take apart."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
