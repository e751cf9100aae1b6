"""One way to name an expression: a Column, SQL text, or a function of the DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expression = Union[Column, str, Callable[[DataFrame], Column]]


def column(df: DataFrame, expression: Expression) -> Column:
    if expression is None:
        raise ValueError("an expression is missing")
    if isinstance(expression, str):
        return F.expr(expression)
    return expression(df) if callable(expression) and not isinstance(expression, Column) else expression


def holds(condition: Column) -> Column:
    """Two-valued truth: null counts as false."""
    return F.coalesce(condition, F.lit(False))


def no_null(value: Column, what: str) -> Column:
    """value, failing the job where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(f"null {what}")))
