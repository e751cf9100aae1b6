"""Aggregators for groups. Numeric ones work on doubles; all are partial aggregates of Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.functions.exprs import Expression, column, no_null

NAN = float("nan")


@dataclass(frozen=True)
class Aggregator:
    """build(df) gives an aggregate Column; any aggregate expression of Spark will do."""

    build: Callable[[DataFrame], Column]

    @staticmethod
    def of(expression: Expression) -> "Aggregator":
        """A custom aggregator from an aggregate expression."""
        return Aggregator(lambda df: column(df, expression))


def _double(df: DataFrame, field: Expression, strict: bool) -> Column:
    value = column(df, field).cast("double")
    return no_null(value, "number") if strict else value


def least(value: Column) -> Column:
    """The minimum of doubles, NaN if any is NaN (Spark's own ranks NaN last)."""
    return F.when(F.bool_or(F.isnan(value)), F.lit(NAN)).otherwise(F.min(value))


def count() -> Aggregator:
    return Aggregator(lambda df: F.count(F.lit(1)))


def sum(field: Expression, strict: bool = False) -> Aggregator:  # noqa: A001
    """Sum as double. Nulls are left out; strict makes one an error."""
    return Aggregator(lambda df: F.coalesce(F.sum(_double(df, field, strict)), F.lit(0.0)))


def avg(field: Expression, strict: bool = False) -> Aggregator:
    return Aggregator(lambda df: F.coalesce(F.avg(_double(df, field, strict)), F.lit(NAN)))


def min(field: Expression, strict: bool = False) -> Aggregator:  # noqa: A001
    return Aggregator(lambda df: F.coalesce(least(_double(df, field, strict)), F.lit(NAN)))


def max(field: Expression, strict: bool = False) -> Aggregator:  # noqa: A001
    return Aggregator(lambda df: F.coalesce(F.max(_double(df, field, strict)), F.lit(NAN)))


def min_by(field: Expression) -> Aggregator:
    """The smallest value of the field itself, of any ordered type."""
    return Aggregator(lambda df: F.min(column(df, field)))


def max_by(field: Expression) -> Aggregator:
    """The largest value of the field itself."""
    return Aggregator(lambda df: F.max(column(df, field)))
