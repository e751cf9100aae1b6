"""Decoders turn a source's rows into the rows a query works on, one for one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockmill.functions.exprs import Expression, column

Decoder = Callable[[DataFrame], DataFrame]


def identity() -> Decoder:
    return lambda df: df


def typed(schema: StructType) -> Decoder:
    """The rows as they are, if their columns have the types of schema; a type that differs is an error
    at once, a row that is null in every column is one when it is read."""

    def decode(df: DataFrame) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        wrong = [f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType}" for f in schema if have.get(f.name) != f.dataType]
        if wrong:
            raise TypeError("; ".join(wrong))
        null = reduce(lambda a, b: a & b, [F.col(f"`{f.name}`").isNull() for f in schema])
        # a filter of its own, so that others still reach the scan
        return df.where(F.when(null, F.raise_error(F.lit("null row")).cast("boolean")).otherwise(F.lit(True)))

    return decode


def select(**fields: Expression) -> Decoder:
    """A row of named expressions."""
    return lambda df: df.select(*[column(df, e).alias(n) for n, e in fields.items()])


def non_null(decoder: Decoder, field: str, skip: bool = False, key: str = "key") -> Decoder:
    """decoder's rows with field not null: other rows are left out with skip, else an error that names
    their key."""

    def decode(df: DataFrame) -> DataFrame:
        rows = decoder(df)
        if skip:
            return rows.where(F.col(field).isNotNull())
        message = F.concat(F.lit("decoded to null: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))) if key in rows.columns else F.lit("decoded to null")
        return rows.withColumn(field, F.coalesce(F.col(field), F.raise_error(message)))

    return decode
