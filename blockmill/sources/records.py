"""Schemas of record types, and what each supported Python type is in Spark."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import types as py
import typing
import uuid

from pyspark.sql import types as T

#: Fixed mapping; integers are longs unless Annotated with a narrower Spark type.
SCALARS: dict[type, T.DataType] = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    decimal.Decimal: T.DecimalType(38, 18),
    dt.datetime: T.TimestampType(),
    dt.date: T.DateType(),
    dt.timedelta: T.DayTimeIntervalType(),
    uuid.UUID: T.StructType().add("hi", T.LongType(), False).add("lo", T.LongType(), False),
}


class RecordTypes:
    """Types by name or class; more can be registered or replaced."""

    def __init__(self) -> None:
        self._types = dict(SCALARS)

    def register(self, kind: type, data_type: T.DataType) -> "RecordTypes":
        self._types[kind] = data_type
        return self

    def data_type(self, kind) -> tuple[T.DataType, bool]:
        """Spark's type of a Python type and whether it may be null: only Optional may."""
        origin, args = typing.get_origin(kind), typing.get_args(kind)
        if origin is typing.Annotated:
            return next((a for a in args[1:] if isinstance(a, T.DataType)), None) or self.data_type(args[0])[0], False
        if origin in (typing.Union, py.UnionType):
            inner = [a for a in args if a is not type(None)]
            if len(inner) != 1 or len(args) != 2:
                raise ValueError(f"{kind}: only Optional unions are supported")
            return self.data_type(inner[0])[0], True
        if origin in (list, set, frozenset) and len(args) == 1:
            return T.ArrayType(self.data_type(args[0])[0], self.data_type(args[0])[1]), False
        if origin is dict and len(args) == 2:
            return T.MapType(self.data_type(args[0])[0], self.data_type(args[1])[0], self.data_type(args[1])[1]), False
        if kind in self._types:
            return self._types[kind], False
        if isinstance(kind, type) and issubclass(kind, enum.Enum):
            return T.StringType(), False
        if dataclasses.is_dataclass(kind):
            return self.schema(kind), False
        raise ValueError(f"{kind}: no such type is supported")

    def schema(self, record: type) -> T.StructType:
        """A dataclass's fields in the order they are declared."""
        if not dataclasses.is_dataclass(record):
            raise ValueError(f"{record} is no record")
        hints, out = typing.get_type_hints(record, include_extras=True), T.StructType()
        for f in dataclasses.fields(record):
            data_type, null = self.data_type(hints[f.name])
            out = out.add(f.name, data_type, null)
        return out


def uuid_halves(value: uuid.UUID) -> tuple[int, int]:
    """A UUID as two signed longs, whose order is the order of origins in a merge."""
    return tuple(int.from_bytes(value.bytes[i : i + 8], "big", signed=True) for i in (0, 8))
