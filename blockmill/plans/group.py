"""Grouped aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.aggregators import Aggregator
from blockmill.functions.exprs import Expression, column, no_null


@dataclass(frozen=True)
class GroupQuery:
    """Groups by one or more keys. A null key is a group of its own; strict makes it an error."""

    scan: Callable[[], DataFrame]
    keys: tuple[Expression, ...]
    strict: bool = False

    def _keyed(self) -> tuple[DataFrame, list[str]]:
        df = self.scan()
        names = ["key"] if len(self.keys) == 1 else [f"key{i + 1}" for i in range(len(self.keys))]
        for e in self.keys:
            if e is None:
                raise ValueError("a group needs a key")
        return df, names

    def aggregate(self, aggregator: Aggregator) -> DataFrame:
        """key (or key1, key2, ...) and value: one row a group, in no order."""
        return self.aggregate_all(value=aggregator)

    def aggregate_all(self, **aggregators: Aggregator) -> DataFrame:
        """Several aggregates of the same groups in one pass."""
        df, names = self._keyed()
        keys = [column(df, e) for e in self.keys]
        keys = [no_null(k, "group key") if self.strict else k for k in keys]
        return df.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(*[a.build(df).alias(n) for n, a in aggregators.items()])

    def aggregate_rows(self, fold: Callable[[pd.DataFrame], object], value_type: str) -> DataFrame:
        """For what no aggregate expression says: fold gets all rows of a group as a pandas frame, so a
        group must fit in a task. Prefer aggregate."""
        df, names = self._keyed()
        rows = df.withColumns({n: column(df, e) for n, e in zip(names, self.keys, strict=True)})
        types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

        def one(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{n: [group[n].iloc[0]] for n in names}, "value": [fold(group.drop(columns=names))]})

        return rows.groupBy(*[F.col(n) for n in names]).applyInPandas(one, f"{types}, value {value_type}")
