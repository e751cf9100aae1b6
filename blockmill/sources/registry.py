"""Named sources. A source is a DataFrame or a function that gives one each time it is asked."""

from __future__ import annotations

from collections.abc import Callable
from typing import Union

from pyspark.sql import DataFrame

Source = Union[DataFrame, Callable[[], DataFrame]]


class DataRegistry:
    """Sources by name. A function source is called at every compilation, so queries see what it holds
    then; a DataFrame source is the table as it was read."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def register(self, name: str, source: Source) -> "DataRegistry":
        """Add a source; a name that is taken is an error."""
        self._checked(name, source)
        if name in self._sources:
            raise ValueError(f"source {name!r} is registered already")
        self._sources[name] = source
        return self

    def register_or_replace(self, name: str, source: Source) -> "DataRegistry":
        self._checked(name, source)
        self._sources[name] = source
        return self

    def register_parquet(self, spark, name: str, path: str) -> "DataRegistry":
        """A Parquet table, listed anew at every compilation."""
        return self.register(name, lambda: spark.read.parquet(path))

    def contains(self, name: str) -> bool:
        return name in self._sources

    def names(self) -> list[str]:
        return sorted(self._sources)

    def resolve(self, name: str) -> DataFrame:
        if name not in self._sources:
            raise ValueError(f"no source is called {name!r}")
        source = self._sources[name]
        return source if isinstance(source, DataFrame) else source()

    @staticmethod
    def _checked(name: str, source: Source) -> None:
        if not name or source is None:
            raise ValueError("a source needs a name and rows")
