"""Entry point: queries over one table or over a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from blockmill.plans.query import BlockQuery
from blockmill.sources.decoders import Decoder, identity
from blockmill.sources.registry import DataRegistry, Source


class QueryEngine:
    def __init__(self, resolve: Callable[[str], DataFrame], joins: bool):
        self._resolve, self._joins = resolve, joins

    @staticmethod
    def over(source: DataRegistry | Source) -> "QueryEngine":
        """Over a registry, by name; over one table, whatever the name, without joins."""
        if isinstance(source, DataRegistry):
            return QueryEngine(source.resolve, True)
        if source is None:
            raise ValueError("nothing to query")
        return QueryEngine(lambda name: source if isinstance(source, DataFrame) else source(), False)

    def from_(self, name: str, decoder: Decoder | None = identity()) -> BlockQuery:
        """Rows of a source through a decoder. An unknown name is an error now; what the rows are is
        settled at each compilation."""
        if decoder is None:
            raise ValueError("a decoder is missing")
        self._resolve(name)
        return BlockQuery(lambda: decoder(self._resolve(name)), self._resolve if self._joins else None)
