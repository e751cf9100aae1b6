"""Inner joins of two sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from blockmill.functions.exprs import Expression, column
from blockmill.functions.predicates import Predicate
from blockmill.plans.rising import tiles

Pair = Callable[[DataFrame, DataFrame], Column]


@dataclass(frozen=True)
class JoinQuery:
    """Left and right rows are called l and r: SQL text names their columns l.x and r.y, functions get
    both DataFrames. Neither on replaces the other: the last one counts."""

    left: Callable[[], DataFrame]
    right: Callable[[], DataFrame]
    keys: tuple[Expression, Expression] | None = None
    condition: Pair | str | None = None
    predicate: Predicate | None = None
    output: tuple = ()
    how: str = "inner"
    rising: tuple[Expression, Expression, Callable[[Column, Column], Column]] | None = None

    def on_keys(self, left: Expression, right: Expression) -> "JoinQuery":
        """Equal keys; null matches nothing; every matching pair is a row. Spark sorts, hashes or
        broadcasts as sizes suggest and splits skewed keys."""
        if left is None or right is None:
            raise ValueError("a join needs both keys")
        return replace(self, keys=(left, right), condition=None, rising=None)

    def on_condition(self, condition: Pair | str) -> "JoinQuery":
        """Any condition on a pair. One side should be small: every pair of rows is looked at unless the
        condition holds an equality; on_rising doesn't."""
        if condition is None:
            raise ValueError("a join needs a condition")
        return replace(self, keys=None, condition=condition, rising=None)

    def on_rising(self, left: Expression, right: Expression, condition: Callable[[Column, Column], Column]) -> "JoinQuery":
        """A condition on a number of each side that stays true for greater numbers, as that of a sum
        above a bound; null matches nothing. Both sides may be large: buckets of rows that can't match
        are never paired (counting them runs at once). Inner joins only, other kinds look at every pair."""
        if left is None or right is None or condition is None:
            raise ValueError("a join needs both numbers and a condition")
        return replace(self, keys=None, condition=None, rising=(left, right, condition))

    def where(self, predicate: Expression | Predicate) -> "JoinQuery":
        """Filters the left rows before the join; ANDs with what is there."""
        p = Predicate.of(predicate)
        return replace(self, predicate=self.predicate.and_(p) if self.predicate else p)

    def kind(self, how: str) -> "JoinQuery":
        """Beyond inner joins: left, right, full, semi, anti."""
        return replace(self, how=how)

    def select(self, *output) -> "JoinQuery":
        """Columns of the result: SQL text over l and r, or functions of both DataFrames."""
        if not output or any(o is None for o in output):
            raise ValueError("a join needs columns to select")
        return replace(self, output=output)

    def df(self) -> DataFrame:
        if self.keys is None and self.condition is None and self.rising is None:
            raise RuntimeError("the join has no on")
        left = self.left()
        if self.predicate:
            left = left.where(self.predicate.on(left))
        right = self.right()
        key, tile = "_key", "_tile"
        while any(c.lower().startswith((key, tile)) for c in left.columns + right.columns):
            key, tile = key + "_", tile + "_"
        if on := self.keys or self.rising:
            left, right = left.withColumn(key, column(left, on[0])), right.withColumn(key, column(right, on[1]))
        tiled = self.rising and self.how == "inner"
        if tiled:
            left, right = tiles(left, right, key, tile, self.rising[2])
        left, right = left.alias("l"), right.alias("r")
        if self.condition is not None:
            on = self._pair(self.condition, left, right)
        else:
            on = (self.rising[2] if self.rising else Column.__eq__)(F.col(f"l.{key}"), F.col(f"r.{key}"))
        if tiled:
            on = (F.col(f"l.{tile}") == F.col(f"r.{tile}")) & on
        joined = left.join(right, on, self.how)
        if self.output:
            return joined.select(*[self._pair(o, left, right) for o in self.output])
        return joined.drop(key, tile)

    @staticmethod
    def _pair(e: Pair | str | Column, left: DataFrame, right: DataFrame) -> Column:
        return F.expr(e) if isinstance(e, str) else e if isinstance(e, Column) else e(left, right)

    def fetch(self) -> list[Row]:
        return self.df().collect()
