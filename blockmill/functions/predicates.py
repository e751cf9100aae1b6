"""Predicates as immutable trees over expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from blockmill.functions.exprs import Expression, column, holds


@dataclass(frozen=True)
class Predicate:
    """A leaf, or a pair of predicates, or a negation. No row makes a predicate null: null is false."""

    kind: str
    parts: tuple

    @staticmethod
    def of(expression: "Expression | Predicate") -> "Predicate":
        if expression is None:
            raise ValueError("a predicate is missing")
        return expression if isinstance(expression, Predicate) else Predicate("leaf", (expression,))

    def and_(self, other: "Expression | Predicate") -> "Predicate":
        return Predicate("and", (self, Predicate.of(other)))

    def or_(self, other: "Expression | Predicate") -> "Predicate":
        return Predicate("or", (self, Predicate.of(other)))

    def not_(self) -> "Predicate":
        return Predicate("not", (self,))

    def on(self, df: DataFrame) -> Column:
        """The condition for df. Only a negation needs null made false first, so that plain conditions
        stay in a form that scans can push down."""
        if self.kind == "leaf":
            return column(df, self.parts[0])
        if self.kind == "not":
            return ~holds(self.parts[0].on(df))
        left, right = (p.on(df) for p in self.parts)
        return (left & right) if self.kind == "and" else (left | right)
