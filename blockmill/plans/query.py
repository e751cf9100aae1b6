"""A query of one source: filter, order, page, find, count, summarize, group, join."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from blockmill.functions.aggregators import NAN, least
from blockmill.functions.exprs import Expression, column, no_null
from blockmill.functions.predicates import Predicate
from blockmill.plans.selection import keep_smallest, skip_smallest

#: Rows from which a hint to work in parallel pays in a local engine; Spark needs no hint.
DEFAULT_PARALLEL_THRESHOLD = 50_000


class Order(Enum):
    ASC = "asc"
    DESC = "desc"


class NullOrdering(Enum):
    NULLS_FIRST = "first"
    NULLS_LAST = "last"


@dataclass(frozen=True)
class QueryResult:
    """Rows and how long they took, in nanoseconds."""

    items: list[Row]
    elapsed_ns: int


def _not_negative(n: int, what: str) -> int:
    if n < 0:
        raise ValueError(f"{what} is negative")
    return n


@dataclass(frozen=True)
class BlockQuery:
    """Every step gives a new query, so one can be kept and extended in several ways. Nothing runs
    before rows are asked for; the *_df methods give lazy DataFrames."""

    scan: Callable[[], DataFrame]
    resolve: Callable[[str], DataFrame] | None = None
    predicate: Predicate | None = None
    ordering: tuple[Expression, Order, NullOrdering] | None = None
    most: int | None = None
    skipped: int = 0
    hinted: bool = False

    # steps
    def where(self, predicate: Expression | Predicate) -> "BlockQuery":
        """AND with what is there."""
        p = Predicate.of(predicate)
        return replace(self, predicate=self.predicate.and_(p) if self.predicate else p)

    and_ = where

    def or_(self, predicate: Expression | Predicate) -> "BlockQuery":
        """OR with all of what is there; the first predicate if nothing is."""
        p = Predicate.of(predicate)
        return replace(self, predicate=self.predicate.or_(p) if self.predicate else p)

    def order_by(self, field: Expression, order: Order = Order.ASC, nulls: NullOrdering = NullOrdering.NULLS_FIRST) -> "BlockQuery":
        """Order by one field; a later call replaces an earlier one. The place of nulls is that of
        ascending order and turns round with DESC."""
        if field is None or order is None or nulls is None:
            raise ValueError("an order needs a field and directions")
        return replace(self, ordering=(field, order, nulls))

    def limit(self, n: int) -> "BlockQuery":
        return replace(self, most=_not_negative(n, "limit"))

    def offset(self, n: int) -> "BlockQuery":
        return replace(self, skipped=_not_negative(n, "offset"))

    def parallel(self) -> "BlockQuery":
        """A hint that changes nothing: Spark always works in parallel."""
        return replace(self, hinted=True)

    # plans
    def matching_df(self) -> DataFrame:
        df = self.scan()
        return df.where(self.predicate.on(df)) if self.predicate else df

    def _order(self, df: DataFrame) -> Column:
        field, order, nulls = self.ordering
        c, first = column(df, field), nulls is NullOrdering.NULLS_FIRST
        if order is Order.ASC:
            return c.asc_nulls_first() if first else c.asc_nulls_last()
        return c.desc_nulls_last() if first else c.desc_nulls_first()

    def df(self) -> DataFrame:
        """Ordered, then skipped, then limited, whatever the order of the calls."""
        df = self.matching_df()
        if self.ordering:
            df = df.orderBy(self._order(df))
        return self._paged(df)

    def _paged(self, df: DataFrame) -> DataFrame:
        if self.skipped and self.most is None and (skipped := self._skipped(self.matching_df())) is not None:
            return skipped
        df = df.offset(self.skipped) if self.skipped else df
        return df if self.most is None else df.limit(self.most)

    def _skipped(self, df: DataFrame) -> DataFrame | None:
        """df from the page's start on, where no limit follows: a filter on the key of the last row that
        is skipped, as an offset alone would take all rows through one task. Finding that key runs at
        once. None for rows that can't be told apart by a hash (maps)."""
        if any("map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() for f in df.schema):
            return None
        own = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("own")
        if not self.ordering:
            return skip_smallest(df, F.struct(own), self.skipped)
        field, order, nulls = self.ordering
        value = column(df, field)
        last = (nulls is NullOrdering.NULLS_FIRST) == (order is Order.DESC)
        key = F.struct((value.isNull() == F.lit(last if order is Order.ASC else not last)).alias("after"), value.alias("value"), own)
        if order is Order.ASC:
            return (rows := skip_smallest(df, key, self.skipped)).orderBy(self._order(rows))
        rows = keep_smallest(df, key, max(df.count() - self.skipped, 0))
        return rows.orderBy(self._order(rows))

    def count_df(self) -> DataFrame:
        """One row, count: the rows of the page. Order doesn't matter to it, and the page is arithmetic."""
        left = F.greatest(F.count(F.lit(1)) - self.skipped, F.lit(0).cast("bigint"))
        return self.matching_df().agg((left if self.most is None else F.least(left, F.lit(self.most).cast("bigint"))).alias("count"))

    def count_matching_df(self) -> DataFrame:
        """One row, count, whatever the page."""
        return self.matching_df().agg(F.count(F.lit(1)).alias("count"))

    def find_first_df(self) -> DataFrame:
        """The page's first row, if any."""
        return self.df().limit(1)

    def find_any_df(self) -> DataFrame:
        """Some matching row, whatever order and page."""
        return self.matching_df().limit(1)

    def summarize_df(self, field: Expression, strict: bool = False) -> DataFrame:
        """One row of the page's field as double: count, sum, min, max, avg; of no rows 0, 0.0 and NaN.
        Nulls count as rows but have no number; strict makes one an error."""
        df = self.df()
        value = column(df, field).cast("double")
        value = no_null(value, "number") if strict else value
        some = lambda c, other: F.coalesce(c, F.lit(other))
        return df.select(value.alias("v")).agg(
            F.count(F.lit(1)).alias("count"), some(F.sum("v"), 0.0).alias("sum"), some(least(F.col("v")), NAN).alias("min"), some(F.max("v"), NAN).alias("max"), some(F.avg("v"), NAN).alias("avg")
        )

    def group_by(self, *keys: Expression, strict: bool = False):
        """Groups of the matching rows; order and page don't matter."""
        from blockmill.plans.group import GroupQuery

        return GroupQuery(self.matching_df, keys, strict)

    def join(self, name: str, decoder: Callable[[DataFrame], DataFrame] | None = None):
        """An inner join of the matching rows with another source; order and page don't matter."""
        from blockmill.plans.join import JoinQuery

        if self.resolve is None:
            raise NotImplementedError("a query over one table has no other source to join")
        right = self.resolve(name)
        return JoinQuery(self.matching_df, lambda: (decoder or (lambda df: df))(right))

    # rows
    def fetch(self) -> list[Row]:
        return self.df().collect()

    def fetch_result(self) -> QueryResult:
        began = time.perf_counter_ns()
        return QueryResult(self.fetch(), time.perf_counter_ns() - began)

    def count(self) -> int:
        return self.count_df().first()["count"]

    def count_matching(self) -> int:
        return self.count_matching_df().first()["count"]

    def find_first(self) -> Row | None:
        return self.find_first_df().first()

    def find_any(self) -> Row | None:
        return self.find_any_df().first()

    def summarize(self, field: Expression) -> Row:
        return self.summarize_df(field).first()
