"""Change feeds: what happened to a block's keys, as a batch or a stream.

Events have op ('PUT', 'DELETE', 'EXPIRE', 'EVICT'), key columns, new_value, old_value, source.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockmill.functions.exprs import Expression, column, holds


def change_feed(log: DataFrame, keys: list[str], order: list[str], value: str, old_values: bool = True) -> DataFrame:
    """log rows (op, value) as events: a put's new_value, and the value before of the same key unless
    that was deleted. Without old_values old_value is null."""
    new = F.when(F.col("op") == "PUT", F.col(value))
    old = F.lag(new).over(W.partitionBy(*keys).orderBy(*order)) if old_values else F.lit(None)
    return log.withColumn("new_value", new).withColumn("old_value", old.cast(log.schema[value].dataType))


def expiry_events(state: DataFrame, keys: list[str], value: str, after_ms: int, until_ms: int) -> DataFrame:
    """EXPIRE events of rows whose time ends between two sweeps; these are always local."""
    due = state.where((F.col("_expiry_ms") > 0) & (F.col("_expiry_ms") < until_ms) & (F.col("_expiry_ms") >= after_ms))
    none = F.lit(None).cast(state.schema[value].dataType)
    return due.select(F.lit("EXPIRE").alias("op"), *keys, none.alias("new_value"), F.col(value).alias("old_value"), F.lit("LOCAL").alias("source"))


def source_tag(local: tuple[int, int], incoming: Column | None = None) -> Column:
    """LOCAL for expiries and for own writes outside an incoming apply, else REPLICATED."""
    own = (F.col("_origin_hi") == local[0]) & (F.col("_origin_lo") == local[1])
    own = own & ~holds(incoming) if incoming is not None else own
    return F.when((F.col("op") == "EXPIRE") | holds(own), "LOCAL").otherwise("REPLICATED")


def lag_ms(now: Expression, source: str) -> Callable[[DataFrame], Column]:
    """Milliseconds behind the source, at least 0; null where the source time is negative or null."""
    return lambda df: F.when(F.col(source) >= 0, F.greatest(column(df, now) - F.col(source), F.lit(0).cast("bigint")))


def lagging(events: DataFrame, now: Expression, source: str, threshold_ms: int) -> DataFrame:
    """Events with lag_ms at the threshold or over it."""
    if threshold_ms < 0:
        raise ValueError("the threshold is negative")
    return events.withColumn("lag_ms", lag_ms(now, source)(events)).where(F.col("lag_ms") >= threshold_ms)


@dataclass
class WatchHandle:
    """One subscription's query, and what it has counted. Cancelling twice does no harm."""

    query: object
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    received: int = 0
    skipped: int = 0

    @property
    def is_active(self) -> bool:
        return self.query.isActive

    def process(self) -> None:
        """Wait until what is there now has been handed on."""
        self.query.processAllAvailable()

    def await_done(self, timeout: float | None = None) -> bool | None:
        return self.query.awaitTermination(timeout)

    def cancel(self) -> None:
        if self.query.isActive:
            self.query.stop()


@dataclass(frozen=True)
class Watch:
    """A subscription to be: filters are ANDed, handlers get each micro-batch's events as a DataFrame.

    Spark slows the source down instead of dropping events, so none is dropped; a batch whose handler
    fails stops the query, and a query started again with the same checkpoint takes it up there.
    """

    stream: DataFrame
    registry: "WatchRegistry"
    conditions: tuple = ()
    tests: tuple = ()
    handlers: tuple = ()
    single: bool = False
    waits: bool = False
    lag: tuple | None = None

    def filter(self, condition: Expression) -> "Watch":
        return replace(self, conditions=(*self.conditions, condition))

    def filter_rows(self, test: Callable[[dict], bool], *columns: str) -> "Watch":
        """A filter in Python over some columns of an event, for what no expression says. An event whose
        filter fails is left out and counted (WatchHandle.skipped); expressions that may fail have their
        try_ forms instead."""
        if test is None or not columns:
            raise ValueError("a filter needs a function and columns")
        return replace(self, tests=(*self.tests, (test, columns)))

    def _on(self, ops: tuple[str, ...], handler: Callable[[DataFrame], None]) -> "Watch":
        if handler is None:
            raise ValueError("a handler is missing")
        return replace(self, handlers=(*self.handlers, (ops, handler)))

    def on_put(self, handler) -> "Watch":
        return self._on(("PUT",), handler)

    def on_delete(self, handler) -> "Watch":
        return self._on(("DELETE",), handler)

    def on_expire(self, handler) -> "Watch":
        return self._on(("EXPIRE",), handler)

    def on_event(self, handler) -> "Watch":
        """All events, besides the handlers of one kind."""
        return self._on(("PUT", "DELETE", "EXPIRE", "EVICT"), handler)

    def on_evict(self, handler) -> "Watch":
        return self._on(("EVICT",), handler)

    def on_lag(self, threshold_ms: int, now: Expression, source: str, handler) -> "Watch":
        """Events that are at least threshold_ms behind."""
        if threshold_ms < 0 or handler is None:
            raise ValueError("a lag needs a threshold and a handler")
        return replace(self, lag=(threshold_ms, now, source, handler))

    def once(self) -> "Watch":
        """End after the first micro-batch that hands something on, which is cut to one event, whenever
        that comes."""
        return replace(self, single=True)

    def sync(self) -> "Watch":
        """start returns when all there is has been handed on."""
        return replace(self, waits=True)

    def start(self, checkpoint: str, **options) -> WatchHandle:
        if not self.handlers and not self.lag:
            raise ValueError("a watch needs a handler")
        self.registry._check_open()
        events = self.stream
        for c in self.conditions:
            events = events.where(holds(column(events, c)))
        for k, (test, columns) in enumerate(self.tests):
            events = events.withColumn(f"_test{k}", _passes(test, columns)(F.struct(*columns)))
        tested = [f"_test{k}" for k in range(len(self.tests))]
        wanted = tuple({op for ops, _ in self.handlers for op in ops})
        box: list[WatchHandle] = []
        lock, spent = threading.Lock(), [False]
        begun = threading.Event()

        def hand_on(batch: DataFrame, _: int) -> None:
            begun.wait()
            with lock:
                if spent[0]:
                    return
                batch = given = batch.persist()
                try:
                    if tested:
                        passed = [F.col(t) for t in tested]
                        box[0].skipped += batch.where(F.exists(F.array(*passed), lambda p: p.isNull())).count()
                        batch = batch.where(F.forall(F.array(*passed), lambda p: F.coalesce(p, F.lit(False)))).drop(*tested)
                    mine = batch.where(F.col("op").isin(*wanted)) if wanted else batch.limit(0)
                    mine = mine.limit(1) if self.single else mine
                    count = mine.count()
                    box[0].received += count
                    for ops, handler in self.handlers:
                        part = mine.where(F.col("op").isin(*ops))
                        if count and not part.isEmpty():
                            handler(part)
                    if self.lag:
                        threshold, now, source, handler = self.lag
                        late = lagging(batch, now, source, threshold)
                        if not late.isEmpty():
                            handler(late)
                    spent[0] = self.single and count > 0
                finally:
                    given.unpersist()
                if spent[0]:  # from another thread, as the query waits for this one
                    threading.Thread(target=box[0].cancel, daemon=True).start()

        writer = events.writeStream.foreachBatch(hand_on).option("checkpointLocation", checkpoint)
        handle = WatchHandle(writer.trigger(**options).start() if options else writer.start())
        box.append(handle)
        begun.set()
        self.registry._handles.append(handle)
        if self.waits or self.single:
            try:
                handle.process()
            except Exception:
                if not spent[0]:  # else it ended as it should
                    raise
        if spent[0]:
            handle.await_done(60)
        return handle


def _passes(test: Callable[[dict], bool], columns: tuple[str, ...]):
    """test over Arrow batches: true, false, or null where it fails."""

    @F.pandas_udf("boolean")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for values in zip(*(rows[c].tolist() for c in columns), strict=True):
            try:
                out.append(bool(test(dict(zip(columns, values, strict=True)))))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype="object")

    return run


class WatchRegistry:
    """Subscriptions to one event stream."""

    def __init__(self, stream: DataFrame):
        if stream is None:
            raise ValueError("a registry needs a stream")
        self._stream, self._handles, self._open = stream, [], True

    def watch(self) -> Watch:
        self._check_open()
        return Watch(self._stream, self)

    def _check_open(self) -> None:
        if not self._open:
            raise RuntimeError("the registry was shut down")

    def has_subscribers(self) -> bool:
        return any(h.is_active for h in self._handles)

    def shutdown(self) -> None:
        self._open = False
        for h in self._handles:
            h.cancel()


def stream_latest(log: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """A stream's winning row of each key (see merge.winners), for complete or update mode: state holds
    one row a key."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in log.columns if c not in keys]), order).alias("w")).select(*keys, "w.*")


def windowed_counts(events: DataFrame, time: str, late: str, length: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Beyond the block model: counts by time window; events later than `late` are left out."""
    at = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", length, slide) if slide else F.window("_t", length)
    return at.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
