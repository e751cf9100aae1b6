"""Hybrid logical clocks: stamps (logical ms, counter) that never run back."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Milliseconds of drift from which a clock is reported.
DRIFT_ALERT_MS = 60_000
MOST = (1 << 63) - 1


@dataclass(frozen=True, order=True)
class Stamp:
    """Ordered by logical, then counter; neither is negative. 16 bytes, big-endian."""

    logical: int
    counter: int

    def __post_init__(self) -> None:
        if self.logical < 0 or self.counter < 0:
            raise ValueError("a stamp has no negative part")

    def encode(self) -> bytes:
        return struct.pack(">qq", self.logical, self.counter)

    @staticmethod
    def decode(raw: bytes) -> "Stamp":
        return Stamp(*struct.unpack(">qq", raw))


def tick(clock: Stamp, wall: int) -> Stamp:
    """The stamp of a local event."""
    if wall > clock.logical:
        return Stamp(wall, 0)
    if clock.counter == MOST:
        raise RuntimeError("the clock's counter is used up")
    return Stamp(clock.logical, clock.counter + 1)


def merge_remote(clock: Stamp, remote: Stamp, wall: int) -> Stamp:
    """The stamp of hearing a remote one: the latest of three times; the counter goes on from those of
    the two stamps that have it."""
    logical = max(clock.logical, remote.logical, wall)
    after = [s.counter for s in (clock, remote) if s.logical == logical]
    if after and max(after) == MOST:
        raise RuntimeError("the clock's counter is used up")
    return Stamp(logical, max(after) + 1 if after else 0)


def is_after(a: str, b: str) -> Column:
    """Whether stamp struct a is later than b."""
    return F.col(a) > F.col(b)


def stamp_local(rows: DataFrame, wall: str, order: list[str], node: list[str]) -> DataFrame:
    """rows with logical and counter: each node's local events in order.

    The logical time is the largest wall time so far; the counter numbers the events that share it.
    """
    seen = W.partitionBy(*node).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("logical", F.max(wall).over(seen))
    same = W.partitionBy(*node, "logical").orderBy(*order)
    return rows.withColumn("counter", F.row_number().over(same).cast("bigint") - 1)


def stamp_with_remote(rows: DataFrame, wall: str, order: list[str], node: str, remote_logical: str, remote_counter: str) -> DataFrame:
    """rows with logical and counter, where a row with a remote stamp hears it (null: a local event).

    The logical time is the largest wall or remote time so far. In a run of events that share it, an
    event's counter is one more than that before it, or than the remote one of that time if this is
    larger: at place i of the run, i and the largest so far of (what the event starts from - i).
    """
    seen = W.partitionBy(node).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run, so_far = W.partitionBy(node, "logical").orderBy(*order), W.partitionBy(node, "logical").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    rows = rows.withColumn("logical", F.max(F.greatest(F.col(wall), F.col(remote_logical), zero)).over(seen))
    rows = rows.withColumn("_place", F.row_number().over(run).cast("bigint") - 1)
    # a clock starts at (0, 0), which an event at time 0 goes on from
    first = F.when(F.col("_place") == 0, F.when(F.col("logical") == 0, F.lit(1)).otherwise(0))
    base = F.greatest(first, F.when(F.col(remote_logical) == F.col("logical"), F.col(remote_counter) + 1))
    return rows.withColumn("counter", (F.col("_place") + F.max(base - F.col("_place")).over(so_far)).cast("bigint")).drop("_place")


def drift(rows: DataFrame, wall: str, logical: str, remote_logical: str, alert_ms: int = DRIFT_ALERT_MS) -> DataFrame:
    """One row: the most that a clock ran before its wall time (local_drift), that a remote one did
    (remote_drift), and how many events were more than alert_ms off (alerts)."""
    local, remote = F.col(logical) - F.col(wall), F.col(remote_logical) - F.col(wall)
    most = lambda c: F.coalesce(F.greatest(F.max(c), F.lit(0)), F.lit(0)).cast("bigint")
    off = F.greatest(F.coalesce(local, F.lit(0)), F.coalesce(remote, F.lit(0))) > alert_ms
    return rows.agg(most(local).alias("local_drift"), most(remote).alias("remote_drift"), F.count_if(off).alias("alerts"))
