"""Merging replicated writes: the last write wins.

A log row has block columns, op ('PUT' or 'DELETE'), the stamp _hlc_logical and _hlc_counter, the
origin _origin_hi and _origin_lo, and _arrival, its place in the log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockmill.operators.blocks import Consistency, expired


def _null_origin(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("bigint"))


def lww_order() -> Column:
    """What the winner is largest in: stamp, a delete before a put of the same stamp, origin (signed
    halves, null is 0, 0), and of complete ties the one that came first."""
    delete = F.when(F.col("op") == "DELETE", 1).otherwise(0)
    return F.struct("_hlc_logical", "_hlc_counter", delete.alias("delete"), _null_origin("_origin_hi").alias("hi"), _null_origin("_origin_lo").alias("lo"), (-F.col("_arrival")).alias("arrival"))


def winners(log: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Each key's winning row, a delete or a put: one partial aggregate, so a key that a third of the log
    writes to is combined in every task before it is shuffled. order (largest wins) replaces the rule."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), order if order is not None else lww_order()).alias("w")).select("w.*")


def lww_merge(log: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The state that the log leaves in any order of arrival: winning puts."""
    return winners(log, keys, order).where("op = 'PUT'")


def arrival_merge(log: DataFrame, keys: list[str]) -> DataFrame:
    """The state that the log leaves when applied as it arrives, where a delete leaves no trace: a put
    that arrives after a later delete brings its key back.

    A put is gone if a delete of its stamp or a later one arrives after it; of the puts that are left
    the largest stays, by stamp, origin and earlier arrival.
    """
    stamp = F.struct("_hlc_logical", "_hlc_counter")
    after = W.partitionBy(*keys).orderBy(F.col("_arrival").desc()).rowsBetween(W.unboundedPreceding, -1)
    left = log.withColumn("_gone", F.max(F.when(F.col("op") == "DELETE", stamp)).over(after))
    left = left.where((F.col("op") == "PUT") & (F.col("_gone").isNull() | (stamp > F.col("_gone")))).drop("_gone")
    return winners(left, keys)


def bootstrap(snapshot: DataFrame, delta: DataFrame, keys: list[str], now_ms: int, known_blocks: list[str] | None = None) -> DataFrame:
    """A joiner's state: the donor's snapshot, without what expired or belongs to unknown blocks, and
    the events buffered meanwhile, merged by the same rule."""
    rows = snapshot.where(~expired(now_ms)) if "_expiry_ms" in snapshot.columns else snapshot
    log = rows.withColumn("op", F.lit("PUT")).unionByName(delta)
    if known_blocks is not None:
        log = log.where(F.col("block").isin(known_blocks))
    return lww_merge(log, keys)


def sync_result(snapshot: DataFrame, chunk_bytes: int, size: Column, head_bytes: int = 0) -> DataFrame:
    """One row: total_entries of all blocks, known or not, and chunks: how many chunks hold them.

    A chunk starts with head_bytes and takes entries as long as it stays within chunk_bytes; an entry
    that is larger is a chunk of its own. Each partition of snapshot is sent by itself, so it fills its
    own chunks in its own order.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunks, held, n = 0, chunk_bytes, 0
        for batch in batches:
            for entry in batch["size"].tolist():
                if not n or held + entry > chunk_bytes:
                    chunks, held = chunks + 1, head_bytes
                held, n = held + entry, n + 1
        yield pd.DataFrame({"n": [n], "chunks": [chunks]})

    sizes = snapshot.select(F.coalesce(size.cast("bigint"), F.lit(0)).alias("size"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return sizes.mapInPandas(fill, "n bigint, chunks bigint").agg(total("n").alias("total_entries"), total("chunks").alias("chunks"))


def required_acks(consistency: Consistency, alive_peers: int | Column) -> int | Column:
    """Acknowledgements a write waits for; 0 is fire and forget."""
    if isinstance(alive_peers, Column):
        need = {Consistency.EVENTUAL: F.lit(0), Consistency.QUORUM: F.floor((alive_peers + 1) / 2), Consistency.STRONG: alive_peers}[consistency]
        return F.greatest(need.cast("bigint"), F.lit(0).cast("bigint"))
    need = {Consistency.EVENTUAL: 0, Consistency.QUORUM: (alive_peers + 1) // 2, Consistency.STRONG: alive_peers}[consistency]
    return max(need, 0)


def acks_complete(received: Column, dead: Column, required: Column) -> Column:
    """A peer that dies counts toward completion."""
    return received + dead >= required


#: How a member's state ranks at equal incarnation.
STATE_RANK = {"ALIVE": 0, "SUSPECTED": 1, "DEAD": 2}


def membership(reports: DataFrame, node: str = "node") -> DataFrame:
    """Each node's state of the highest incarnation; at a tie DEAD over SUSPECTED over ALIVE.
    reports has node, state, incarnation."""
    rank = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])[F.col("state")]
    return reports.groupBy(node).agg(F.max_by(F.struct(*[c for c in reports.columns if c != node]), F.struct("incarnation", rank)).alias("m")).select(node, "m.*")


def members(merged: DataFrame, *states: str) -> DataFrame:
    """Members in some states, or all."""
    return merged.where(F.col("state").isin(*states)) if states else merged
