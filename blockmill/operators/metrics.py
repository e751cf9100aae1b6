"""Metrics as aggregates, one row a block or one row in all; 0 where there is nothing to measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_rate(accesses: DataFrame, by: list[str], baseline: DataFrame | None = None) -> DataFrame:
    """hits, misses and hit_rate (percent) since a baseline: each block's hits and misses at some time
    (columns by, hits, misses; a block that it doesn't name starts at 0). accesses: hit boolean."""
    used = accesses.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    if baseline is not None:
        used = used.join(baseline.select(*by, F.col("hits").alias("_hits"), F.col("misses").alias("_misses")), by, "left")
        used = used.select(*by, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("hits", "misses")])
    total = F.col("hits") + F.col("misses")
    return used.withColumn("hit_rate", F.when(total > 0, F.col("hits") * 100.0 / total).otherwise(0.0))


def block_counters(events: DataFrame, by: list[str]) -> DataFrame:
    """puts, deletes, evictions and expirations. events: op."""
    return events.groupBy(*by).agg(*[F.count_if(F.col("op") == op).alias(name) for op, name in (("PUT", "puts"), ("DELETE", "deletes"), ("EVICT", "evictions"), ("EXPIRE", "expirations"))])


def replication_lag(events: DataFrame, now: str, source: str, by: list[str] | None = None) -> DataFrame:
    """events, avg_lag_ms (whole) and max_lag_ms; a negative lag is 0."""
    lag = F.greatest(F.col(now) - F.col(source), F.lit(0).cast("bigint"))
    return events.groupBy(*(by or [])).agg(
        F.count(lag).alias("events"),
        F.coalesce(F.expr("div(sum(greatest({0} - {1}, 0L)), count({0} - {1}))".format(now, source)), F.lit(0)).cast("bigint").alias("avg_lag_ms"),
        F.coalesce(F.max(lag), F.lit(0)).cast("bigint").alias("max_lag_ms"),
    )


def cluster_counts(members: DataFrame) -> DataFrame:
    """One row: alive, suspected, dead."""
    return members.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in ("ALIVE", "SUSPECTED", "DEAD")])


def eviction_totals(counters: DataFrame) -> DataFrame:
    """One row: evicted and expired over all blocks."""
    return counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("evictions", "evicted"), ("expirations", "expired"))])


class MetricsRegistry:
    """Single figures by name, 0 for what isn't there."""

    def __init__(self, hits: DataFrame | None = None, lag: DataFrame | None = None, cluster: DataFrame | None = None):
        self._frames = {"hits": hits, "lag": lag, "cluster": cluster}

    def _value(self, frame: str, column: str, where: str = "true"):
        df = self._frames[frame]
        row = df.where(where).agg(F.sum(column).alias("v")).first() if df is not None else None
        return row["v"] if row and row["v"] is not None else 0

    def cache_hits(self, block: str | None = None) -> int:
        return self._value("hits", "hits", f"block = '{block}'" if block else "true")

    def avg_replication_lag_ms(self) -> int:
        return self._value("lag", "avg_lag_ms")

    def alive_node_count(self) -> int:
        return self._value("cluster", "alive")
