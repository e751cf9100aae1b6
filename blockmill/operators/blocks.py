"""Block state: one row a key with system columns, and what reads and writes do to it.

System columns: _hlc_logical, _hlc_counter (write stamp), _expiry_ms (0: never), _access_ms, _hits
(local use, for eviction), _origin_hi, _origin_lo (the writing node as two signed longs). State is a
DataFrame; an operation gives the next state, so a batch of operations is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = {"_hlc_logical": "bigint", "_hlc_counter": "bigint", "_expiry_ms": "bigint", "_access_ms": "bigint", "_hits": "bigint", "_origin_hi": "bigint", "_origin_lo": "bigint"}


class Eviction(Enum):
    NONE = "none"
    LRU = "lru"
    LFU = "lfu"
    SIZE_BASED = "size"


class Consistency(Enum):
    EVENTUAL = "eventual"
    QUORUM = "quorum"
    STRONG = "strong"


@dataclass(frozen=True)
class BlockSpec:
    """A named block: its key and value columns, time to live (0: none), eviction, consistency."""

    name: str
    keys: tuple[str, ...]
    values: tuple[str, ...]
    ttl_ms: int = 0
    eviction: Eviction = Eviction.NONE
    max_entries: int = 0
    consistency: Consistency = Consistency.QUORUM
    warnings: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if not self.name or not self.keys or not self.values:
            raise ValueError("a block needs a name, key columns and value columns")
        if self.ttl_ms < 0 or self.max_entries < 0:
            raise ValueError("a block's limits can't be negative")
        if self.eviction is not Eviction.NONE and not self.max_entries:
            object.__setattr__(self, "warnings", (*self.warnings, "an eviction policy without max_entries does nothing"))

    @property
    def columns(self) -> list[str]:
        return [*self.keys, *self.values, *SYSTEM]


def expired(now_ms: Column | int, expiry: Column | str = "_expiry_ms") -> Column:
    """Past its time: strictly after it, and never where it is 0."""
    c = F.col(expiry) if isinstance(expiry, str) else expiry
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return (c > 0) & (now > c)


def live_view(state: DataFrame, now_ms: Column | int) -> DataFrame:
    return state.where(~expired(now_ms))


def expired_rows(state: DataFrame, now_ms: Column | int) -> DataFrame:
    """What a sweep at now_ms removes, and whose expiry events it tells."""
    return state.where(expired(now_ms))


def snapshot(spec: BlockSpec, state: DataFrame, now_ms: Column | int) -> DataFrame:
    """Live keys and values."""
    return live_view(state, now_ms).select(*spec.keys, *spec.values)


def raw_snapshot(spec: BlockSpec, state: DataFrame, now_ms: Column | int) -> DataFrame:
    """Live rows with system columns."""
    return live_view(state, now_ms).select(*spec.columns)


def stamped(spec: BlockSpec, rows: DataFrame, now_ms: int, logical: Column | int, counter: Column | int, origin: tuple[int, int] = (0, 0), skip_null: bool = True) -> DataFrame:
    """rows as new entries: one shared expiry, no hits, accessed now. Rows with a null key or value are
    skipped, or an error without skip_null."""
    present = [F.col(c).isNotNull() for c in (*spec.keys, *spec.values)]
    if skip_null:
        for p in present:
            rows = rows.where(p)
    else:
        rows = rows.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"null {c}"))) for c in (*spec.keys, *spec.values)})
    expiry = now_ms + spec.ttl_ms if spec.ttl_ms else 0
    system = dict(zip(SYSTEM, (logical, counter, expiry, now_ms, 0, *origin), strict=True))
    return rows.select(*spec.keys, *spec.values, *[(v if isinstance(v, Column) else F.lit(v)).cast("bigint").alias(n) for n, v in system.items()])


def put_all(spec: BlockSpec, state: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (see stamped) over state, whatever the stamps; of several entries of a key the last by
    stamp stays. Eviction is a step of its own."""
    new = entries.groupBy(*spec.keys).agg(F.max_by(F.struct(*spec.columns), F.struct("_hlc_logical", "_hlc_counter")).alias("r")).select("r.*")
    return state.select(*spec.columns).join(new.select(*spec.keys), list(spec.keys), "left_anti").select(*spec.columns).unionByName(new)


def get(spec: BlockSpec, state: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """Live rows of the asked keys."""
    return live_view(state, now_ms).join(keys.select(*spec.keys).distinct(), list(spec.keys), "left_semi")


def get_raw(spec: BlockSpec, state: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the asked keys, expired ones too."""
    return state.join(keys.select(*spec.keys).distinct(), list(spec.keys), "left_semi")


def contains(spec: BlockSpec, state: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """keys with present. It is no access."""
    live = live_view(state, now_ms).select(*spec.keys).withColumn("_there", F.lit(True))
    return keys.select(*spec.keys).distinct().join(live, list(spec.keys), "left").select(*spec.keys, F.coalesce("_there", F.lit(False)).alias("present"))


def delete(spec: BlockSpec, state: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next state, and the keys that were there, which alone give events."""
    asked = keys.select(*spec.keys).distinct()
    return state.join(asked, list(spec.keys), "left_anti"), state.select(*spec.keys).join(asked, list(spec.keys), "left_semi")


def clear(state: DataFrame) -> DataFrame:
    """No rows, and no events."""
    return state.limit(0)


def folded(spec: BlockSpec, batches: DataFrame) -> DataFrame:
    """The state after batches of operations: rows in spec's columns with _op ('PUT', 'TOUCH', or what
    removes a row: 'DELETE', 'EXPIRE', 'EVICT') and _seq, the batch's number. The last batch that puts or
    removes a key settles its row; later touches of it (whose _access_ms tells when) count as use.
    A key is one row in a batch. All is partial aggregates, so no key's rows meet unmerged.
    """
    keys = list(spec.keys)
    use = F.col("_op") == "TOUCH"
    last = batches.where(~use).groupBy(*keys).agg(F.max_by(F.struct("_op", "_seq", *spec.columns), "_seq").alias("r"))
    state = last.where("r._op = 'PUT'").select("r.*")
    used = batches.where(use).select(*keys, "_seq", F.col("_access_ms").alias("access_ms"))
    since = used.join(state.select(*keys, F.col("_seq").alias("_put")), keys).where("_seq > _put").select(*keys, "access_ms")
    return touched(spec, state.select(*spec.columns), since)


def touched(spec: BlockSpec, state: DataFrame, accesses: DataFrame) -> DataFrame:
    """state after reads: accesses (keys, access_ms) count as hits, the latest sets _access_ms."""
    used = accesses.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n"), F.max("access_ms").alias("_at"))
    rows = state.join(used, list(spec.keys), "left")
    return rows.withColumn("_hits", F.col("_hits") + F.coalesce("_n", F.lit(0))).withColumn("_access_ms", F.coalesce(F.greatest("_at", "_access_ms"), F.col("_access_ms"))).select(*state.columns)


def put_raw(spec: BlockSpec, state: DataFrame, entries: DataFrame) -> DataFrame:
    """Replicated entries over state; they bring no use of their own: access time and hits of a key
    that was there stay."""
    mine = state.select(*spec.keys, F.col("_access_ms").alias("_a"), F.col("_hits").alias("_h"))
    kept = entries.join(mine, list(spec.keys), "left").withColumn("_access_ms", F.coalesce("_a", F.lit(0))).withColumn("_hits", F.coalesce("_h", F.lit(0)))
    return put_all(spec, state, kept.select(*spec.columns))


def cache_stats(accesses: DataFrame, state: DataFrame, now_ms: int, evictions: int = 0) -> DataFrame:
    """One row: hits, misses, hit_rate (percent, 0 without accesses), evictions, expirations, size.
    accesses has hit boolean."""
    size = state.agg(F.count_if(~expired(now_ms)).alias("size"), F.count_if(expired(now_ms)).alias("expirations"))
    used = accesses.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") * 100.0 / (F.col("hits") + F.col("misses"))).otherwise(0.0)
    return used.crossJoin(size).select("hits", "misses", rate.alias("hit_rate"), F.lit(evictions).cast("bigint").alias("evictions"), "expirations", "size")  # one row each
