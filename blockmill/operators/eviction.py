"""Exact eviction: which rows a block of at most n entries keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.operators.blocks import Eviction
from blockmill.plans.selection import nth_key

#: What a policy keeps first, smallest first; rows at the other end are its victims.
_KEEPS = {
    Eviction.LRU: lambda size: -F.col("_access_ms"),
    Eviction.LFU: lambda size: -F.col("_hits"),
    Eviction.SIZE_BASED: lambda size: size,
}


def _last_kept(state: DataFrame, policy: Eviction, max_entries: int, tie: list[str], size: Column | None) -> tuple[Column, Column | None]:
    """A row's key, and the key of the last row that stays; None if all do."""
    if policy is Eviction.SIZE_BASED and size is None:
        raise ValueError("size-based eviction needs the size of a row")
    key = F.struct(_KEEPS[policy](size).alias("rank"), *tie)
    return key, nth_key(state, key, max_entries)


def evict(state: DataFrame, policy: Eviction, max_entries: int, tie: list[str], size: Column | None = None) -> DataFrame:
    """state cut to max_entries rows: the most recently used, most often used, or smallest ones; ties go
    to the smaller tie columns, which tell rows apart. No policy or no limit keeps all.

    The last row that stays is searched for at once (see selection.nth_key); the result is a filter.
    """
    if policy is Eviction.NONE or max_entries <= 0:
        return state
    key, last = _last_kept(state, policy, max_entries, tie, size)
    return state if last is None else state.where(key <= last)


def evicted(state: DataFrame, policy: Eviction, max_entries: int, tie: list[str], size: Column | None = None) -> DataFrame:
    """The rows that evict leaves out."""
    if policy is Eviction.NONE or max_entries <= 0:
        return state.limit(0)
    key, last = _last_kept(state, policy, max_entries, tie, size)
    return state.limit(0) if last is None else state.where(key > last)
