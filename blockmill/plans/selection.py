"""The n-th smallest key of a table, so that a page or a limit of any size is a filter on it.

Nothing is sorted as a whole and no task gets more than SMALL rows: a small sample gives pivots, one
aggregate counts the rows before each of them, and the search goes on between two pivots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that may be taken through one task, and pivots of a round.
SMALL, PIVOTS = 100_000, 64


def key_literal(kind: StructType, key) -> Column:
    """A collected key as a literal of its type."""
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, key, strict=True)])


def nth_key(df: DataFrame, key: Column, n: int, small: int = SMALL) -> Column | None:
    """The n-th smallest key (from 1) of df as a literal; None if df has fewer rows. key is a struct;
    nulls inside it are smallest. Each round is one pass over df."""
    rows = df.select(key.alias("k"))
    kind, before, some = rows.schema["k"].dataType, 0, rows
    while True:
        total = some.count()
        if n - before > total:
            return None
        if n - before <= small or total <= small:
            return key_literal(kind, some.orderBy("k").offset(n - before - 1).limit(1).first()["k"])
        sample = some.sample(min(1.0, 20 * PIVOTS / total), 3).orderBy("k").limit(100 * PIVOTS).collect()
        pivots = [key_literal(kind, sample[i]["k"]) for i in range(0, len(sample), max(1, len(sample) // PIVOTS))]
        counts = some.agg(*[f(F.col("k"), p) for p in pivots for f in (lambda k, p: F.count_if(k < p), lambda k, p: F.count_if(k <= p))]).first()
        low = high = None
        for p, less, most in zip(pivots, counts[::2], counts[1::2], strict=True):
            if before + less < n <= before + most:
                return p
            if n <= before + less:
                high = p
                break
            low, passed = p, most
        if low is not None:
            before, some = before + passed, some.where(F.col("k") > low)
        if high is not None:
            some = some.where(F.col("k") < high)


def skip_smallest(df: DataFrame, key: Column, n: int, small: int = SMALL) -> DataFrame:
    """df without its n smallest rows by key; which of the rows of one key stay is open."""
    last = nth_key(df, key, n, small)
    if last is None:
        return df.limit(0)
    at_most = df.where(key <= last).count()
    ties = df.where(key == last).limit(at_most - n) if at_most > n else df.limit(0)
    return df.where(key > last).unionByName(ties) if at_most > n else df.where(key > last)


def keep_smallest(df: DataFrame, key: Column, n: int, small: int = SMALL) -> DataFrame:
    """df's n smallest rows by key; which of the rows of one key stay is open."""
    if n <= 0:
        return df.limit(0)
    last = nth_key(df, key, n, small)
    if last is None:
        return df
    below = df.where(key < last)
    return below.unionByName(df.where(key == last).limit(n - below.count()))
