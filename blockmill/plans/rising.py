"""Pairs of rows under a condition that greater values keep true, without a look at every pair.

Both sides are cut by value into buckets of like size. The condition on the greatest values of two
buckets tells whether any pair of their rows can match. Only such pairs of buckets, the tiles, are
joined, each by its number, and the condition is checked on each of a tile's pairs. So the pairs looked
at are those that match and a few in BUCKETS of all, dealt out over as many tasks as they need.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a side; rows that a bucket may always have, and rows that a tile has of a side at most, by
#: which larger buckets are split; pairs of a task, unless a tile has more.
BUCKETS, FEW, MOST, PAIRS = 256, 1_000, 200_000, 20_000_000


def tiles(left: DataFrame, right: DataFrame, value: str, tile: str, condition: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Both sides, each row once for each of its tiles, whose number is the column tile. A pair on whose
    numbers `value` the condition is true has just one tile in common. Buckets are counted at once."""
    (left, ls), (right, rs) = _cut(left, value, tile), _cut(right, value, tile)
    tops = [_array([top for _, top, _ in s], df.schema[value].dataType.simpleString()) for s, df in ((ls, left), (rs, right))]
    spark = left.sparkSession
    pairs = spark.range(0, len(ls), 1, 1).select(F.col("id").alias("i")).crossJoin(spark.range(0, len(rs), 1, 1).select(F.col("id").alias("j")))
    found = pairs.where(condition(F.get(tops[0], F.col("i")), F.get(tops[1], F.col("j")))).groupBy("i").agg(F.min("j").alias("j")).collect()
    down = {r.i: r.j for r in found}  # the first right bucket of each left one, and the other way round
    up = {j: i for i in sorted(down, reverse=True) for j in range(down[i], len(rs))}
    (lp, lat), (rp, rat) = ((p, [0, *accumulate(p)]) for p in (_pieces(ls), _pieces(rs)))
    rows = sum(ls[i][2] * sum(n for *_, n in rs[j:]) for i, j in down.items())
    parts = max(1, min(sum(lp[i] * (rat[-1] - rat[j]) for i, j in down.items()), math.ceil(rows / PAIRS)))
    left = _dealt(left, tile, ls, lp, lat, {i: rat[j] for i, j in down.items()}, rat[-1], lambda own, other: own * rat[-1] + other)
    right = _dealt(right, tile, rs, rp, rat, {j: lat[i] for j, i in up.items()}, lat[-1], lambda own, other: other * rat[-1] + own)
    return left.repartition(parts, tile), right.repartition(parts, tile)


def _cut(df: DataFrame, value: str, bucket: str) -> tuple[DataFrame, list[tuple]]:
    """df's rows that have a value with their bucket, and each bucket with its greatest value and its
    rows, in order. Where the cuts lie steers work only: what a bucket holds is counted."""
    df = df.where(F.col(value).isNotNull())
    cuts = {c for c in df.approxQuantile(value, [i / BUCKETS for i in range(1, BUCKETS)], 0.25 / BUCKETS) if math.isfinite(c)}
    df = Bucketizer(splits=[-math.inf, *sorted(cuts or {0.0}), math.inf], inputCol=value, outputCol=bucket, handleInvalid="keep").transform(df)
    df = df.withColumn(bucket, F.col(bucket).cast("int"))
    return df, sorted(map(tuple, df.groupBy(bucket).agg(F.max(value), F.count(F.lit(1))).collect()), key=lambda r: r[0])


def _array(values: list, kind: str) -> Column:
    """An array literal, as text since each column object is a call into the JVM."""
    return F.expr(f"cast(array({', '.join('null' if v is None else f"'{v}'" for v in values)}) as array<{kind}>)")


def _pieces(buckets: list[tuple]) -> list[int]:
    """Into how many pieces each bucket is split."""
    most = min(max(FEW, 2 * sum(n for *_, n in buckets) // BUCKETS), MOST)
    return [math.ceil(n / most) for *_, n in buckets]


def _dealt(df: DataFrame, tile: str, buckets: list[tuple], pieces: list[int], first: list[int], starts: dict[int, int], end: int, number: Callable[[Column, Column], Column]) -> DataFrame:
    """df's rows by tile: their own piece with all of the other side's pieces from the start on."""
    places = {bucket: i for i, (bucket, *_) in enumerate(buckets)}
    ids = range(max(places, default=-1) + 1)
    of = lambda per_bucket: F.get(_array([per_bucket(places[b]) if b in places else None for b in ids], "bigint"), F.col(tile))
    piece = of(lambda i: first[i])
    if max(pieces, default=1) > 1:  # the same whenever a task is repeated; copies of a row differ by partition
        plain = [F.col(f"`{f.name}`") for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        piece += F.pmod(F.xxhash64(*plain, F.spark_partition_id()), of(lambda i: pieces[i]))
    own, other, names = f"{tile}_own", f"{tile}_other", df.drop(tile).columns
    df = df.withColumns({own: piece, other: of(lambda i: starts.get(i))}).where(F.col(other).isNotNull())
    df = df.withColumn(other, F.explode(F.sequence(other, F.lit(end - 1).cast("bigint"))))
    return df.select(*[F.col(f"`{c}`") for c in names], number(F.col(own), F.col(other)).alias(tile))
