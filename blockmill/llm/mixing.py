"""Mixing sources to target weights.

Keys are hash-random, so sorting by key is a shuffle of the documents that any rerun repeats. Each
source is range-sorted by cutting the key space into equal ranges (the keys are uniform, so no
sampling pass is needed and no range outgrows a task, however hot its source is); word totals of the
ranges give each range its start, a window inside the range gives each document its start, and the
source's budget cuts the order at an exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockmill.llm.common import WORD, around, word_count, written

ROWS_PER_RANGE = 500
#: Rows of the table of sources, about 60 bytes each, up to which it is broadcast.
MOST_BROADCAST = 50_000
#: Fixed by the contract: the weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: source, n_rows, source_size, target (double).

    Weights go to the sources in code point order, null last. The mix has share x all words; no source
    gets over most x its own words, and what that leaves over is shared again by weight: targets are
    min(level x weight, most x size) for the one level that uses up the mix. Only this table, one row
    a source, is ordered as a whole.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    by_name, alone = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = alone.orderBy("ratio", F.col("source").asc_nulls_last())
    s = (
        s.withColumn("total", F.sum("source_size").over(alone) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source"))).over(alone))
    )
    target = F.least(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"), F.col("cap"))
    return s.select("source", "n_rows", "source_size", target.alias("target"))


def key_of(id_col: str, seed: int) -> Column:
    """Of a row without an id its text's hash instead, so that such rows aren't one key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, rows_per_range: int = ROWS_PER_RANGE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with size, source_size, target, taken: the words that the mix takes of each document.

    Size is the number of words of text (null text: 0). taken counts repeats: after whole epochs of a
    source its order is walked again up to the budget, and the document that the budget falls into is
    cut there, so that a source's taken words are the whole words of its target. Null sources are a
    source, null ids sort first, repeated rows are rows of their own, an empty table gives an empty
    table. Columns of docs named like the four new ones are replaced; no other name can clash.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # never null: one partitioning for join and window
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), group.alias("group"), word_count(F.col("text")).alias("size"), F.col("doc_id").alias("id"), key_of("doc_id", seed).alias("key"))
    goals = written(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, most).select(group.alias("group"), "source_size", "target", F.ceil(F.col("n_rows") / F.lit(rows_per_range)).alias("ranges")), "mix-targets")
    if goals.count() <= most_broadcast:
        rows = rows.join(F.broadcast(goals), "group")
    else:  # more sources than a broadcast should hold: a join that deals out each source by key
        salt = F.conv(F.substring("key", 1, 2), 16, 10).cast("int")
        rows = rows.withColumn("salt", salt).join(goals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(255)))), ["group", "salt"])
    # equal cuts of the keys' first 28 bits
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.col("ranges") / F.lit(16**7)))
    totals = rows.groupBy("group", "range").agg(F.sum("size").alias("words"))
    starts = totals.select("group", "range", F.coalesce(F.sum("words").over(W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = W.partitionBy("group", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget, whole = F.floor("target"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(0)
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * whole - F.col("before")))
    return rows.join(starts, ["group", "range"]).withColumn("before", before).select(*[F.col("row").getField(c).alias(c) for c in own], "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, in the columns of docs: each document as often as it is taken whole, and once
    more, cut after its first words (one blank between them), where the budget ends inside it."""

    def mix(rows: DataFrame) -> DataFrame:
        mixed = mix_sources(rows, **how)
        some = F.col("size") > 0
        mixed = mixed.withColumn("whole", F.when(some, F.floor(F.col("taken") / F.col("size"))).otherwise(0)).withColumn("part", F.when(some, F.col("taken") % F.col("size")).otherwise(0))
        copies = (F.col("whole") + (F.col("part") > 0).cast("int")).cast("int")
        mixed = mixed.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
        first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("part").cast("int")), " ")
        return mixed.withColumn("text", F.when(F.col("copy") > F.col("whole"), first).otherwise(F.col("text")))

    return around(docs, mix)
