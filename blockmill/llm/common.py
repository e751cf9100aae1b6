"""What the operators share: the shared folder, table reading, row hashing."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed by the contract: words are runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a folder of its own; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="blockmill-")
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{root.rstrip('/')}/blockmill"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that Spark hands to Python at a time. Texts are long, so its own default of 10,000 is too many.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS unless it asks for fewer."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, evaluates df once."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    for made in _scopes()[-1:]:
        made.append(out)
    return out


_local = threading.local()


def _scopes() -> list[list[DataFrame]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def temporary():
    """Tables that written() makes inside are deleted at the end, but for those given to the function
    that this yields. For work whose result is itself a written table."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes().append(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _scopes().pop()
        for df in made:
            if not any(df is k for k in kept):
                discard(df)
        for outer in _scopes()[-1:]:
            outer.extend(kept)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that written() gave and that nothing reads any more."""
    _delete(df.sparkSession, df._written)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables of this library in the shared folder; results not yet read are lost."""
    _delete(spark, scratch_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, columns: list[str], more: str) -> StructType:
    """The schema of some columns of df and further ones."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(more).fields)


def around(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work, which keeps, drops or repeats rows, in the columns of docs: it sees doc_id, text, source and
    one column of all others, so that no name of docs can clash with its own."""
    base = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    rest = [c for c in docs.columns if c not in base]
    rows = docs.select(*base, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")] if rest else []))
    return work(rows).select(*[F.col(c) if c in base else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def trimmed(work: Callable) -> Callable:
    """work over Arrow batches that gives its freed memory back at the end: Spark keeps idle workers,
    more than it has cores at times, and each would hold on to the most that it ever used."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


#: Rows of one key from which its rows are joined by broadcast, and keys that may be broadcast (30 bytes
#: each; facts are a few numbers and short texts).
HOT_ROWS, MOST_HOT = 1_000, 200_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, most_hot: int = MOST_HOT) -> DataFrame:
    """rows joined with facts (at most one row a key; inner or left), where no key's rows meet in one task.

    rows must be a written table, as it is counted and read several times, and so should facts be if
    they cost work. Keys of many rows are joined by broadcast, the others by a shuffle, and rows without
    a key by neither. There are at most n / hot_rows keys of the first kind, and hot_rows grows with the
    table, so that these are never more than most_hot.
    """
    least = max(hot_rows, -(-rows.count() // most_hot))
    keyed = rows.where(F.col(key).isNotNull())
    hot = written(keyed.groupBy(key).count().where(F.col("count") >= least).select(key), "hot-keys")
    if hot.isEmpty():
        out = keyed.join(facts, key, how)
    else:
        known = facts.join(F.broadcast(hot), key, "left_semi")
        out = keyed.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(known), key, how)
        out = out.unionByName(keyed.join(F.broadcast(hot), key, "left_anti").join(facts, key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def ascii_lower(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words, 0 for null."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def id_crc(c: Column) -> Column:
    """crc32 of an id written as text, the fixed rule for held-out rows."""
    return F.crc32(c.cast("string").cast("binary"))


def sub_batches(texts: list, most: int = 2_000_000):
    """Yield (first, last) so that each run of texts has about `most` bytes, one text at least."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
