"""The façade: a node's blocks as tables, queries over their snapshots, watches, bootstrap."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from blockmill.operators import blocks, eviction, merge, metrics
from blockmill.operators.blocks import SYSTEM, BlockSpec, Eviction
from blockmill.operators.clock import Stamp, merge_remote, tick
from blockmill.plans.engine import QueryEngine
from blockmill.plans.query import BlockQuery
from blockmill.sources.decoders import Decoder, non_null
from blockmill.sources.records import uuid_halves
from blockmill.sources.registry import DataRegistry
from blockmill.streaming.changes import WatchRegistry


class BlockCache:
    """Blocks of one node in one Spark session.

    A block is a log of batches in the shared folder: puts, removals and reads, each written once. Its
    state is their fold (blocks.folded); after every `compact_after` batches the fold is written as the
    log's new beginning. Readers keep the batches they started with; vacuum deletes those of the past.
    Writes are batches: point writes are not what Spark is for.
    """

    def __init__(self, spark: SparkSession, folder: str, node: uuid.UUID | None = None, clock_ms: Callable[[], int] | None = None, compact_after: int = 16):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.node = node or uuid.uuid4()
        self._now = clock_ms or (lambda: int(time.time() * 1000))
        self._clock, self._specs, self._running, self._compact_after = Stamp(0, 0), {}, False, compact_after
        self._batches: dict[str, list[str]] = {}
        self._past: dict[str, list[str]] = {}
        self._reports: list[DataFrame] = []
        self._schemas: dict[str, StructType] = {}
        self._watches: dict[str, WatchRegistry] = {}

    # lifecycle
    def start(self) -> "BlockCache":
        if self._running:
            raise RuntimeError("the cache runs already")
        self._running = True
        return self

    def shutdown(self) -> None:
        for w in self._watches.values():
            w.shutdown()
        self._running = False

    close = shutdown

    def __enter__(self) -> "BlockCache":
        return self if self._running else self.start()

    def __exit__(self, *_) -> None:
        self.shutdown()

    @property
    def is_running(self) -> bool:
        return self._running

    def _check(self) -> None:
        if not self._running:
            raise RuntimeError("the cache isn't running")

    # blocks
    def register_block(self, spec: BlockSpec, schema: StructType) -> BlockSpec:
        """schema holds the key and value columns."""
        self._check()
        if spec.name in self._specs:
            raise ValueError(f"block {spec.name!r} is registered already")
        full = StructType([schema[c] for c in (*spec.keys, *spec.values)])
        for n in SYSTEM:
            full = full.add(n, LongType())
        self._specs[spec.name], self._schemas[spec.name] = spec, full
        self._batches[spec.name], self._past[spec.name] = [], []
        self._begin(spec.name, self.spark.createDataFrame([], full))
        return spec

    def block(self, name: str) -> BlockSpec:
        self._check()
        if name not in self._specs:
            raise ValueError(f"no block is called {name!r}")
        return self._specs[name]

    def state(self, name: str) -> DataFrame:
        spec = self.block(name)
        rows = self._read(name, self._batches[name])
        return rows.select(*spec.columns) if len(self._batches[name]) == 1 else blocks.folded(spec, rows)

    def _read(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(StructType([*self._schemas[name].fields, StructField("_op", StringType()), StructField("_seq", LongType())])).parquet(*paths)

    def _append(self, name: str, op: str, rows: DataFrame) -> DataFrame:
        """One batch, written once and read again; columns that rows lacks are null."""
        schema, seq = self._schemas[name], len(self._batches[name])
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
        rows.withColumn("_op", F.lit(op)).withColumn("_seq", F.lit(seq).cast("bigint")).write.parquet(path)
        self._batches[name] = [*self._batches[name], path]
        return self._read(name, [path])

    def _begin(self, name: str, state: DataFrame) -> None:
        """state as the log's new beginning."""
        old, self._batches[name] = self._batches[name], []
        self._append(name, "PUT", state)
        self._past[name] += old

    def compact(self, name: str) -> None:
        self._begin(name, self.state(name))

    def _settle(self, name: str) -> None:
        if len(self._batches[name]) > self._compact_after:
            self.compact(name)

    def vacuum(self, name: str) -> None:
        """Delete batches that the block's present state doesn't read; states read before are lost."""
        self.block(name)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in self._past[name]:
            where = hadoop.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._past[name] = []

    def _log(self, name: str, op: str, rows: DataFrame) -> None:
        """A change-log batch of the block, which watches stream."""
        spec = self._specs[name]
        values = [F.col(c) if c in rows.columns else F.lit(None).cast(self._schemas[name][c].dataType).alias(c) for c in spec.values]
        rows.select(F.lit(op).alias("op"), *spec.keys, *values, F.lit(self._now()).cast("bigint").alias("source_ms"), F.lit("LOCAL").alias("source")).write.mode("append").parquet(f"{self.folder}/{name}-changes")

    def _remove(self, name: str, op: str, keys: DataFrame) -> None:
        """A batch that removes keys, with its events; none if there are no keys."""
        spec = self._specs[name]
        gone = self._append(name, op, keys.select(*spec.keys))
        if gone.isEmpty():
            self._past[name].append(self._batches[name][-1])
            self._batches[name] = self._batches[name][:-1]
        else:
            self._log(name, op, gone.select(*spec.keys))

    def put_all(self, name: str, rows: DataFrame, skip_null: bool = True) -> None:
        """One stamp and one expiry for the batch, of which rows is read once; of several rows of a key
        any one stays. Eviction once after it, with EVICT events."""
        spec, now = self.block(name), self._now()
        self._clock = tick(self._clock, now)
        entries = blocks.stamped(spec, rows, now, self._clock.logical, self._clock.counter, uuid_halves(self.node), skip_null)
        one = entries.groupBy(*spec.keys).agg(F.first(F.struct(*spec.columns)).alias("r")).select("r.*")
        self._log(name, "PUT", self._append(name, "PUT", one))
        if spec.eviction is not Eviction.NONE and spec.max_entries:
            size = F.octet_length(F.to_json(F.struct(*spec.values)))
            self._remove(name, "EVICT", eviction.evicted(self.state(name), spec.eviction, spec.max_entries, list(spec.keys), size))
        self._settle(name)

    def get(self, name: str, keys: DataFrame) -> DataFrame:
        """Live rows of the keys. Reading is use: one batch of hits and access times of the rows found.
        What is returned is the state before it."""
        spec, now = self.block(name), self._now()
        found = blocks.get(spec, self.state(name), keys, now).select(*spec.keys, *spec.values)
        self._append(name, "TOUCH", found.select(*spec.keys).withColumn("_access_ms", F.lit(now).cast("bigint")))
        self._settle(name)
        return found

    def contains(self, name: str, keys: DataFrame) -> DataFrame:
        return blocks.contains(self.block(name), self.state(name), keys, self._now())

    def delete(self, name: str, keys: DataFrame) -> None:
        _, gone = blocks.delete(self.block(name), self.state(name), keys)
        self._clock = tick(self._clock, self._now())
        self._remove(name, "DELETE", gone)
        self._settle(name)

    def sweep(self, name: str) -> None:
        """Take expired rows out and tell their events."""
        self._remove(name, "EXPIRE", blocks.expired_rows(self.state(name), self._now()))
        self._settle(name)

    def clear(self, name: str) -> None:
        self.block(name)
        self._begin(name, self.spark.createDataFrame([], self._schemas[name]))

    # queries
    def query(self) -> QueryEngine:
        """Over snapshots of all blocks as they are now."""
        self._check()
        now, registry = self._now(), DataRegistry()
        for name, spec in self._specs.items():
            registry.register(name, blocks.snapshot(spec, self.state(name), now))
        return QueryEngine.over(registry)

    def query_with(self, name: str, decoder: Decoder, field: str, skip_null: bool = False) -> BlockQuery:
        """Over one decoded snapshot; a null field is an error that names its key, or skipped."""
        spec = self.block(name)
        return QueryEngine.over(blocks.snapshot(spec, self.state(name), self._now())).from_(name, non_null(decoder, field, skip_null, spec.keys[0]))

    # other
    def watch_registry(self, name: str) -> WatchRegistry:
        """The block's change stream; events from before the first watch are in it too."""
        spec = self.block(name)
        if name not in self._watches:
            schema = StructType().add("op", "string")
            for c in (*spec.keys, *spec.values):
                schema = schema.add(self._schemas[name][c])
            folder = f"{self.folder}/{name}-changes"
            self.spark.createDataFrame([], schema.add("source_ms", LongType()).add("source", "string")).write.mode("append").parquet(folder)
            self._watches[name] = WatchRegistry(self.spark.readStream.schema(schema).parquet(folder))
        return self._watches[name]

    def bootstrap(self, donor: "BlockCache | None", *names: str, delta: DataFrame | None = None) -> dict[str, int]:
        """Take over a donor's blocks by the merge rule: entries by block. Without a donor nothing happens."""
        specs = [self.block(n) for n in names]
        found = {}
        for spec in specs if donor else []:
            theirs = blocks.raw_snapshot(spec, donor.state(spec.name), donor._now())
            mine = self.state(spec.name)
            log = mine.withColumn("_arrival", F.lit(0).cast("bigint")).unionByName(theirs.withColumn("_access_ms", F.lit(0).cast("bigint")).withColumn("_hits", F.lit(0).cast("bigint")).withColumn("_arrival", F.lit(1).cast("bigint"))).withColumn("op", F.lit("PUT"))
            log = log.unionByName(delta) if delta is not None else log
            self._begin(spec.name, merge.lww_merge(log, list(spec.keys)).select(*spec.columns))
            found[spec.name] = theirs.count()
            self._clock = merge_remote(self._clock, donor._clock, self._now())
        return found

    def metrics(self) -> DataFrame:
        """block and size of every block, live rows only."""
        self._check()
        now, out = self._now(), None
        for name in self._specs:
            row = blocks.live_view(self.state(name), now).agg(F.lit(name).alias("block"), F.count(F.lit(1)).alias("size"))
            out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], "block string, size bigint")

    @property
    def config(self) -> dict[str, object]:
        """The node, its folder, and the specs of its blocks by name."""
        return {"node": self.node, "folder": self.folder, "compact_after": self._compact_after, "blocks": dict(self._specs)}

    def report(self, reports: DataFrame) -> None:
        """Hear of members: node, state, incarnation."""
        self._check()
        self._reports.append(reports.select(F.col("node").cast("string").alias("node"), "state", F.col("incarnation").cast("bigint").alias("incarnation")))

    def cluster(self) -> DataFrame:
        """Members by what was heard of them, this node among them: node, state, incarnation."""
        self._check()
        out = self.spark.createDataFrame([(str(self.node), "ALIVE", 0)], "node string, state string, incarnation bigint")
        for r in self._reports:
            out = out.unionByName(r)
        return merge.membership(out).select("node", "state", "incarnation")

    def registry(self, **frames: DataFrame) -> metrics.MetricsRegistry:
        return metrics.MetricsRegistry(**frames)


class BlockCaches:
    """Named caches of a process."""

    def __init__(self) -> None:
        self._caches: dict[str, BlockCache] = {}

    def get(self, name: str) -> BlockCache | None:
        return self._caches.get(name)

    def get_or_create(self, name: str, make: Callable[[], BlockCache]) -> BlockCache:
        if name not in self._caches:
            self._caches[name] = make()
        return self._caches[name]

    def shutdown_and_remove(self, name: str) -> bool:
        cache = self._caches.pop(name, None)
        if cache:
            cache.shutdown()
        return cache is not None

    def shutdown_all(self) -> None:
        for name in list(self._caches):
            self.shutdown_and_remove(name)

    def size(self) -> int:
        return len(self._caches)
