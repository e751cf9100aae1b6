"""Block state, clock, merge, changes and metrics against plain Python."""

import dataclasses
import datetime as dt
import enum
import random
import typing
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockmill.operators import blocks, clock, eviction, merge, metrics
from blockmill.operators.blocks import BlockSpec, Consistency, Eviction
from blockmill.operators.clock import Stamp
from blockmill.sources import decoders
from blockmill.sources.cache import BlockCache, BlockCaches
from blockmill.sources.records import RecordTypes, uuid_halves
from blockmill.streaming import changes

LOG = "k string, op string, v long, _hlc_logical long, _hlc_counter long, _origin_hi long, _origin_lo long, _arrival long"


def random_log(seed, n=1500, keys=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        origin = rng.choice([(None, None), (0, 0), (-5, 3), (7, -1), (7, 2)])
        rows.append((f"k{rng.randrange(keys)}", rng.choice(["PUT", "PUT", "PUT", "DELETE"]), i, rng.randrange(40), rng.randrange(3), *origin, i))
    return rows


def test_merge_is_a_fold_in_any_order(spark):
    rows = random_log(1)
    best = {}
    for r in rows:
        rank = (r[3], r[4], r[1] == "DELETE", r[5] or 0, r[6] or 0, -r[7])
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = (rank, r)
    want = {k: r[2] for k, (_, r) in best.items() if r[1] == "PUT"}
    random.Random(2).shuffle(rows)
    got = {r.k: r.v for r in merge.lww_merge(spark.createDataFrame(rows, LOG), ["k"]).collect()}
    assert got == want


def test_arrival_merge_is_a_fold_as_it_arrives(spark):
    rows, state = random_log(3), {}
    for r in rows:
        stamp, rank, old = (r[3], r[4]), (r[3], r[4], r[5] or 0, r[6] or 0), state.get(r[0])
        if r[1] == "DELETE":
            if old and not old[0][:2] > stamp:
                del state[r[0]]
        elif old is None or rank > old[0]:
            state[r[0]] = (rank, r[2])
    got = {r.k: r.v for r in merge.arrival_merge(spark.createDataFrame(rows, LOG), ["k"]).collect()}
    assert got == {k: v for k, (_, v) in state.items()}


def test_delete_ties_and_origins(spark):
    log = spark.createDataFrame([("a", "PUT", 1, 5, 0, 0, 0, 1), ("a", "DELETE", 0, 5, 0, 0, 0, 2), ("b", "PUT", 1, 5, 0, None, None, 1), ("b", "PUT", 2, 5, 0, -9, 0, 2), ("c", "PUT", 1, 5, 0, 1, 1, 1), ("c", "PUT", 2, 5, 0, 1, 1, 2)], LOG)
    assert {r.k: r.v for r in merge.lww_merge(log, ["k"]).collect()} == {"b": 1, "c": 1}


def test_clock(spark):
    rng = random.Random(4)
    rows = [(n, i, rng.randrange(50), rng.choice([None, rng.randrange(60)]), rng.randrange(4)) for n in ("x", "y") for i in range(200)]
    want, local = {}, {}
    for n in ("x", "y"):
        a, b = Stamp(0, 0), Stamp(0, 0)
        for _, i, w, lo, c in (r for r in rows if r[0] == n):
            a = clock.tick(a, w) if lo is None else clock.merge_remote(a, Stamp(lo, c), w)
            b = Stamp(w, 0) if i == 0 else clock.tick(b, w)
            want[n, i], local[n, i] = (a.logical, a.counter), (b.logical, b.counter)
    df = spark.createDataFrame(rows, "node string, i int, wall long, rl long, rc long")
    got = clock.stamp_with_remote(df, "wall", ["i"], "node", "rl", "rc")
    assert {(r.node, r.i): (r.logical, r.counter) for r in got.collect()} == want
    got = clock.stamp_local(df, "wall", ["i"], ["node"])
    assert {(r.node, r.i): (r.logical, r.counter) for r in got.collect()} == local
    assert Stamp.decode(Stamp(3, 9).encode()) == Stamp(3, 9) and Stamp(1, 9) < Stamp(2, 0)
    with pytest.raises(ValueError):
        Stamp(-1, 0)
    with pytest.raises(RuntimeError):
        clock.tick(Stamp(5, clock.MOST), 5)


SPEC = BlockSpec("b", ("k",), ("v",), ttl_ms=10)


def put(spark, state, rows, now, logical):
    entries = blocks.stamped(SPEC, spark.createDataFrame(rows, "k string, v string"), now, logical, 0)
    return blocks.put_all(SPEC, state if state is not None else entries.limit(0), entries)


def test_time_to_live(spark):
    state = put(spark, None, [("a", "1"), ("b", "2"), (None, "3"), ("c", None)], 100, 1)
    assert sorted(r.k for r in state.collect()) == ["a", "b"]
    assert blocks.live_view(state, 110).count() == 2 and blocks.live_view(state, 111).count() == 0
    state = put(spark, state, [("a", "9")], 105, 2)
    assert [tuple(r) for r in blocks.snapshot(SPEC, state, 112).collect()] == [("a", "9")]
    assert [r.k for r in blocks.expired_rows(state, 112).collect()] == ["b"]
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    assert {r.k: r.present for r in blocks.contains(SPEC, state, keys, 112).collect()} == {"a": True, "b": False, "z": False}
    assert blocks.get_raw(SPEC, state, keys).count() == 2
    left, gone = blocks.delete(SPEC, state, keys)
    assert left.count() == 0 and gone.count() == 2
    assert blocks.clear(state).count() == 0
    with pytest.raises(Exception, match="null k"):
        blocks.stamped(SPEC, spark.createDataFrame([(None, "1")], "k string, v string"), 0, 0, 0, skip_null=False).collect()


def test_eviction(spark):
    rows = [("a", 10, 3, "x" * 10), ("b", 30, 1, "x" * 1000), ("c", 20, 2, "x")]
    state = spark.createDataFrame(rows, "k string, _access_ms long, _hits long, v string")
    kept = lambda p, n, **o: {r.k for r in eviction.evict(state, p, n, ["k"], **o).collect()}
    assert kept(Eviction.LRU, 2) == {"b", "c"} and kept(Eviction.LFU, 2) == {"a", "c"}
    assert kept(Eviction.SIZE_BASED, 2, size=F.octet_length("v")) == {"a", "c"}
    assert kept(Eviction.NONE, 2) == {"a", "b", "c"} == kept(Eviction.LRU, 0)
    assert {r.k for r in eviction.evicted(state, Eviction.LRU, 2, ["k"]).collect()} == {"a"}
    used = blocks.touched(BlockSpec("b", ("k",), ("v",)), state, spark.createDataFrame([("a", 99), ("a", 50)], "k string, access_ms long"))
    assert {r.k: (r._access_ms, r._hits) for r in used.collect()}["a"] == (99, 5)


def test_acks_and_members(spark):
    assert [merge.required_acks(c, n) for c in Consistency for n in (0, 1, 2, 3)] == [0, 0, 0, 0, 0, 1, 1, 2, 0, 1, 2, 3]
    reports = spark.createDataFrame([("n", "ALIVE", 2), ("n", "DEAD", 1), ("m", "SUSPECTED", 1), ("m", "ALIVE", 1)], "node string, state string, incarnation int")
    assert {r.node: r.state for r in merge.membership(reports).collect()} == {"n": "ALIVE", "m": "SUSPECTED"}


def test_bootstrap(spark):
    donor = spark.createDataFrame([("a", 1, 5, 0, 0, 0, 0, 0), ("b", 2, 5, 0, 0, 0, 0, 50), ("c", 3, 5, 0, 0, 0, 0, 900)], "k string, v long, _hlc_logical long, _hlc_counter long, _origin_hi long, _origin_lo long, _arrival long, _expiry_ms long")
    delta = spark.createDataFrame([("a", 9, 7, 0, 0, 0, 1, 0, "PUT"), ("c", None, 4, 0, 0, 0, 1, 0, "DELETE"), ("d", 4, 1, 0, 0, 0, 1, 0, "PUT")], donor.schema.simpleString()[7:-1].replace(":", " ") + ", op string")
    assert {r.k: r.v for r in merge.bootstrap(donor, delta, ["k"], 100).collect()} == {"a": 9, "c": 3, "d": 4}


def test_changes_and_lag(spark):
    log = spark.createDataFrame([("a", 1, "PUT", 5), ("a", 2, "PUT", 6), ("a", 3, "DELETE", None), ("a", 4, "PUT", 7)], "k string, i int, op string, v int")
    feed = changes.change_feed(log, ["k"], ["i"], "v").orderBy("i").collect()
    assert [(r.new_value, r.old_value) for r in feed] == [(5, None), (6, 5), (None, 6), (7, None)]
    assert all(r.old_value is None for r in changes.change_feed(log, ["k"], ["i"], "v", old_values=False).collect())
    at = spark.createDataFrame([(1, 100), (2, 99), (3, -1), (4, 300)], "i int, src long")
    assert [(r.i, r.lag_ms) for r in changes.lagging(at, F.lit(200), "src", 100).orderBy("i").collect()] == [(1, 100), (2, 101)]
    state = spark.createDataFrame([("a", "x", 50), ("b", "y", 0)], "k string, v string, _expiry_ms long")
    assert [r.k for r in changes.expiry_events(state, ["k"], "v", 0, 51).collect()] == ["a"]


def test_metrics(spark):
    a = spark.createDataFrame([("x", True), ("x", False), ("x", True), ("x", True)], "block string, hit boolean")
    hits = metrics.hit_rate(a, ["block"])
    assert hits.first().hit_rate == 75.0
    since = metrics.hit_rate(a.union(spark.createDataFrame([("y", False), ("y", True)], a.schema)), ["block"], hits.select("block", F.lit(2).alias("hits"), F.lit(1).alias("misses")))
    assert {r.block: (r.hits, r.misses, r.hit_rate) for r in since.collect()} == {"x": (1, 0, 100.0), "y": (1, 1, 50.0)}
    lag = metrics.replication_lag(spark.createDataFrame([(10, 3), (5, 9), (8, 0)], "now long, src long"), "now", "src")
    assert tuple(lag.first()) == (3, 5, 8)
    none = metrics.replication_lag(spark.createDataFrame([], "now long, src long"), "now", "src").first()
    assert tuple(none) == (0, 0, 0)
    r = metrics.MetricsRegistry(hits=hits, lag=lag)
    assert (r.cache_hits(), r.cache_hits("x"), r.cache_hits("y"), r.avg_replication_lag_ms(), r.alive_node_count()) == (3, 3, 0, 5, 0)


class Colour(enum.Enum):
    RED = 1


@dataclasses.dataclass
class Inner:
    city: str


@dataclasses.dataclass
class Record:
    id: uuid.UUID
    n: typing.Annotated[int, T.IntegerType()]
    tags: list[str]
    note: str | None
    colour: Colour
    inner: Inner
    scores: dict[str, float]
    day: dt.date


def test_record_types():
    s = RecordTypes().schema(Record)
    assert s.fieldNames() == ["id", "n", "tags", "note", "colour", "inner", "scores", "day"]
    assert s["note"].nullable and not s["n"].nullable and s["n"].dataType == T.IntegerType()
    assert s["inner"].dataType.fieldNames() == ["city"]
    for bad in (typing.Union[int, str], object, list):
        with pytest.raises(ValueError):
            RecordTypes().data_type(bad)
    assert uuid_halves(uuid.UUID(int=(1 << 127) + 1)) == (-(1 << 63), 1)


def test_cache(spark, tmp_path):
    now = [1000]
    caches = BlockCaches()
    make = lambda name: BlockCache(spark, f"file://{tmp_path}/{name}", clock_ms=lambda: now[0])
    schema = T.StructType().add("k", "string").add("v", "string")
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    with caches.get_or_create("one", lambda: make("one")) as c:
        spec = c.register_block(BlockSpec("b", ("k",), ("v",), ttl_ms=100, eviction=Eviction.LRU, max_entries=2), schema)
        with pytest.raises(ValueError):
            c.register_block(spec, schema)
        with pytest.raises(ValueError):
            c.block("none")
        with pytest.raises(RuntimeError):
            c.start()
        c.put_all("b", frame(("a", "1"), ("b", "2")))
        now[0] = 1001
        c.put_all("b", frame(("c", "3")))
        assert sorted(r.k for r in c.state("b").collect()) == ["a", "c"]
        engine = c.query()
        c.delete("b", frame(("a", None)))
        assert engine.from_("b").count() == 2  # a snapshot
        assert c.query().from_("b").count() == 1
        assert c.query_with("b", decoders.select(k="k", n="cast(v AS int)"), "n").fetch()[0].n == 3
        with make("two") as other:
            other.register_block(spec, schema)
            assert other.bootstrap(None, "b") == {}
            assert other.bootstrap(c, "b") == {"b": 1}
            assert other.get("b", frame(("c", None))).first().v == "3"
        seen = []
        handle = c.watch_registry("b").watch().filter("k <> 'b'").on_put(lambda df: seen.extend(r.k for r in df.collect())).on_event(lambda df: seen.append(df.count())).sync().start(f"{tmp_path}/cp1")
        assert sorted(x for x in seen if isinstance(x, str)) == ["a", "c"] and handle.is_active
        now[0] = 1500
        c.sweep("b")
        handle.process()
        assert c.state("b").count() == 0 and handle.received == 4
        first = []
        once = c.watch_registry("b").watch().on_expire(lambda df: first.extend(r.k for r in df.collect())).once().start(f"{tmp_path}/cp2")
        assert first == ["c"] and not once.is_active
        assert c.watch_registry("b").has_subscribers()
        assert c.metrics().first()["size"] == 0
        c.clear("b")
    assert not handle.is_active
    handle.cancel()
    with pytest.raises(RuntimeError):
        c.query()
    with pytest.raises(RuntimeError):
        c._watches["b"].watch()
    assert caches.size() == 1 and caches.shutdown_and_remove("one") and caches.size() == 0 and caches.get("one") is None


def test_reads_are_use_and_evictions_are_events(spark, tmp_path):
    now = [1]
    schema = T.StructType().add("k", "string").add("v", "string")
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    with BlockCache(spark, f"file://{tmp_path}/c", clock_ms=lambda: now[0], compact_after=4) as c:
        for policy in (Eviction.LFU, Eviction.LRU):
            name = policy.value
            c.register_block(BlockSpec(name, ("k",), ("v",), eviction=policy, max_entries=2), schema)
            gone = []
            handle = c.watch_registry(name).watch().on_evict(lambda df, gone=gone: gone.extend(r.k for r in df.collect())).start(f"{tmp_path}/cp-{name}")
            c.put_all(name, frame(("y", "1"), ("z", "2")))
            for _ in range(3):
                now[0] += 1
                assert c.get(name, frame(("z", None), ("none", None))).first().v == "2"
            now[0] += 1
            before = c.state(name)
            c.put_all(name, frame(("m", "3")))
            state = {r.k: (r._hits, r._access_ms) for r in c.state(name).collect()}
            assert state["z"] == (3, now[0] - 1) and before.count() == 2
            kept = {"z", "y"} if policy is Eviction.LFU and "y" in state else {"z", "m"}
            assert set(state) == kept and len(state) == 2
            handle.process()
            assert gone == sorted({"y", "m"} - kept)
            handle.cancel()
            assert len(c._batches[name]) <= 5
            c.compact(name)
            c.vacuum(name)
            assert {r.k: (r._hits, r._access_ms) for r in c.state(name).collect()} == state and c._past[name] == []
        assert set(c.config["blocks"]) == {"lfu", "lru"} and c.config["node"] == c.node
        c.report(spark.createDataFrame([("p", "ALIVE", 1), ("p", "DEAD", 1), (str(c.node), "SUSPECTED", 0)], "node string, state string, incarnation int"))
        assert {r.node: r.state for r in c.cluster().collect()} == {"p": "DEAD", str(c.node): "SUSPECTED"}


def test_folded_batches(spark):
    spec, rng = BlockSpec("b", ("k",), ("v",)), random.Random(8)
    rows, state = [], {}
    for seq in range(25):
        op = rng.choice(["PUT", "PUT", "TOUCH", "DELETE", "EVICT"])
        for k in rng.sample(range(6), 3):
            rows.append((k, f"{seq}", 0, 0, 0, 100 + seq if op == "TOUCH" else seq, 0, 0, 0, op, seq))
            if op == "PUT":
                state[k] = [f"{seq}", 0, seq]
            elif op == "TOUCH":
                if k in state:
                    state[k][1:] = [state[k][1] + 1, max(100 + seq, state[k][2])]
            else:
                state.pop(k, None)
    df = spark.createDataFrame(rows, "k int, v string, " + ", ".join(f"{c} long" for c in blocks.SYSTEM) + ", _op string, _seq long")
    assert {r.k: [r.v, r._hits, r._access_ms] for r in blocks.folded(spec, df).collect()} == state


def test_watch_ends_after_its_one_event_and_counts_failing_filters(spark, tmp_path):
    schema = "op string, k string, n int"
    write = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    write()
    registry = changes.WatchRegistry(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"))
    seen, tested = [], []
    once = registry.watch().on_put(lambda df: seen.extend(r.k for r in df.collect())).once().start(f"{tmp_path}/cp1")
    assert once.is_active and not seen
    some = registry.watch().filter("n is not null").filter_rows(lambda e: 10 // e["n"] > 2, "n", "k").on_event(lambda df: tested.extend(r.k for r in df.collect())).start(f"{tmp_path}/cp2")
    write(("PUT", "a", 1), ("DELETE", "b", 0), ("PUT", "c", 5), ("PUT", "d", 0), ("PUT", "e", None))
    assert once.await_done(60) and not once.is_active and len(seen) == 1 == once.received
    some.process()
    assert tested == ["a"] and (some.received, some.skipped) == (1, 2) and some.is_active
    some.cancel()
    with pytest.raises(ValueError):
        registry.watch().filter_rows(None, "n")


def test_sync_chunks(spark):
    sizes = [4, 3, 3, 9, 20, 1, 0, 8, 2]
    def greedy(sizes, most, head):
        chunks = []
        for n in sizes:
            if chunks and head + sum(chunks[-1]) + n <= most:
                chunks[-1].append(n)
            else:
                chunks.append([n])
        return len(chunks)
    df = spark.createDataFrame([(n,) for n in sizes], "n int").coalesce(1)
    for head in (0, 2):
        assert tuple(merge.sync_result(df, 10, F.col("n"), head).first()) == (9, greedy(sizes, 10, head))
    assert tuple(merge.sync_result(df.limit(0), 10, F.col("n")).first()) == (0, 0)


def test_stream_equals_batch(spark, tmp_path):
    rows = random_log(5, 300, 20)
    df = spark.createDataFrame(rows, LOG)
    for i in range(3):
        df.where(F.col("_arrival") % 3 == i).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "log"))
    q = changes.stream_latest(stream, ["k"], merge.lww_order()).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    try:
        q.processAllAvailable()
        got = {r.k: r.v for r in spark.table("latest").where("op = 'PUT'").collect()}
    finally:
        q.stop()
    assert got == {r.k: r.v for r in merge.lww_merge(df, ["k"]).collect()}
