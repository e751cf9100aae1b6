"""The query builder on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from blockmill.functions import aggregators as A
from blockmill.functions.predicates import Predicate
from blockmill.plans.engine import QueryEngine
from blockmill.plans import selection
from blockmill.plans.query import NullOrdering, Order
from blockmill.sources import decoders
from blockmill.sources.registry import DataRegistry

#: Boats of a harbour: name, kind, length in metres, berths; trips with a boat; skippers; names of winds.
BOATS = [("ada", "sloop", 9.5, 4), ("bora", "ketch", 14.25, 6), ("cyan", "sloop", 7.0, 2), ("dune", "dinghy", 3.5, 0), ("eos", "ketch", 11.75, 5), ("fen", "dinghy", 4.0, 1)]
TRIPS = [(71, "bora", 120.5, "done"), (72, "ada", 33.0, "open"), (73, "bora", 4.5, "lost"), (74, "gull", 61.0, "done"), (75, "ada", 18.0, "done")]
SKIPPERS = [("ada", "Mirko"), ("bora", "Tuuli"), ("fen", "Ines")]
WINDS = ("mistral", "sirocco", "ostro", "levanter", "meltemi", "simoom", "zonda")


@pytest.fixture(scope="module")
def sources(spark):
    r = DataRegistry()
    r.register("boats", spark.createDataFrame(BOATS, "id string, kind string, length double, berths int"))
    r.register("trips", spark.createDataFrame(TRIPS, "trip int, boat string, miles double, state string"))
    r.register("skippers", spark.createDataFrame(SKIPPERS, "boat string, name string"))
    r.register("winds", spark.createDataFrame([(w,) for w in WINDS], "wind string"))
    return r


@pytest.fixture(scope="module")
def boats(sources):
    return QueryEngine.over(sources).from_("boats")


def ids(rows):
    return [r["id"] for r in rows]


def test_filters_and_call_order(boats, sources):
    assert ids(boats.where("berths > 1").and_("length < 10").order_by("id").fetch()) == ["ada", "cyan"]
    # (dinghy or longer than 14) and at least one berth
    assert ids(boats.where("kind = 'dinghy'").or_("length > 14").and_("berths >= 1").order_by("id").fetch()) == ["bora", "fen"]
    assert ids(boats.or_("berths = 0").fetch()) == ["dune"]
    winds = QueryEngine.over(sources).from_("winds")
    got = winds.where(F.length("wind") == 6).or_(lambda df: df.wind.contains("o")).order_by("wind", Order.DESC).offset(1).fetch()
    assert [r.wind for r in got] == ["sirocco", "simoom", "ostro"]


def test_not_takes_null_for_false(spark):
    q = QueryEngine.over(spark.createDataFrame([(1,), (2,), (None,)], "x int")).from_("any")
    assert sorted((r.x for r in q.where(Predicate.of("x = 1").not_()).fetch()), key=str) == [2, None]
    assert [r.x for r in q.where(Predicate.of("x = 1").not_().not_()).fetch()] == [1]


def test_steps_leave_the_query_as_it_was(boats):
    base = boats.where("berths > 0")
    assert base.where("length > 11").count() == 2
    assert base.limit(3).count() == 3
    assert base.count() == 5


def test_order_and_page(boats):
    by_length = ["dune", "fen", "cyan", "ada", "eos", "bora"]
    assert ids(boats.order_by("length").offset(2).limit(3).fetch()) == by_length[2:5]
    assert ids(boats.limit(3).offset(2).order_by("length").fetch()) == by_length[2:5]
    assert ids(boats.order_by("length").offset(4).fetch()) == by_length[4:]
    assert ids(boats.order_by("length", Order.DESC).offset(4).fetch()) == by_length[1::-1]
    assert ids(boats.order_by("length").order_by("berths", Order.DESC).limit(2).fetch()) == ["bora", "eos"]
    assert boats.limit(0).fetch() == []
    assert boats.offset(6).fetch() == [] and boats.offset(60).count() == 0
    assert len(boats.offset(2).fetch()) == 4 == boats.offset(2).count()
    assert boats.limit(1).limit(5).count() == 5 and boats.offset(4).limit(5).count() == 2
    for bad in (lambda: boats.limit(-1), lambda: boats.offset(-1), lambda: boats.order_by(None), lambda: boats.where(None)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("order", "nulls", "want"), [(Order.ASC, NullOrdering.NULLS_FIRST, 0), (Order.ASC, NullOrdering.NULLS_LAST, -1), (Order.DESC, NullOrdering.NULLS_FIRST, -1), (Order.DESC, NullOrdering.NULLS_LAST, 0)])
def test_places_of_nulls(spark, order, nulls, want):
    q = QueryEngine.over(spark.createDataFrame([*BOATS, ("raft", None, 2.5, 0)], "id string, kind string, length double, berths int")).from_("x")
    assert ids(q.order_by("kind", order, nulls).fetch())[want] == "raft"
    left = ids(q.order_by("kind", order, nulls).offset(1).fetch())
    assert len(left) == 6 and ("raft" in left) == (want == -1) and (want == 0 or left[-1] == "raft")


def test_pages_of_equal_rows(spark):
    rows = [(i % 3, None if i % 5 == 0 else i % 4) for i in range(400)]
    q = QueryEngine.over(spark.createDataFrame(rows, "a int, b int")).from_("x")
    for n in (0, 1, 137, 399, 400, 401):
        assert len(q.offset(n).fetch()) == max(400 - n, 0)
        got = [r.b for r in q.order_by("b", Order.DESC).offset(n).fetch()]
        assert got == sorted((b for _, b in rows), key=lambda b: (b is None, -(b or 0)))[n:]


def test_the_nth_key_by_rounds(spark):
    rows = [(i * 7919 % 5000, None if i % 9 == 0 else i % 2) for i in range(5000)]
    df = spark.createDataFrame(rows, "a long, b int").repartition(3)
    order = sorted((-1 if b is None else b, a) for a, b in rows)
    key = F.struct("b", "a")
    for n in (1, 2, 555, 2500, 4999, 5000):
        found = df.where(key <= selection.nth_key(df, key, n, small=40)).count()
        assert found == n and order[n - 1] <= order[-1]
    assert selection.nth_key(df, key, 5001, small=40) is None
    same = spark.range(900).selectExpr("1 AS a")
    assert selection.skip_smallest(same, F.struct("a"), 400, small=40).count() == 500
    assert selection.keep_smallest(same, F.struct("a"), 400, small=40).count() == 400


def test_find_and_count(boats):
    assert boats.order_by("length", Order.DESC).offset(1).find_first()["id"] == "eos"
    assert boats.where("length > 99").find_first() is None
    assert boats.where("id = 'fen'").offset(3).limit(0).find_any()["id"] == "fen"
    assert boats.where("berths > 3").offset(1).limit(1).count() == 1
    assert boats.where("berths > 3").offset(1).limit(1).count_matching() == 3
    result = boats.parallel().fetch_result()
    assert len(result.items) == 6 and result.elapsed_ns > 0


def test_summaries(spark, boats):
    s = boats.order_by("length").offset(1).limit(3).summarize("length")
    assert (s["count"], s["sum"], s["min"], s["max"]) == (3, 20.5, 4.0, 9.5)
    e = boats.where("length < 0").summarize("length")
    assert (e["count"], e["sum"]) == (0, 0.0) and all(math.isnan(e[c]) for c in ("min", "max", "avg"))
    q = QueryEngine.over(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")).from_("x")
    n = q.summarize("x")
    assert math.isnan(n["min"]) and math.isnan(n["max"]) and n["count"] == 3
    with pytest.raises(Exception, match="null number"):
        q.summarize_df("x", strict=True).collect()


def test_groups(boats, spark):
    value = lambda a: {r.key: r.value for r in boats.limit(1).group_by("kind").aggregate(a).collect()}
    assert value(A.count()) == {"sloop": 2, "ketch": 2, "dinghy": 2}
    assert value(A.sum("length")) == {"sloop": 16.5, "ketch": 26.0, "dinghy": 7.5}
    assert value(A.avg("length"))["ketch"] == 13.0
    assert (value(A.min("length"))["dinghy"], value(A.max("length"))["dinghy"]) == (3.5, 4.0)
    assert (value(A.min_by("id"))["ketch"], value(A.max_by("id"))["ketch"]) == ("bora", "eos")
    assert value(A.Aggregator.of("array_join(sort_array(collect_list(id)), '+')")) == {"sloop": "ada+cyan", "ketch": "bora+eos", "dinghy": "dune+fen"}
    rows = boats.group_by("kind").aggregate_rows(lambda g: float(g["length"].max()), "double").collect()
    assert {r.key: r.value for r in rows}["sloop"] == 9.5
    q = QueryEngine.over(spark.createDataFrame([(None, 1.0), ("a", float("nan"))], "k string, x double")).from_("x")
    assert {r.key for r in q.group_by("k").aggregate(A.count()).collect()} == {None, "a"}
    assert math.isnan({r.key: r.value for r in q.group_by("k").aggregate(A.min("x")).collect()}["a"])
    with pytest.raises(Exception, match="null group key"):
        q.group_by("k", strict=True).aggregate(A.count()).collect()


def test_joins(sources, spark):
    trips = QueryEngine.over(sources).from_("trips")
    pairs = trips.limit(1).join("skippers").on_keys("boat", "boat").select("l.trip", "r.name AS skipper")
    assert sorted(tuple(r) for r in pairs.fetch()) == [(71, "Tuuli"), (72, "Mirko"), (73, "Tuuli"), (75, "Mirko")]
    assert len(trips.where("miles > 5").join("skippers").where("state <> 'open'").on_keys("boat", "boat").fetch()) == 2
    theta = trips.join("boats").on_condition("l.miles < r.length").select("l.trip", "r.id AS boat")
    assert sorted(tuple(r) for r in theta.fetch()) == [(73, "ada"), (73, "bora"), (73, "cyan"), (73, "eos")]
    assert len(trips.join("skippers").on_condition("true").on_keys("boat", "boat").fetch()) == 4
    nulls = DataRegistry().register("l", spark.createDataFrame([(None,), ("a",), ("a",)], "k string")).register("r", spark.createDataFrame([(None,), ("a",), ("a",)], "k string"))
    assert QueryEngine.over(nulls).from_("l").join("r").on_keys("k", "k").df().count() == 4
    own = DataRegistry().register("l", spark.createDataFrame([(1, "x")], "k int, _key string")).register("r", spark.createDataFrame([(1, "y")], "k int, _key_ string"))
    joined = QueryEngine.over(own).from_("l").join("r").on_keys("k", "k")
    assert tuple(joined.select("l._key AS a", "r._key_ AS b").df().first()) == ("x", "y") and joined.df().columns == ["k", "_key", "k", "_key_"]
    with pytest.raises(RuntimeError):
        trips.join("skippers").df()
    with pytest.raises(ValueError):
        trips.join("nothing")
    with pytest.raises(NotImplementedError):
        QueryEngine.over(spark.range(1)).from_("x").join("y")
    assert trips.join("skippers").on_keys("boat", "boat").kind("left").df().count() == 5


def test_registry_is_live(spark):
    rows = [(1,)]
    r = DataRegistry().register("t", lambda: spark.createDataFrame(rows, "x int"))
    q = QueryEngine.over(r).from_("t")
    assert q.count() == 1
    rows.append((2,))
    assert q.count() == 2
    assert r.contains("t") and not r.contains("u")
    for bad in (lambda: r.register("t", spark.range(1)), lambda: r.register("", spark.range(1)), lambda: r.register("v", None), lambda: r.resolve("u"), lambda: QueryEngine.over(r).from_("t", None)):
        with pytest.raises(ValueError):
            bad()
    assert r.register_or_replace("t", spark.range(5)).resolve("t").count() == 5


def test_decoders(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    with pytest.raises(TypeError):
        decoders.typed(spark.createDataFrame([], "k string").schema)(df)
    assert decoders.typed(df.schema)(df).count() == 2
    with pytest.raises(Exception, match="null row"):
        decoders.typed(df.schema)(spark.createDataFrame([(None, None)], df.schema)).collect()
    assert decoders.non_null(decoders.identity(), "v", skip=True)(df).count() == 1
    with pytest.raises(Exception, match="decoded to null: 2"):
        decoders.non_null(decoders.identity(), "v", key="k")(df).collect()


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; a page is a top-k; counts don't sort."""
    spark.range(100).selectExpr("id", "id % 7 AS k", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    q = QueryEngine.over(DataRegistry().register_parquet(spark, "t", str(tmp_path / "t"))).from_("t")
    plan = lambda df: df._jdf.queryExecution().toString()
    text = plan(q.where("k = 3").df().select("id"))
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,3)]" in text and "ReadSchema: struct<id:bigint,k:bigint>" in text
    assert "TakeOrderedAndProject" in plan(q.order_by("v").offset(3).limit(4).df())
    assert "Sort" not in plan(q.order_by("v").count_df())
    typed = QueryEngine.over(DataRegistry().register_parquet(spark, "t", str(tmp_path / "t"))).from_("t", decoders.typed(spark.range(0).schema))
    assert "EqualTo(id,3)" in plan(typed.where("id = 3").df())
    for paged in (q.offset(30).df(), q.order_by("v").offset(30).df(), q.offset(3).limit(9).count_df()):
        physical = plan(paged).split("== Physical Plan ==")[1]
        assert not any(x in physical for x in ("GlobalLimit", "TakeOrdered")) and ("SinglePartition" not in physical or "count" in physical)
