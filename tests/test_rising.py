"""Joins on a condition that greater numbers keep true, against all pairs."""

import math
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockmill import catalogue
from blockmill.plans import rising
from blockmill.plans.engine import QueryEngine
from blockmill.sources.registry import DataRegistry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def pair(spark, left, right, kind="double"):
    both = DataRegistry()
    for name, values in (("a", left), ("b", right)):
        both.register(name, spark.createDataFrame(list(enumerate(values)), f"id bigint, x {kind}"))
    return QueryEngine.over(both).from_("a").join("b")


def same(spark, left, right, kind, condition, text):
    j = pair(spark, left, right, kind).select("l.id AS i", "r.id AS j")
    found, every = (sorted(map(tuple, q.fetch())) for q in (j.on_rising("x", "x", condition), j.on_condition(text)))
    assert found == every
    return found


def total(a, b):
    return a + b > 100


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    some = lambda n: [rng.choice([None, rng.gauss(30, 40), rng.gauss(30, 40), float(rng.randrange(3) * 40)]) for _ in range(n)]
    odd = [math.nan, math.inf, -math.inf, 0.0, -0.0, None, 1e300, 50.0, 50.00000000000001]
    assert 1000 < len(same(spark, some(700) + odd, some(300) + odd, "double", total, "l.x + r.x > 100")) < 300_000
    assert same(spark, odd, odd, "double", lambda a, b: -a < b, "-l.x < r.x")
    whole = [rng.randrange(-100, 200) for _ in range(200)] + [None]
    assert same(spark, whole, whole[:90], "bigint", total, "l.x + r.x > 100")
    exact = [None if x is None else Decimal(x) / 100 for x in whole]
    assert same(spark, exact, exact, "decimal(9,2)", lambda a, b: a + b >= Decimal("1.5"), "l.x + r.x >= 1.5")
    for few in ([], [None], [1.0], [math.inf]):
        same(spark, few, [99.0, 99.5, None], "double", total, "l.x + r.x > 100")
        same(spark, [99.0, 99.5, None], few, "double", total, "l.x + r.x > 100")
    assert not same(spark, whole, whole, "bigint", lambda a, b: a + b > 999, "l.x + r.x > 999")


def test_large_buckets_are_split(spark, monkeypatch):
    """Rows of one number, also copies of a row, go to several tiles, and each pair comes once."""
    monkeypatch.setattr(rising, "FEW", 20)
    same(spark, [60.0] * 150 + [1.0], [50.0] * 130 + [99.5, 2.0, None], "double", total, "l.x + r.x > 100")
    rows = spark.createDataFrame([(1, 60.0)] * 150, "id int, x double").repartition(4)
    left, right = rising.tiles(rows, rows, "x", "tile", total)
    assert left.select("tile").distinct().count() > 8
    assert left.join(right, "tile").count() == 150 * 150


def test_pairs_looked_at(spark):
    """Tiles hold few more pairs than match; the query joins by tile and reads no column it doesn't need."""
    left = spark.range(4000).select("id", (F.col("id") * 7919 % 4001 / 40).alias("x"))
    a, b = rising.tiles(left, left, "x", "tile", lambda a, b: a + b > 190)
    looked = a.groupBy("tile").count().join(b.groupBy("tile").agg(F.count("*").alias("m")), "tile").agg(F.sum(F.col("count") * F.col("m"))).first()[0]
    matching = left.alias("l").join(left.alias("r"), F.col("l.x") + F.col("r.x") > 190).count()
    assert matching <= looked <= matching + 4000 * 4000 * 4 / rising.BUCKETS
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    plan = catalogue.QUERIES["join_theta"](spark, DATA)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "c_name" not in plan


def test_interface(spark):
    j = pair(spark, [60.0, 1.0], [50.0, None]).on_rising("x", "x", total)
    assert j.df().columns == ["id", "x", "id", "x"] and j.df().count() == 1
    assert j.where("x < 60").df().count() == 0
    assert [tuple(r) for r in j.select(lambda a, b: a["id"], lambda a, b: b["x"]).fetch()] == [(0, 50.0)]
    assert j.kind("left").df().count() == 2
    assert j.on_condition("true").df().count() == 4 and j.on_condition("true").on_rising("x", "x", total).df().count() == 1
    assert j.on_keys("id", "id").df().count() == 2
    own = QueryEngine.over(DataRegistry().register("a", spark.createDataFrame([(60.0, 1, 2)], "x double, _key int, _tile int"))).from_("a")
    assert [tuple(r) for r in own.join("a").on_rising("x", "x", total).select("l._key", "r._tile").fetch()] == [(1, 2)]
    for bad in ((None, "x", total), ("x", None, total), ("x", "x", None)):
        with pytest.raises(ValueError):
            j.on_rising(*bad)
