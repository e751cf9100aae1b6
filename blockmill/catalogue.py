"""The block model's operators as registered queries over the test tables, with the SQL they equal."""

from __future__ import annotations

import typing
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from blockmill.functions import aggregators as A
from blockmill.functions.predicates import Predicate
from blockmill.operators import blocks, clock, eviction, merge, metrics
from blockmill.operators.blocks import BlockSpec, Consistency, Eviction
from blockmill.plans.engine import QueryEngine
from blockmill.plans.query import BlockQuery, NullOrdering, Order
from blockmill.sources import decoders
from blockmill.sources.cache import BlockCache, BlockCaches
from blockmill.sources.records import RecordTypes
from blockmill.sources.registry import DataRegistry
from blockmill.sources.scratch import shared_path
from blockmill.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def registry(spark: SparkSession, sf_dir: str) -> DataRegistry:
    out = DataRegistry()
    for name in TABLES:
        out.register_parquet(spark, name, f"{sf_dir}/{name}.parquet")
    return out


def query(sql: str):
    """Register a function of an engine as a query, with its SQL."""

    def add(build: Callable[[QueryEngine], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(QueryEngine.over(registry(spark, sf_dir)))
        SQL[name] = sql
        return build

    return add


def session_query(sql: str):
    """Register a function of session and folder as a query, with its SQL."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__], SQL[build.__name__] = build, sql
        return build

    return add


def _select(q: BlockQuery, *columns: str) -> DataFrame:
    return q.df().select(*columns)


# filters
@query("SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def filter_where(e):
    return _select(e.from_("part").where("p_size < 10"), "p_partkey", "p_size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount = 0.05 AND l_returnflag = 'R'")
def filter_and(e):
    return _select(e.from_("lineitem").where("l_quantity > 40").and_("l_discount = 0.05").and_(F.col("l_returnflag") == "R"), "l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size = 1 OR p_brand = 'Brand#11' OR p_retailprice > 1500")
def filter_or(e):
    return _select(e.from_("part").where("p_size = 1").or_("p_brand = 'Brand#11'").or_("p_retailprice > 1500"), "p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size = 7")
def filter_or_only(e):
    return _select(e.from_("part").or_("p_size = 7"), "p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND p_retailprice < 1200")
def filter_left_assoc(e):
    return _select(e.from_("part").where("p_size < 5").or_("p_size > 45").and_("p_retailprice < 1200"), "p_partkey")


@query("SELECT n_nationkey FROM nation WHERE NOT coalesce(nullif(n_regionkey, 2) = 1, false)")
def filter_not(e):
    return _select(e.from_("nation").where(Predicate.of("nullif(n_regionkey, 2) = 1").not_()), "n_nationkey")


@query("SELECT p_partkey FROM part WHERE (p_size > 20 AND p_brand LIKE 'Brand#1%') OR NOT (p_retailprice > 1000)")
def predicate_tree(e):
    tree = Predicate.of("p_size > 20").and_(F.col("p_brand").startswith("Brand#1")).or_(Predicate.of("p_retailprice > 1000").not_())
    return _select(e.from_("part").where(tree), "p_partkey")


@query("SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal * 2 AS doubled FROM customer")
def decode_projection(e):
    return e.from_("customer", decoders.select(id="c_custkey", name="upper(c_name)", doubled="c_acctbal * 2")).df()


@dataclass
class CustomerRecord:
    c_custkey: int
    c_name: str
    c_nationkey: typing.Annotated[int, IntegerType()]
    c_acctbal: float
    c_mktsegment: str | None


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def decode_typed(e):
    """Rows checked against the schema of a record type; the filter reaches the scan."""
    return e.from_("customer", decoders.typed(RecordTypes().schema(CustomerRecord))).where("c_acctbal > 0").df()


@query("SELECT * FROM (VALUES ('c_custkey', 'bigint', false), ('c_name', 'string', false), ('c_nationkey', 'int', false), ('c_acctbal', 'double', false), ('c_mktsegment', 'string', true)) AS t(field, type, optional)")
def record_schema(e):
    fields = [(f.name, f.dataType.simpleString(), f.nullable) for f in RecordTypes().schema(CustomerRecord)]
    return e.from_("region").df().sparkSession.createDataFrame(fields, "field string, type string, optional boolean")


# sources
@session_query("SELECT s_suppkey, s_name FROM supplier")
def source_replaced(spark, sf_dir):
    r = registry(spark, sf_dir)
    r.register_or_replace("part", r.resolve("supplier"))
    return QueryEngine.over(r).from_("part").df().select("s_suppkey", "s_name")


@session_query("SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def source_single(spark, sf_dir):
    """One table under any name, read when the query is compiled."""
    return QueryEngine.over(lambda: registry(spark, sf_dir).resolve("part")).from_("whatever").where("p_size > 25").df().select("p_partkey", "p_brand")


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def fetch_result(e):
    result = e.from_("nation").where("n_regionkey = 1").parallel().fetch_result()
    return e.from_("nation").df().sparkSession.createDataFrame([(r["n_name"],) for r in result.items], "n_name string")


@query("SELECT count(*) FILTER (p_size < 10) AS few, count(*) FILTER (p_size < 10 AND p_retailprice > 1000) AS fewer, count(*) AS every FROM part")
def query_branches(e):
    """A query that was extended stays as it was."""
    every = e.from_("part")
    few = every.where("p_size < 10")
    fewer = few.and_("p_retailprice > 1000")
    counts = [q.count_matching_df().withColumnRenamed("count", n) for q, n in ((few, "few"), (fewer, "fewer"), (every, "every"))]
    return counts[0].join(counts[1]).join(counts[2])  # one row each


@query("SELECT n_nationkey, nullif(n_regionkey, 2) AS region FROM nation WHERE nullif(n_regionkey, 2) IS NOT NULL")
def decode_skip_null(e):
    return e.from_("nation", decoders.non_null(decoders.select(n_nationkey="n_nationkey", region="nullif(n_regionkey, 2)"), "region", skip=True)).df()


# order, page, find, count
_NULLS = "SELECT n_nationkey, nullif(n_regionkey, 2) AS region FROM nation ORDER BY nullif(n_regionkey, 2) * 100 + n_nationkey {} LIMIT 9"


def _nulls(e, order, nulls):
    # ranks are unique but for nulls; which of these a limit takes is settled by taking all five or none
    q = e.from_("nation", decoders.select(n_nationkey="n_nationkey", region="nullif(n_regionkey, 2)"))
    return q.order_by("region * 100 + n_nationkey", order, nulls).limit(9)


@query("SELECT count(*) AS nulls, count(region) AS others, coalesce(sum(region * 100 + n_nationkey), 0)::BIGINT AS ranks FROM (" + _NULLS.format("ASC NULLS FIRST") + ")")
def order_nulls_asc_first(e):
    return _told(_nulls(e, Order.ASC, NullOrdering.NULLS_FIRST).df())


@query("SELECT count(*) AS nulls, count(region) AS others, coalesce(sum(region * 100 + n_nationkey), 0)::BIGINT AS ranks FROM (" + _NULLS.format("ASC NULLS LAST") + ")")
def order_nulls_asc_last(e):
    return _told(_nulls(e, Order.ASC, NullOrdering.NULLS_LAST).df())


@query("SELECT count(*) AS nulls, count(region) AS others, coalesce(sum(region * 100 + n_nationkey), 0)::BIGINT AS ranks FROM (" + _NULLS.format("DESC NULLS LAST") + ")")
def order_nulls_desc_first(e):
    return _told(_nulls(e, Order.DESC, NullOrdering.NULLS_FIRST).df())


@query("SELECT count(*) AS nulls, count(region) AS others, coalesce(sum(region * 100 + n_nationkey), 0)::BIGINT AS ranks FROM (" + _NULLS.format("DESC NULLS FIRST") + ")")
def order_nulls_desc_last(e):
    return _told(_nulls(e, Order.DESC, NullOrdering.NULLS_LAST).df())


def _told(df):
    return df.agg(F.count(F.lit(1)).alias("nulls"), F.count("region").alias("others"), F.coalesce(F.sum(F.expr("region * 100 + n_nationkey")), F.lit(0)).cast("bigint").alias("ranks"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def order_by_asc(e):
    return _select(e.from_("orders").order_by("struct(o_totalprice, o_orderkey)").limit(50), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def order_by_desc(e):
    return _select(e.from_("orders").order_by("struct(o_totalprice, o_orderkey)", Order.DESC).limit(50), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def order_last_wins(e):
    return _select(e.from_("orders").order_by("o_totalprice").order_by("o_orderkey", Order.DESC).limit(20), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def page_offset_limit(e):
    return _select(e.from_("orders").limit(25).offset(100).where("o_orderstatus = 'F'").order_by("o_orderkey"), "o_orderkey")


@query("SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 33)")
def limit_only(e):
    return e.from_("orders").limit(33).df().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(e):
    return _select(e.from_("orders").limit(0), "o_orderkey")


@query("SELECT o_orderkey FROM orders OFFSET 100000000")
def offset_beyond(e):
    return _select(e.from_("orders").offset(100_000_000), "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 3")
def find_first(e):
    return e.from_("orders").order_by("o_orderkey").offset(3).limit(5).find_first_df().select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def find_any(e):
    last = e.from_("orders").order_by("o_orderkey", Order.DESC).find_first()["o_orderkey"]
    return e.from_("orders").where(F.col("o_orderkey") == last).offset(5).limit(0).find_any_df().select("o_orderkey")


@query("SELECT count(*) AS count FROM lineitem")
def count(e):
    return e.from_("lineitem").order_by("l_tax").count_df()


@query("SELECT count(*) AS count FROM (SELECT 1 FROM lineitem WHERE l_quantity < 10 LIMIT 500 OFFSET 20)")
def count_paged(e):
    return e.from_("lineitem").where("l_quantity < 10").offset(20).limit(500).count_df()


@query("SELECT count(*) AS count FROM lineitem WHERE l_quantity < 10")
def count_matching(e):
    return e.from_("lineitem").where("l_quantity < 10").offset(20).limit(5).count_matching_df()


_SUMMARY = "SELECT count(*) AS count, round(coalesce(sum(o_totalprice), 0.0), 2) AS sum, coalesce(min(o_totalprice), 'nan'::DOUBLE) AS min, coalesce(max(o_totalprice), 'nan'::DOUBLE) AS max, round(coalesce(avg(o_totalprice), 'nan'::DOUBLE), 4) AS avg FROM ({})"


def _summary(q: BlockQuery) -> DataFrame:
    return q.summarize_df("o_totalprice").withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


@query(_SUMMARY.format("SELECT * FROM orders"))
def summarize(e):
    return _summary(e.from_("orders"))


@query(_SUMMARY.format("SELECT * FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 50"))
def summarize_paged(e):
    return _summary(e.from_("orders").order_by("o_orderkey").offset(50).limit(200))


@query(_SUMMARY.format("SELECT * FROM orders WHERE o_orderkey < 0"))
def summarize_empty(e):
    return _summary(e.from_("orders").where("o_orderkey < 0"))


# groups
def _group(e, aggregator, digits=None):
    out = e.from_("lineitem").order_by("l_tax").limit(1).group_by("l_returnflag").aggregate(aggregator)
    return out.withColumn("value", F.round("value", digits)) if digits is not None else out


@query("SELECT l_returnflag AS key, count(*) AS value FROM lineitem GROUP BY 1")
def group_count(e):
    return _group(e, A.count())


@query("SELECT l_returnflag AS key, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
def group_sum(e):
    return _group(e, A.sum("l_extendedprice"), 2)


@query("SELECT l_returnflag AS key, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1")
def group_avg(e):
    return _group(e, A.avg("l_quantity"), 4)


@query("SELECT l_returnflag AS key, min(l_extendedprice) AS value FROM lineitem GROUP BY 1")
def group_min(e):
    return _group(e, A.min("l_extendedprice"))


@query("SELECT l_returnflag AS key, max(l_extendedprice) AS value FROM lineitem GROUP BY 1")
def group_max(e):
    return _group(e, A.max("l_extendedprice"))


@query("SELECT p_brand AS key, min(p_name) AS value FROM part GROUP BY 1")
def group_min_value(e):
    return e.from_("part").group_by("p_brand").aggregate(A.min_by("p_name"))


@query("SELECT p_brand AS key, max(p_name) AS value FROM part GROUP BY 1")
def group_max_value(e):
    return e.from_("part").group_by("p_brand").aggregate(A.max_by("p_name"))


@query("SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def group_custom(e):
    return e.from_("nation").group_by("n_regionkey").aggregate(A.Aggregator.of("array_join(sort_array(collect_list(n_name)), ',')"))


@query("SELECT n_regionkey AS key, max(length(n_name))::BIGINT AS value FROM nation GROUP BY 1")
def group_pandas(e):
    return e.from_("nation").group_by("n_regionkey").aggregate_rows(lambda rows: int(rows["n_name"].str.len().max()), "bigint")


@query("SELECT l_shipdate.year() AS key, count(*) AS value FROM lineitem WHERE l_discount > 0.05 GROUP BY 1".replace("l_shipdate.year()", "year(l_shipdate)::INT"))
def group_filtered(e):
    return e.from_("lineitem").where("l_discount > 0.05").group_by("year(l_shipdate)").aggregate(A.count())


@query("SELECT l_returnflag AS key1, l_linestatus AS key2, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2")
def group_composite_key(e):
    return e.from_("lineitem").group_by("l_returnflag", "l_linestatus").aggregate(A.sum("l_quantity")).withColumn("value", F.round("value", 2))


@query("SELECT nullif(n_regionkey, 2) AS key, count(*) AS value FROM nation GROUP BY 1")
def group_null_key(e):
    return e.from_("nation").group_by("nullif(n_regionkey, 2)").aggregate(A.count())


@query("SELECT o_orderpriority AS key, count(*) AS n, round(avg(o_totalprice), 4) AS mean, max(o_orderdate) AS last FROM orders GROUP BY 1")
def group_many(e):
    out = e.from_("orders").group_by("o_orderpriority").aggregate_all(n=A.count(), mean=A.avg("o_totalprice"), last=A.max_by("o_orderdate"))
    return out.withColumn("mean", F.round("mean", 4))


# joins
@query("SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_hash(e):
    q = e.from_("orders").where("o_totalprice > 100000").order_by("o_orderkey").limit(1)
    return q.join("customer").on_keys("o_custkey", "c_custkey").select("l.o_orderkey", "r.c_name", "r.c_mktsegment", "l.o_totalprice").df()


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_totalprice < 50000")
def join_hash_filtered(e):
    return e.from_("orders").where("o_orderstatus = 'O'").join("customer").where("o_totalprice < 50000").on_keys("o_custkey", "c_custkey").select("l.o_orderkey", "r.c_name").df()


@query("SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 2) = nullif(r_regionkey, 3)")
def join_null_keys(e):
    return e.from_("nation").join("region").on_keys("nullif(n_regionkey, 2)", "nullif(r_regionkey, 3)").select("l.n_name", "r.r_name").df()


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def join_duplicate_keys(e):
    return e.from_("orders").where("o_orderstatus = 'F'").join("lineitem").on_keys("o_orderkey", "l_orderkey").select("r.l_orderkey", "r.l_linenumber", "l.o_custkey").df()


@query("SELECT s_suppkey, c_custkey FROM supplier, customer WHERE s_acctbal + c_acctbal > 18000")
def join_theta(e):
    return e.from_("supplier").join("customer").on_rising("s_acctbal", "c_acctbal", lambda s, c: s + c > 18000).select("l.s_suppkey", "r.c_custkey").df()


@query("SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey")
def join_last_on_wins(e):
    j = e.from_("nation").join("region").on_keys("n_nationkey", "r_regionkey")
    return j.on_condition(lambda left, right: (F.col("l.n_regionkey") == F.col("r.r_regionkey")) & (F.col("l.n_nationkey") > F.col("r.r_regionkey"))).select("l.n_nationkey", "r.r_regionkey").df()


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def join_three_sources(e):
    pairs = e.from_("orders").where("o_totalprice > 200000").join("customer").on_keys("o_custkey", "c_custkey").select("l.o_orderkey", "r.c_nationkey").df()
    both = DataRegistry().register("pairs", pairs).register("nation", e.from_("nation").df())
    return QueryEngine.over(both).from_("pairs").join("nation").on_keys("c_nationkey", "n_nationkey").select("l.o_orderkey", "r.n_name").df()


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left_extension(e):
    return e.from_("customer").join("orders").on_keys("c_custkey", "o_custkey").kind("left").select("l.c_custkey", "r.o_orderkey").df()


# block state: events as writes of user_id, ordered by event_id
_TTL = "SELECT event_id, user_id, epoch_us(ts) // 1000 AS at, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch_us(ts) // 1000 + 3600000 * (event_id % 48) END AS expiry FROM events"
_NOW = "(SELECT max(epoch_us(ts) // 1000) - 86400000 FROM events)"


def _ms(c: str):
    return F.expr(f"unix_millis(cast({c} as timestamp))")


def _entries(e) -> DataFrame:
    df = e.from_("events").df()
    at = _ms("ts")
    expiry = F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(at + 3_600_000 * (F.col("event_id") % 48)).cast("bigint")
    return df.withColumn("at", at).withColumn("_expiry_ms", expiry)


def _now(df: DataFrame) -> int:
    return df.agg(F.max("at") - 86_400_000).first()[0]


@query(f"SELECT event_id, user_id FROM ({_TTL}) WHERE NOT (expiry > 0 AND {_NOW} > expiry)")
def live_view_ttl(e):
    df = _entries(e)
    return blocks.live_view(df, _now(df)).select("event_id", "user_id")


@query(f"SELECT event_id, expiry AS _expiry_ms FROM ({_TTL}) WHERE expiry > 0 AND {_NOW} > expiry")
def expired_rows(e):
    df = _entries(e)
    return blocks.expired_rows(df, _now(df)).select("event_id", "_expiry_ms")


def _users(e) -> DataFrame:
    df = _entries(e)
    return df.groupBy("user_id").agg(F.max("at").alias("_access_ms"), F.count(F.lit(1)).alias("_hits"), F.max(F.octet_length("props")).alias("bytes"))


_USERS = "SELECT user_id, max(epoch_us(ts) // 1000) AS _access_ms, count(*) AS _hits, max(strlen(props))::INT AS bytes FROM events GROUP BY 1"


@query(f"SELECT user_id, _access_ms FROM ({_USERS}) ORDER BY _access_ms DESC, user_id LIMIT 40")
def evict_lru(e):
    return eviction.evict(_users(e), Eviction.LRU, 40, ["user_id"]).select("user_id", "_access_ms")


@query(f"SELECT user_id, _hits FROM ({_USERS}) ORDER BY _hits DESC, user_id LIMIT 40")
def evict_lfu(e):
    return eviction.evict(_users(e), Eviction.LFU, 40, ["user_id"]).select("user_id", "_hits")


@query(f"SELECT user_id, bytes FROM ({_USERS}) ORDER BY bytes, user_id LIMIT 40")
def evict_size(e):
    return eviction.evict(_users(e), Eviction.SIZE_BASED, 40, ["user_id"], F.col("bytes")).select("user_id", "bytes")


@query(f"SELECT user_id FROM ({_USERS}) ORDER BY _hits DESC, user_id OFFSET 40")
def evicted_rows(e):
    return eviction.evicted(_users(e), Eviction.LFU, 40, ["user_id"]).select("user_id")


_BLOCK = BlockSpec("events", ("user_id",), ("value",))


def _state(e, where: str) -> DataFrame:
    rows = e.from_("events").where(where).df()
    return blocks.put_all(_BLOCK, blocks.stamped(_BLOCK, rows.limit(0), 0, 0, 0), blocks.stamped(_BLOCK, rows, 0, F.col("event_id"), 0))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def block_put_all(e):
    return _state(e, "true").select("user_id", "value")


def _customers(e) -> DataFrame:
    return e.from_("customer").df().select(F.col("c_custkey").alias("user_id"))


def _ending(e) -> DataFrame:
    """The state, of which odd users' rows are past their time at 2."""
    return _state(e, "true").withColumn("_expiry_ms", (F.col("user_id") % 2).cast("bigint"))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE user_id IN (SELECT c_custkey FROM customer) AND user_id % 2 = 0 GROUP BY 1")
def block_get(e):
    """Keys from another table, of which many aren't there."""
    return blocks.get(_BLOCK, _ending(e), _customers(e), 2).select("user_id", "value")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1")
def block_get_raw(e):
    return blocks.get_raw(_BLOCK, _ending(e), _customers(e)).select("user_id", "value")


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS _hlc_logical FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def block_raw_snapshot(e):
    return blocks.raw_snapshot(_BLOCK, _ending(e), 2).select("user_id", "value", "_hlc_logical")


@query("SELECT user_id, value FROM events WHERE false")
def block_clear(e):
    return blocks.clear(_state(e, "true")).select("user_id", "value")


@query("SELECT user_id, count(*) AS _hits, max(epoch_us(ts) // 1000) AS _access_ms FROM events GROUP BY 1")
def block_touched(e):
    accesses = e.from_("events").df().select("user_id", _ms("ts").alias("access_ms"))
    return blocks.touched(_BLOCK, _state(e, "true"), accesses).select("user_id", "_hits", "_access_ms")


@query("""WITH s AS (SELECT user_id, arg_max(value, event_id) AS v, count(*) AS h FROM events WHERE event_type <> 'click' GROUP BY 1),
c AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, coalesce(c.v, s.v) AS value, coalesce(h, 0) AS _hits FROM s FULL JOIN c USING (user_id)""")
def block_put_raw(e):
    """Replicated entries leave a key's use as it was."""
    others = e.from_("events").where("event_type <> 'click'").df().select("user_id", _ms("ts").alias("access_ms"))
    state = blocks.touched(_BLOCK, _state(e, "event_type <> 'click'"), others)
    return blocks.put_raw(_BLOCK, state, _state(e, "event_type = 'click'")).select("user_id", "value", "_hits")


@query(f"SELECT count(*) FILTER (value > 50) AS hits, count(*) FILTER (NOT value > 50) AS misses, round(count(*) FILTER (value > 50) * 100.0::DOUBLE / count(*), 6) AS hit_rate, 7::BIGINT AS evictions, (SELECT count(*) FROM ({_TTL}) WHERE expiry > 0 AND {_NOW} > expiry) AS expirations, (SELECT count(*) FROM ({_TTL}) WHERE NOT (expiry > 0 AND {_NOW} > expiry)) AS size FROM events")
def block_stats(e):
    df = _entries(e)
    return blocks.cache_stats(df.select((F.col("value") > 50).alias("hit")), df, _now(df), evictions=7).withColumn("hit_rate", F.round("hit_rate", 6))


# the cache of blocks
def _cache(spark: SparkSession) -> BlockCache:
    return BlockCache(spark, shared_path(spark, "cache"), clock_ms=lambda: 1_000_000)


_NATION = BlockSpec("nation", ("n_nationkey",), ("n_name",))


@session_query("SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN upper(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IS NOT NULL")
def cache_put_delete(spark, sf_dir):
    """Two batches of puts and one of deletes, then a query over the snapshot."""
    customers = registry(spark, sf_dir).resolve("customer").withColumnRenamed("c_mktsegment", "segment")
    with _cache(spark) as c:
        c.register_block(BlockSpec("customers", ("c_custkey",), ("segment",)), customers.schema)
        c.put_all("customers", customers)
        c.put_all("customers", customers.where("c_nationkey < 12").withColumn("segment", F.upper("segment")))
        c.delete("customers", customers.where("c_acctbal < 0"))
        return c.query().from_("customers").df()


@session_query("SELECT n_nationkey, length(n_name) AS n FROM nation WHERE length(n_name) > 6")
def cache_query_with(spark, sf_dir):
    """A decoded snapshot whose null fields are left out."""
    nations = registry(spark, sf_dir).resolve("nation")
    with _cache(spark) as c:
        c.register_block(_NATION, nations.schema)
        c.put_all("nation", nations)
        decoder = decoders.select(n_nationkey="n_nationkey", n="CASE WHEN length(n_name) > 6 THEN length(n_name) END")
        return c.query_with("nation", decoder, "n", skip_null=True).df()


def _evicting(spark: SparkSession, sf_dir: str) -> tuple[BlockCache, str]:
    nations = registry(spark, sf_dir).resolve("nation")
    c = _cache(spark).start()
    c.register_block(BlockSpec("nation", ("n_nationkey",), ("n_name",), eviction=Eviction.LFU, max_entries=15), nations.schema)
    c.put_all("nation", nations.where("n_nationkey >= 10"))
    c.get("nation", nations.where("n_nationkey >= 18"))
    c.put_all("nation", nations.where("n_nationkey < 10"))
    return c


@session_query("SELECT n_nationkey, n_name, (n_nationkey >= 18)::BIGINT AS _hits FROM nation WHERE n_nationkey >= 18 OR n_nationkey < 8")
def cache_get_is_use(spark, sf_dir):
    """Nations that were read outlive those that weren't."""
    c = _evicting(spark, sf_dir)
    state = c.state("nation").select("n_nationkey", "n_name", "_hits")
    c.shutdown()
    return state


@session_query("SELECT 'EVICT' AS op, n_nationkey FROM nation WHERE n_nationkey BETWEEN 8 AND 17 UNION ALL SELECT 'PUT', n_nationkey FROM nation")
def cache_events(spark, sf_dir):
    c = _evicting(spark, sf_dir)
    found = _handed_on(spark, c.watch_registry("nation").watch(), ["op", "n_nationkey"], "op string, n_nationkey int")
    c.shutdown()
    return found


@session_query("SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN lower(n_name) ELSE n_name END AS n_name FROM nation")
def cache_bootstrap(spark, sf_dir):
    """A joiner takes over the donor's rows, which were written later, and keeps its other ones."""
    nations = registry(spark, sf_dir).resolve("nation")
    with _cache(spark) as donor, _cache(spark) as joiner:
        for c in (donor, joiner):
            c.register_block(_NATION, nations.schema)
        joiner.put_all("nation", nations)
        donor.put_all("nation", nations.limit(0))
        donor.put_all("nation", nations.where("n_nationkey < 20").withColumn("n_name", F.lower("n_name")))
        joiner.bootstrap(donor, "nation")
        return joiner.query().from_("nation").df()


@session_query("SELECT 'nation' AS block, count(*) AS size FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def cache_metrics(spark, sf_dir):
    r, caches = registry(spark, sf_dir), BlockCaches()
    c = caches.get_or_create("one", lambda: _cache(spark).start())
    c.register_block(_NATION, r.resolve("nation").schema)
    c.register_block(BlockSpec("region", ("r_regionkey",), ("r_name",)), r.resolve("region").schema)
    c.put_all("nation", r.resolve("nation"))
    caches.get("one").put_all("region", r.resolve("region"))
    out = c.metrics()
    caches.shutdown_all()
    return out


@session_query("SELECT s_suppkey::VARCHAR AS node, CASE WHEN s_nationkey > 12 THEN 'DEAD' ELSE 'ALIVE' END AS state FROM supplier")
def cache_cluster(spark, sf_dir):
    suppliers = registry(spark, sf_dir).resolve("supplier").select(F.col("s_suppkey").alias("node"), "s_nationkey", F.lit(1).alias("incarnation"))
    with _cache(spark) as c:
        c.report(suppliers.withColumn("state", F.lit("ALIVE")))
        c.report(suppliers.where("s_nationkey > 12").withColumn("state", F.lit("DEAD")))
        return c.cluster().where(F.col("node") != str(c.node)).select("node", "state")


@query("SELECT c_custkey AS user_id, c_custkey IN (SELECT user_id FROM events) AS present FROM customer")
def block_contains(e):
    return blocks.contains(_BLOCK, _state(e, "true"), e.from_("customer").df().select(F.col("c_custkey").alias("user_id")), 1)


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY 1")
def block_delete(e):
    gone = e.from_("customer").where("c_nationkey < 20").df().select(F.col("c_custkey").alias("user_id"))
    return blocks.delete(_BLOCK, _state(e, "true"), gone)[0].select("user_id", "value")


# clock, merge
def _log(e) -> DataFrame:
    df = e.from_("events").df()
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    return df.select("user_id", "event_id", "value", op.alias("op"), _ms("ts").alias("_hlc_logical"), F.lit(0).cast("bigint").alias("_hlc_counter"), (F.col("event_id") % 7 - 3).alias("_origin_hi"), F.lit(None).cast("bigint").alias("_origin_lo"), F.col("event_id").alias("_arrival"))


_LOG = "SELECT user_id, event_id, value, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, epoch_us(ts) // 1000 AS t, event_id % 7 - 3 AS hi FROM events"
_WON = "SELECT user_id, event_id, value, op FROM ({}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, (op = 'DELETE')::INT DESC, hi DESC, event_id) = 1"


@query("SELECT user_id, event_id, value FROM (" + _WON.format(f"SELECT * FROM ({_LOG}) WHERE op = 'PUT'") + ")")
def lww_latest(e):
    return merge.lww_merge(_log(e).where("op = 'PUT'"), ["user_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, value FROM (" + _WON.format(_LOG) + ") WHERE op = 'PUT'")
def lww_deletes(e):
    return merge.lww_merge(_log(e), ["user_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def lww_custom_resolver(e):
    return merge.winners(_log(e), ["user_id"], F.col("event_id")).select("user_id", "event_id")


#: Every second event has a stamp of up to 15 days before its own, so stamps and arrivals differ.
_LATE = "CASE WHEN event_id % 2 = 0 THEN (event_id * 7919) % 1296000000 ELSE 0 END"


@query(f"""WITH l AS (SELECT user_id, event_id, value, op, hi, t - {_LATE} AS t FROM ({_LOG})),
d AS (SELECT *, max(CASE WHEN op = 'DELETE' THEN t END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM l)
SELECT user_id, event_id, value FROM d WHERE op = 'PUT' AND (gone IS NULL OR t > gone)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, hi DESC, event_id) = 1""")
def arrival_deletes(e):
    """The order-bound rule: later arrivals see no trace of a delete."""
    log = _log(e).withColumn("_hlc_logical", F.col("_hlc_logical") - F.expr(_LATE))
    return merge.arrival_merge(log, ["user_id"]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, value FROM (" + _WON.format(f"SELECT * FROM ({_LOG}) WHERE event_id % 3 <> 0 AND op = 'PUT' OR event_id % 3 = 0") + ") WHERE op = 'PUT'")
def bootstrap_merge(e):
    log = _log(e)
    donor = merge.lww_merge(log.where("event_id % 3 <> 0 and op = 'PUT'"), ["user_id"])
    return merge.bootstrap(donor.drop("op"), log.where("event_id % 3 = 0"), ["user_id"], 0).select("user_id", "event_id", "value")


@query("""WITH r AS (SELECT user_id, event_id, max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS logical FROM events)
SELECT user_id, event_id, logical, row_number() OVER (PARTITION BY user_id, logical ORDER BY event_id) - 1 AS counter FROM r""")
def hlc_stamp(e):
    df = e.from_("events").df().select("user_id", "event_id", _ms("ts").alias("wall"))
    return clock.stamp_local(df, "wall", ["event_id"], ["user_id"]).select("user_id", "event_id", "logical", "counter")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS wall, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 + (event_id % 11) * 1000000 END AS remote, event_id % 5 AS theirs FROM events),
l AS (SELECT *, max(greatest(wall, coalesce(remote, wall))) OVER (PARTITION BY user_id ORDER BY event_id) AS logical FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, logical ORDER BY event_id) - 1 AS i FROM l)
SELECT user_id, event_id, logical, i + max(CASE WHEN remote = logical THEN theirs + 1 WHEN i = 0 THEN 0 END - i) OVER (PARTITION BY user_id, logical ORDER BY event_id) AS counter FROM p""")
def hlc_update(e):
    """Clocks of users that hear the event before theirs."""
    remote = F.when(F.col("event_id") % 3 == 0, _ms("ts") + (F.col("event_id") % 11) * 1_000_000)
    rows = e.from_("events").df().select("user_id", "event_id", _ms("ts").alias("wall"), remote.alias("remote_logical"), F.when(remote.isNotNull(), F.col("event_id") % 5).alias("remote_counter"))
    return clock.stamp_with_remote(rows, "wall", ["event_id"], "user_id", "remote_logical", "remote_counter").select("user_id", "event_id", "logical", "counter")


@query("SELECT event_id, event_id % 3 > 1 OR event_id % 3 = 1 AND event_id % 5 > event_id % 4 AS later FROM events")
def hlc_is_after(e):
    a, b = F.struct(F.col("event_id") % 3, F.col("event_id") % 5).alias("a"), F.struct(F.lit(1).cast("bigint"), F.col("event_id") % 4).alias("b")
    return e.from_("events").df().select("event_id", a, b).select("event_id", clock.is_after("a", "b").alias("later"))


@query("SELECT n_nationkey AS peers, 0::BIGINT AS eventual, ((n_nationkey + 1) // 2)::BIGINT AS quorum, n_nationkey::BIGINT AS strong, n_regionkey + n_nationkey % 4 >= (n_nationkey + 1) // 2 AS complete FROM nation")
def required_acks(e):
    peers = F.col("n_nationkey")
    need = {c.value: merge.required_acks(c, peers) for c in Consistency}
    return e.from_("nation").df().select(peers.alias("peers"), *[n.alias(k) for k, n in need.items()], merge.acks_complete(F.col("n_regionkey"), peers % 4, need["quorum"]).alias("complete"))


@query("SELECT count(*) AS total_entries, ceil(count(*) / 6.0)::BIGINT AS chunks FROM nation")
def sync_chunks(e):
    """25 entries of 10 bytes, in chunks that hold six of them and a head."""
    return merge.sync_result(e.from_("nation").df().coalesce(1), 68, F.lit(10), head_bytes=4)


@query("SELECT greatest(max(3000 * (event_id % 30) - 1000), 0) AS local_drift, greatest(max(2000 * (event_id % 40) - 5000), 0) AS remote_drift, count(*) FILTER (3000 * (event_id % 30) - 1000 > 60000 OR 2000 * (event_id % 40) - 5000 > 60000) AS alerts FROM events")
def clock_drift(e):
    df = e.from_("events").df().select(_ms("ts").alias("wall"), (_ms("ts") + 3000 * (F.col("event_id") % 30) - 1000).alias("logical"), (_ms("ts") + 2000 * (F.col("event_id") % 40) - 5000).alias("remote"))
    return clock.drift(df, "wall", "logical", "remote")


@query("""SELECT node, state, incarnation FROM (SELECT s_nationkey AS node, ['ALIVE', 'SUSPECTED', 'DEAD'][(s_suppkey % 3 + 1)::INT] AS state, s_suppkey % 3 AS w, s_suppkey // 10 AS incarnation FROM supplier)
QUALIFY row_number() OVER (PARTITION BY node ORDER BY incarnation DESC, w DESC) = 1""")
def membership_merge(e):
    states = F.array(*[F.lit(s) for s in ("ALIVE", "SUSPECTED", "DEAD")])
    reports = e.from_("supplier").df().select(F.col("s_nationkey").alias("node"), F.element_at(states, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("state"), F.floor(F.col("s_suppkey") / 10).alias("incarnation"))
    return merge.membership(reports).select("node", "state", "incarnation")


@query("""SELECT node, state FROM (SELECT s_nationkey AS node, ['ALIVE', 'SUSPECTED', 'DEAD'][(s_suppkey % 3 + 1)::INT] AS state, s_suppkey % 3 AS w, s_suppkey // 10 AS incarnation FROM supplier
QUALIFY row_number() OVER (PARTITION BY node ORDER BY incarnation DESC, w DESC) = 1) WHERE state <> 'DEAD'""")
def membership_members(e):
    return merge.members(membership_merge(e), "ALIVE", "SUSPECTED").select("node", "state")


# changes, metrics
_CHANGES = f"SELECT event_id, user_id, op, CASE WHEN op = 'PUT' THEN value END AS new_value, lag(CASE WHEN op = 'PUT' THEN value END) OVER (PARTITION BY user_id ORDER BY event_id) AS old_value FROM ({_LOG})"


@query(_CHANGES)
def change_feed(e):
    return changes.change_feed(_log(e), ["user_id"], ["event_id"], "value").select("event_id", "user_id", "op", "new_value", "old_value")


def _handed_on(spark: SparkSession, watch: changes.Watch, columns: list[str], schema: str, on: str = "on_event") -> DataFrame:
    """What a watch hands on of all there is."""
    out = shared_path(spark, "watched")
    spark.createDataFrame([], schema).write.parquet(out)
    watch = getattr(watch, on)(lambda df: df.select(*columns).write.mode("append").parquet(out))
    watch.start(shared_path(spark, "watch-checkpoint"), availableNow=True).await_done()
    return spark.read.schema(schema).parquet(out)


_KINDS = "CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'view' THEN 'EXPIRE' ELSE 'PUT' END"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream; a stream's path is a folder or a pattern, so a single file is a pattern."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def _stream(spark: SparkSession, sf_dir: str) -> changes.Watch:
    """The events as a stream of changes."""
    return changes.WatchRegistry(_event_stream(spark, sf_dir).withColumn("op", F.expr(_KINDS))).watch()


_EVENTS = ["event_id", "op"], "event_id long, op string"


@session_query(f"SELECT event_id, op FROM (SELECT *, {_KINDS} AS op FROM events) WHERE op = 'PUT' AND user_id % 2 = 0 AND user_id < 50")
def watch_filter(spark, sf_dir):
    return _handed_on(spark, _stream(spark, sf_dir).filter("user_id % 2 = 0").filter(F.col("user_id") < 50), *_EVENTS, on="on_put")


@session_query(f"SELECT event_id, op FROM (SELECT *, {_KINDS} AS op FROM events) WHERE op = 'DELETE'")
def watch_delete(spark, sf_dir):
    return _handed_on(spark, _stream(spark, sf_dir), *_EVENTS, on="on_delete")


@session_query(f"SELECT event_id, op FROM (SELECT *, {_KINDS} AS op FROM events) WHERE op = 'EXPIRE'")
def watch_expire(spark, sf_dir):
    return _handed_on(spark, _stream(spark, sf_dir), *_EVENTS, on="on_expire")


@session_query(f"SELECT event_id, {_KINDS} AS op FROM events")
def watch_event(spark, sf_dir):
    return _handed_on(spark, _stream(spark, sf_dir).sync(), *_EVENTS)


def _counted(spark: SparkSession, handle: changes.WatchHandle) -> DataFrame:
    handle.await_done()
    return spark.createDataFrame([(handle.received, handle.skipped, handle.is_active)], "received long, skipped long, active boolean")


@session_query("SELECT 1::BIGINT AS received, 0::BIGINT AS skipped, false AS active")
def watch_once(spark, sf_dir):
    """One event, and the subscription ends."""
    return _counted(spark, _stream(spark, sf_dir).on_put(lambda df: df.count()).once().start(shared_path(spark, "watch-checkpoint")))


@session_query("SELECT count(*) FILTER (event_id % 10 BETWEEN 1 AND 4) AS received, count(*) FILTER (event_id % 10 = 0) AS skipped, false AS active FROM events")
def watch_skipped(spark, sf_dir):
    """A filter that fails leaves its event out, and counts it."""
    watch = _stream(spark, sf_dir).filter_rows(lambda event: 100 / (event["event_id"] % 10) >= 25, "event_id")
    return _counted(spark, watch.on_event(lambda df: df.count()).start(shared_path(spark, "watch-checkpoint"), availableNow=True))


@query(f"SELECT 'EXPIRE' AS op, user_id, NULL::DOUBLE AS new_value, value AS old_value, 'LOCAL' AS source FROM (SELECT event_id, value, user_id FROM events) JOIN ({_TTL}) USING (event_id, user_id) WHERE expiry > 0 AND expiry < {_NOW} AND expiry >= {_NOW} - 86400000")
def expiry_events(e):
    df = _entries(e)
    now = _now(df)
    return changes.expiry_events(df, ["user_id"], "value", now - 86_400_000, now)


@session_query("SELECT user_id, event_id, value FROM (" + _WON.format(_LOG) + ")")
def stream_latest(spark, sf_dir):
    """The winning row of each key, kept up by a stream."""
    out = shared_path(spark, "latest")
    log = _log(QueryEngine.over(DataRegistry().register("events", _event_stream(spark, sf_dir))))
    latest = changes.stream_latest(log, ["user_id"], merge.lww_order()).select("user_id", "event_id", "value")
    writer = latest.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    writer.option("checkpointLocation", shared_path(spark, "latest-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT epoch_us(ts) // 86400000000 * 86400000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(e):
    return changes.windowed_counts(e.from_("events").df(), "ts", "1 hour", "1 day", ["event_type"]).select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


_LAG = "(3600000 * (event_id % 7) - 3600000)"


@query(f"SELECT event_id, greatest({_LAG}, 0)::BIGINT AS lag_ms FROM events WHERE greatest({_LAG}, 0) >= 7200000")
def watch_lag_threshold(e):
    df = e.from_("events").df().withColumn("source_ms", _ms("ts")).withColumn("now_ms", _ms("ts") + 3_600_000 * (F.col("event_id") % 7) - 3_600_000)
    return changes.lagging(df, "now_ms", "source_ms", 7_200_000).select("event_id", "lag_ms")


@query("SELECT event_id, CASE WHEN event_id % 4 = 1 AND NOT (event_id % 8 = 1) THEN 'LOCAL' ELSE 'REPLICATED' END AS source FROM events")
def watch_source_tag(e):
    df = e.from_("events").df().select("event_id", F.lit("PUT").alias("op"), (F.col("event_id") % 4).alias("_origin_hi"), F.lit(0).cast("bigint").alias("_origin_lo"))
    return df.select("event_id", changes.source_tag((1, 0), F.expr("event_id % 8 = 1")).alias("source"))


@query("SELECT event_type AS block, count(*) FILTER (value > 50) AS hits, count(*) FILTER (NOT value > 50) AS misses, round(count(*) FILTER (value > 50) * 100.0::DOUBLE / count(*), 6) AS hit_rate FROM events GROUP BY 1")
def metrics_hit_rate(e):
    df = e.from_("events").df().select(F.col("event_type").alias("block"), (F.col("value") > 50).alias("hit"))
    return metrics.hit_rate(df, ["block"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"SELECT count(*) AS events, (sum(greatest({_LAG}, 0)) // count(*))::BIGINT AS avg_lag_ms, max(greatest({_LAG}, 0))::BIGINT AS max_lag_ms FROM events")
def metrics_lag(e):
    df = e.from_("events").df().select(_ms("ts").alias("source_ms"), (_ms("ts") + 3_600_000 * (F.col("event_id") % 7) - 3_600_000).alias("now_ms"))
    return metrics.replication_lag(df, "now_ms", "source_ms")


@query(f"SELECT user_id % 10 AS block, count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'DELETE') AS deletes, 0::BIGINT AS evictions, 0::BIGINT AS expirations FROM ({_LOG}) GROUP BY 1")
def metrics_block_counters(e):
    return metrics.block_counters(_log(e).withColumn("block", F.col("user_id") % 10), ["block"])


@query("SELECT event_type AS block, count(*) FILTER (value > 50) - 3 AS hits, count(*) FILTER (NOT value > 50) - 5 AS misses, round((count(*) FILTER (value > 50) - 3) * 100.0::DOUBLE / (count(*) - 8), 6) AS hit_rate FROM events WHERE event_type <> 'view' GROUP BY 1 UNION ALL SELECT 'view', count(*) FILTER (value > 50), count(*) FILTER (NOT value > 50), round(count(*) FILTER (value > 50) * 100.0::DOUBLE / count(*), 6) FROM events WHERE event_type = 'view'")
def metrics_hit_rate_since(e):
    """Since each block's own baseline; one block has none."""
    df = e.from_("events").df().select(F.col("event_type").alias("block"), (F.col("value") > 50).alias("hit"))
    baseline = df.where("block <> 'view'").select("block").distinct().withColumns({"hits": F.lit(3), "misses": F.lit(5)})
    return metrics.hit_rate(df, ["block"], baseline).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT count(*) FILTER (event_type = 'click') AS evicted, count(*) FILTER (event_type = 'view') AS expired FROM events")
def metrics_eviction_totals(e):
    op = F.when(F.col("event_type") == "click", "EVICT").when(F.col("event_type") == "view", "EXPIRE").otherwise("PUT")
    log = e.from_("events").df().select((F.col("user_id") % 10).alias("block"), op.alias("op"))
    return metrics.eviction_totals(metrics.block_counters(log, ["block"]))


@query("SELECT count(*) FILTER (value > 50) AS hits, count(*) FILTER (value > 50 AND event_type = 'click') AS click_hits, 0::BIGINT AS lag, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS alive FROM events")
def metrics_registry(e):
    r = metrics.MetricsRegistry(hits=metrics_hit_rate(e), cluster=metrics_cluster(e))
    row = (r.cache_hits(), r.cache_hits("click"), r.avg_replication_lag_ms(), r.alive_node_count())
    return e.from_("region").df().sparkSession.createDataFrame([row], "hits long, click_hits long, lag long, alive long")


@query("SELECT count(*) FILTER (s_suppkey % 3 = 0) AS alive, count(*) FILTER (s_suppkey % 3 = 1) AS suspected, count(*) FILTER (s_suppkey % 3 = 2) AS dead FROM supplier")
def metrics_cluster(e):
    states = F.array(*[F.lit(s) for s in ("ALIVE", "SUSPECTED", "DEAD")])
    return metrics.cluster_counts(e.from_("supplier").df().select(F.element_at(states, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("state")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_hash"](spark, sf_dir)
