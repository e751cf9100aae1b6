"""Approximate nearest neighbours with learned partitions.

A bounded sample gives an exact neighbour graph; the graph is cut into equal partitions with few cut
edges; a small classifier learns from a vector to the partitions of its neighbours. Every row is
indexed under its most probable partition, a query visits its several most probable ones, and the
vectors found there are ranked by exact distance.

Partitions grow in number with the table: one that holds more than SPLIT_ROWS rows is partitioned in
the same way by a graph and a classifier of its own, fitted in a task on a bounded sample of its rows,
and so on, so what a query reads at the end doesn't grow. A partition that can't be split, as its rows
are copies of few vectors, keeps the rows that can be among the nearest of some query. Partitions are
dealt out in blocks of bounded size, so one that holds a third of all rows is many tasks.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockmill.llm.common import temporary, trimmed, written

SAMPLE, MOST_PARTITIONS, LEAST_IN_PARTITION = 8_192, 32, 128
BASE_BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Rows from which a partition is split; nodes of the tree are numbered node * MOST_PARTITIONS + child.
SPLIT_ROWS, ROOT, LAST_SPLIT = 65_536, 1, MOST_PARTITIONS**11


@dataclass
class Partitions:
    """Classifier h = relu(xW + b), scores hC + d; visits is how many partitions a query asks.

    reach[i] is the recall that i + 1 visited partitions gave on held-out vectors.
    """

    dimension: int
    mean: np.ndarray
    scale: float
    params: list[np.ndarray]
    visits: int
    recall: float
    aim: float = 1.0
    reach: np.ndarray = field(default_factory=lambda: np.ones(1))

    def visits_for(self, aim: float) -> int:
        """The least number of partitions that reaches the recall aimed at."""
        return int(np.argmax(self.reach >= aim)) + 1 if (self.reach >= aim).any() else self.count

    def probable(self, x: np.ndarray, most: int) -> np.ndarray:
        """The most probable partitions of each row of x, best first."""
        w, b, c, d = self.params
        s = np.maximum((x - self.mean) / self.scale @ w + b, 0) @ c + d
        return np.argsort(-s, 1, kind="stable")[:, :most]

    @property
    def count(self) -> int:
        return len(self.params[3])


def usable(c: Column) -> Column:
    """Vectors that take part: no null, no null or non-finite component, not all zeros."""
    v = c.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(c.isNotNull() & ~bad & F.exists(v, lambda x: x != 0.0), F.lit(False))


def exact_neighbours(queries: np.ndarray, base: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of base next to each query; own: rows of base to leave out."""
    out = []
    norms = (base**2).sum(1)
    for i in range(0, len(queries), 256):  # 256 rows of distances at a time
        d = queries[i : i + 256] @ base.T
        d *= -2
        d += norms
        if own is not None:
            d[np.arange(len(d)), own[i : i + 256]] = np.inf
        out.append(np.argpartition(d, min(k, d.shape[1] - 1), 1)[:, :k])
    return np.concatenate(out)


def _halve(nodes: np.ndarray, graph: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of nodes with few edges between: the graph's slowest mode, then gainful swaps."""
    at = np.full(len(graph), -1)
    at[nodes] = np.arange(len(nodes))
    src = np.repeat(np.arange(len(nodes)), graph.shape[1])
    dst = at[graph[nodes]].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    src, dst = np.r_[src, dst], np.r_[dst, src]
    degree = np.bincount(src, minlength=len(nodes)) + 1.0
    v = rng.normal(size=len(nodes))
    for _ in range(60):
        v = (v + np.bincount(src, v[dst], len(nodes))) / degree
        v -= (v * degree).sum() / degree.sum()
        v /= np.abs(v).max() + 1e-30
    side = np.zeros(len(nodes), bool)
    side[np.argsort(v, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(20):
        out = np.bincount(src, side[dst] != side[src], len(nodes)) - np.bincount(src, side[dst] == side[src], len(nodes))
        a, b = (np.flatnonzero(side == s)[np.argsort(-out[side == s], kind="stable")] for s in (True, False))
        n = min(len(a), len(b), max(1, len(nodes) // 50))
        gain = (out[a[:n]] + out[b[:n]] > 2).cumprod().astype(bool)
        if not gain.any():
            break
        side[a[:n][gain]], side[b[:n][gain]] = False, True
    return nodes[~side], nodes[side]


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Partition of each node, all of equal size within one a halving; parts is a power of two."""
    rng, groups = np.random.default_rng(seed), [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halve(g, graph, rng)]
    out = np.zeros(len(graph), int)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def _classifier(x: np.ndarray, target: np.ndarray, width: int, epochs: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], width)), np.zeros(width), rng.normal(0, np.sqrt(1 / width), (width, target.shape[1])), np.zeros(target.shape[1])]
    m, v, step = [0 * p for p in params], [0 * p for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            part, step = order[i : i + 256], step + 1
            h = np.maximum(x[part] @ params[0] + params[1], 0)
            s = h @ params[2] + params[3]
            p = np.exp(s - s.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[part]) / len(part)
            dh = d @ params[2].T * (h > 0)
            for k, g in enumerate((x[part].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return params


def _learned(x: np.ndarray, neighbours: int, aim: float, width: int, epochs: int, seed: int) -> Partitions:
    """Partitions of sample vectors; a single one if they are too few."""
    dimension = x.shape[1]
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(seed).permutation(len(x))]
    n_test = len(x) // 16
    test, x = x[:n_test], x[n_test:]
    mean = x.mean(0)
    scale = float(x.std()) or 1.0
    parts = 1
    while parts * 2 * LEAST_IN_PARTITION <= len(x) and parts < MOST_PARTITIONS:
        parts *= 2
    if parts == 1:
        return Partitions(dimension, mean, scale, [np.zeros((dimension, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1.0, aim)
    graph = exact_neighbours(x, x, neighbours, np.arange(len(x)))
    part = balanced_partition(graph, parts, seed)
    target = np.zeros((len(x), parts))
    for k in range(neighbours):
        np.add.at(target, (np.arange(len(x)), part[graph[:, k]]), 1 / (neighbours + 1))
    np.add.at(target, (np.arange(len(x)), part), 1 / (neighbours + 1))
    fitted = Partitions(dimension, mean, scale, _classifier((x - mean) / scale, target, width, epochs, seed), parts, 1.0, aim)
    home, asked = fitted.probable(x, 1)[:, 0], fitted.probable(test, parts)
    true = home[exact_neighbours(test, x, neighbours)]
    place = np.argmax(asked[:, None, :] == true[:, :, None], 2)  # when a neighbour's partition is visited
    fitted.reach = np.array([(place <= i).mean() for i in range(parts)])
    fitted.visits = fitted.visits_for(aim)
    fitted.recall = float(fitted.reach[fitted.visits - 1])
    return fitted


def fit_partitions(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, aim: float = 0.95, neighbours: int = 10, width: int = 64, epochs: int = 15, seed: int = 3) -> Partitions | None:
    """Partitions learned from at most sample rows, chosen by hash; None without a usable vector.

    A sixteenth of the sample is held out: as queries against the rest, it settles how many partitions
    a query visits to reach the recall aimed at.
    """
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(vector_col).cast("array<double>").alias("v"), id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).select("v").collect()
    sizes = [len(r["v"]) for r in rows]
    if not sizes:
        return None
    dimension = max(set(sizes), key=lambda n: (sizes.count(n), n))
    return _learned(np.array([r["v"] for r in rows if len(r["v"]) == dimension]), neighbours, aim, width, epochs, seed)


def _matrix(t: pa.Table) -> np.ndarray:
    return np.asarray(t.column("v").combine_chunks().flatten()).astype(float).reshape(t.num_rows, -1)


def _visited(model: Partitions, x: np.ndarray, most: int, held: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, partition) of all visits: the `most` most probable partitions of each row, and with `least`
    as many more as hold so many rows together; held counts the rows of each partition."""
    best = model.probable(x, model.count if least else most)
    asks = np.broadcast_to(np.arange(best.shape[1]) < most, best.shape)
    if least:
        asks = asks | (np.cumsum(held[best], 1) - held[best] < least)
    return np.repeat(np.arange(len(x)), asks.sum(1)), best[asks]


def _children(base: DataFrame, big: DataFrame, aim: float) -> DataFrame:
    """part, n and the fitted model of each partition in big (part, n); null for one that can't be split."""

    def fit(t: pa.Table) -> pa.Table:
        model = _learned(_matrix(t), 10, aim, 64, 15, 3)
        return pa.table({"part": t.column("part").slice(0, 1), "n": t.column("n").slice(0, 1), "model": pa.array([pickle.dumps(model) if model.count > 1 else None], pa.binary())})

    chosen = F.pmod(F.xxhash64(F.lit(7), "id", "v"), F.col("n")) < 2 * SAMPLE
    at = F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("id"), "id"))
    rows = base.join(big, "part").where(chosen).withColumn("at", at).where(F.col("at") <= SAMPLE).drop("at")
    return rows.select("part", "n", "v").groupBy("part").applyInArrow(fit, "part long, n long, model binary")


def _descend(rows: DataFrame, nodes: DataFrame, visits, least: int, size: int) -> DataFrame:
    """The rows of the partitions in nodes, placed in these partitions' own ones. A task holds `size` rows
    and one model; visits tells from a model how many partitions a row is placed in."""

    def place(rows: pa.Table, node: pa.Table) -> pa.Table:
        if not rows.num_rows or not node.num_rows:
            return rows.select(["id", "v", "part"]).slice(0, 0)
        model = pickle.loads(node.column("model")[0].as_py())
        held = np.zeros(model.count, np.int64)
        for child in node.column("held")[0].as_py() or []:
            held[child["part"] % MOST_PARTITIONS] = child["rows"]
        at, part = _visited(model, _matrix(rows), visits(model), held, least)
        own = node.column("part")[0].as_py()
        return rows.select(["id", "v"]).take(pa.array(at)).append_column("part", pa.array(own * MOST_PARTITIONS + part, pa.int64()))

    sized = rows.join(nodes.select("part"), "part").groupBy("part").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("nb"))
    dealt = rows.join(sized, "part").select("id", "v", "part", F.pmod(F.xxhash64("id", "v"), F.col("nb")).cast("int").alias("b"))
    models = nodes.join(sized, "part").select("part", "model", "held", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    return dealt.groupBy("part", "b").cogroup(models.groupBy("part", "b")).applyInArrow(place, "id long, v array<double>, part long")


def measured_recall(vectors: DataFrame, found: DataFrame, queries: DataFrame, k: int = 10, most: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of the true k nearest of at most `most` queries (chosen by hash) that found holds, by distance.

    The truth is brute force over all rows: a task keeps the k nearest of each query among its rows.
    found is search's result; repeated ids count once each. 1.0 if no query takes part.
    """
    one = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    one = one.groupBy("query_id").agg(F.min("v").alias("v"))
    asked = one.join(found.select("query_id").distinct(), "query_id", "left_semi").orderBy(F.xxhash64("query_id"), "query_id").limit(most).collect()
    if not asked:
        return 1.0
    qids, y = np.array([r["query_id"] for r in asked]), np.array([r["v"] for r in asked])

    def near(batches):
        best: list[dict[int, float]] = [{} for _ in qids]
        for b in batches:
            if b.num_rows:
                ids, x = np.asarray(b.column("id")), _matrix(pa.Table.from_batches([b]))
                for i, (qid, v) in enumerate(zip(qids, y, strict=True)):
                    d = np.sqrt(((x - v) ** 2).sum(1))
                    for j in np.lexsort((ids, d))[: k + 1 + len(ids) - len(np.unique(ids))]:
                        if ids[j] != qid:
                            best[i][int(ids[j])] = min(float(d[j]), best[i].get(int(ids[j]), np.inf))
                    best[i] = dict(sorted(best[i].items(), key=lambda e: (e[1], e[0]))[:k])
        out = [(int(q), i, d) for q, e in zip(qids, best, strict=True) for i, d in e.items()]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) == y.shape[1]))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    true = rows.mapInArrow(trimmed(near), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    true = true.withColumn("rank", rank).where(F.col("rank") <= k)
    hits = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.count("hit").alias("hit"), F.count("*").alias("n")).first()
    return hits["hit"] / hits["n"] if hits["n"] else 1.0


def _split(base: DataFrame, asked: DataFrame, aim: float, k: int, again: int, split_rows: int) -> tuple[DataFrame, DataFrame]:
    """base and asked with all partitions of more than split_rows rows split, level by level.

    Where a partition can't be split, only the k + 1 smallest ids of equal vectors stay: no query has
    others of them among its k nearest.
    """
    at_rest: list[tuple[DataFrame, DataFrame]] = []
    while True:
        sizes = base.groupBy("part").agg(F.count("*").alias("n"))
        big = written(sizes.where((F.col("n") > split_rows) & (F.col("part") < LAST_SPLIT)), "ann-big")
        if big.isEmpty():
            at_rest.append((base, asked))
            break
        fitted = written(_children(base, big, aim), "ann-models")
        nodes, whole = fitted.where(F.col("model").isNotNull()), fitted.where(F.col("model").isNull()).select("part")
        small = base.join(big.select("part"), "part", "left_anti")
        same = F.dense_rank().over(W.partitionBy("part", "v").orderBy("id"))
        copies = base.join(whole, "part", "left_semi").withColumn("same", same).where(F.col("same") <= k + 1).drop("same")
        at_rest.append((small.unionByName(copies), asked.join(nodes.select("part"), "part", "left_anti")))
        if nodes.isEmpty():
            break
        none = F.lit(None).cast("array<struct<part: long, rows: long>>").alias("held")
        base = written(_descend(base, nodes.select("part", "model", none), lambda m: 1, 0, BASE_BLOCK), "ann-index")
        held = base.groupBy("part").agg(F.count("*").alias("rows")).groupBy(F.floor(F.col("part") / MOST_PARTITIONS).alias("part")).agg(F.collect_list(F.struct("part", "rows")).alias("held"))
        asked = written(_descend(asked, nodes.join(held, "part"), lambda m: m.visits, k + 1 + again, QUERY_BLOCK), "ann-queries")
    out = at_rest[0]
    for more in at_rest[1:]:
        out = tuple(a.unionByName(b) for a, b in zip(out, more, strict=True))
    return out


def search(vectors: DataFrame, queries: DataFrame, model: Partitions | None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by Euclidean distance, itself left out.

    Ties go to the smaller id. Unusable vectors (see usable) and vectors of another dimension take no
    part; of repeated ids a query counts once, by its smallest usable vector, and a candidate by its
    nearest row. Null ids take no part. A query whose partitions hold too few rows visits more of them.
    """
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    with temporary() as keep:  # the index's tables go when the result is written
        return keep(written(_found(vectors, queries, model, k, id_col, vector_col, split_rows), "ann-found"))


def _found(vectors: DataFrame, queries: DataFrame, model: Partitions, k: int, id_col: str, vector_col: str, split_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def placed(most: int, rows_of: np.ndarray | None = None, least: int = 0):
        def place(batches):
            fitted = shared.value
            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column(1).flatten()).astype(float).reshape(b.num_rows, -1)
                    at, part = _visited(fitted, x, most, rows_of, least)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(ROOT * MOST_PARTITIONS + part, pa.int64())], names=["id", "v", "part"])

        return place

    def taking_part(df: DataFrame) -> DataFrame:
        ok = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & (F.size(vector_col) == model.dimension))
        return ok.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    indexed = "id long, v array<double>, part long"
    base = written(taking_part(vectors).mapInArrow(trimmed(placed(1)), indexed), "ann-index")
    held = np.zeros(model.count, np.int64)
    for r in base.groupBy("part").count().collect():  # a row a partition of the first level
        held[r["part"] - ROOT * MOST_PARTITIONS] = r["count"]
    levels, rows = 1, held.sum() / model.count
    while rows > split_rows and levels < 11:
        levels, rows = levels + 1, rows / MOST_PARTITIONS
    aim = model.aim ** (1 / levels)  # of each level, so that all together reach the model's aim
    visits = model.visits if levels == 1 else max(model.visits, model.visits_for(aim))
    again = base.agg((F.count("*") - F.count_distinct("id")).alias("n")).first()["n"]  # rows that repeat an id
    one = taking_part(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(one.mapInArrow(trimmed(placed(visits, held, k + 1 + again)), indexed), "ann-queries")
    base, asked = _split(base, asked, aim, k, again, split_rows)
    blocks = lambda df, size, name: df.groupBy("part").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    grid = written(blocks(base, BASE_BLOCK, "nb").join(blocks(asked, QUERY_BLOCK, "nq"), "part"), "ann-grid")  # a row a partition
    a = base.join(grid, "part").select("id", "v", "part", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"))
    q = asked.join(grid, "part").select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("id"), F.col("nq")).cast("int").alias("q"))

    def nearest(base: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if base.num_rows and asked.num_rows:
            ids, qids = (np.asarray(t.column("id").combine_chunks()) for t in (base, asked))
            x, y = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (base, asked))
            norms = (x**2).sum(1)
            most_rows = min(k + len(ids) - len(np.unique(ids)), len(x))  # so many rows hold k ids
            for i in range(0, len(y), 256):
                part = y[i : i + 256]
                rough = norms - 2 * part @ x.T + (part**2).sum(1)[:, None]
                rough[qids[i : i + 256, None] == ids] = np.inf
                limit = np.partition(rough, most_rows - 1, 1)[:, most_rows - 1]
                for row, qid, vector, most in zip(rough, qids[i : i + 256], part, limit, strict=True):
                    near = np.flatnonzero((row <= most + 1e-9 * (1 + (vector**2).sum())) & np.isfinite(row))
                    exact = np.sqrt(((x[near] - vector) ** 2).sum(1))
                    best: dict[int, float] = {}
                    for j in np.lexsort((ids[near], exact)):
                        best.setdefault(int(ids[near[j]]), float(exact[j]))
                        if len(best) == k:
                            break
                    out += [(int(qid), i, d) for i, d in best.items()]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = a.groupBy("part", "b", "q").cogroup(q.groupBy("part", "b", "q")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
