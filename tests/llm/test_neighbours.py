import math
import random

import numpy as np

from blockmill.llm import neighbours


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], "vec_id long, embedding array<float>, part int, id string, score double")


def brute(rows, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            near = {}
            for j, w in ok:
                if j != i:
                    d = float(np.sqrt(((w - v) ** 2).sum()))
                    near[j] = min(d, near.get(j, d))
            out[i] = sorted(near.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (3, rows[3][1]), (300, None), (301, [0.0] * 8), (302, [None] + [1.0] * 7), (303, [float("nan")] + [1.0] * 7), (400, [float("inf")] * 8), (None, [1.0] * 8)]
    df = frame(spark, rows)
    model = neighbours.fit_partitions(df)
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), model).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_with_partitions(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + rng.normal(0, 1, (3000, 16))).astype(np.float32)
    x[1000:1900] = x[1000]  # a third are one vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = frame(spark, rows)
    model = neighbours.fit_partitions(df)
    assert model.count > 1 and model.visits < model.count
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), model).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(rows)
    hits = sum(len({i for i, _ in want[q]} & {v for _, v in got.get(q, [])}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    assert all(sorted(k for k, _ in v) == list(range(1, 11)) for v in got.values())


def test_repeated_queries_keep_their_usable_row(spark):
    rows = [(100, [0.0, 0.0]), (100, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [5.0, 1.0]), (200, None), (200, [2.0, 2.0]), (3, [1.0, 2.0, 3.0])]
    df = frame(spark, rows)
    found = neighbours.search(df, df.where("vec_id % 100 = 0"), neighbours.fit_partitions(df)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(100, 1, 1), (100, 2, 200), (100, 3, 2), (200, 1, 1), (200, 2, 100), (200, 3, 2)]


def test_a_query_of_small_partitions_finds_all(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(0, 1, (700, 4)).astype(np.float32))]
    model = neighbours.fit_partitions(frame(spark, rows))
    model.visits = 1
    few = frame(spark, rows[:14])
    found = neighbours.search(few, few.where("vec_id < 5"), model, k=13).groupBy("query_id").count().collect()
    assert model.count > 1 and {(r.query_id, r["count"]) for r in found} == {(i, 13) for i in range(5)}


def test_partitions_are_balanced():
    x = np.random.default_rng(4).normal(0, 1, (1001, 6))
    graph = neighbours.exact_neighbours(x, x, 8, np.arange(len(x)))
    part = neighbours.balanced_partition(graph, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 3
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.7 * (7 / 8)


def test_no_rows_and_few_candidates(spark):
    none = frame(spark, []).limit(0)
    assert neighbours.search(none, none, neighbours.fit_partitions(none)).count() == 0
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])])
    rows = neighbours.search(df, df.where("vec_id % 100 = 0"), neighbours.fit_partitions(df)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]


def test_large_partitions_are_split(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (60, 12))
    x = (centres[rng.integers(0, 60, 9000)] + rng.normal(0, 1, (9000, 12))).astype(np.float32)
    x[1000:4000] = x[1000]  # a third are one vector: a partition that can't be split
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = frame(spark, rows).repartition(4)
    asked = df.where("vec_id % 100 = 0")
    model = neighbours.fit_partitions(df, sample=2_000)
    found = neighbours.search(df, asked, model, split_rows=600).cache()
    want, got = brute(rows), {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert all(got[q][i] == d for q in want for i, d in want[q] if i in got[q])
    hits = sum(i in got[q] for q in want for i, _ in want[q]) / (10 * len(want))
    assert hits >= 0.9
    assert abs(neighbours.measured_recall(df, found, asked) - hits) < 1e-12
    assert set(got[1100]) == set(range(1000, 1010)) and set(got[1000]) == set(range(1001, 1011))


def test_a_split_visits_under_half(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 4, (60, 12))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate((centres[rng.integers(0, 60, 6000)] + rng.normal(0, 1, (6000, 12))).astype(np.float32))]
    df = frame(spark, rows)
    model = neighbours.fit_partitions(df, sample=2_000)
    place = lambda v: spark.createDataFrame(v, "id long, v array<double>, part long")
    home = model.probable(np.array([v for _, v in rows]), 1)[:, 0]
    base = place([(i, v, neighbours.MOST_PARTITIONS + int(p)) for (i, v), p in zip(rows, home, strict=True)])
    seen = [(i, v, neighbours.MOST_PARTITIONS + int(p)) for i, v in rows[::100] for p in model.probable(np.array([v]), model.visits)[0]]
    leaves, asked = neighbours._split(base, place(seen), 0.97, 10, 0, 400)
    sizes = {r.part: r["count"] for r in leaves.groupBy("part").count().collect()}
    assert sum(sizes.values()) == len(rows) and len(sizes) > model.count and max(sizes.values()) <= 400
    read = sum(sizes.get(r.part, 0) for r in asked.collect())
    assert read < 0.5 * len(rows) * len(rows[::100])


def test_recall_of_no_query_is_whole(spark):
    none = frame(spark, []).limit(0)
    found = neighbours.search(none, none, None)
    assert neighbours.measured_recall(none, found, none) == 1.0
