import random

from blockmill.llm.components import connected_components
from blockmill.llm.prefix import sums_before


def test_equals_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(-60, 40)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(5, 5), (9000, 9000)]
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges * 2, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(part) if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sums_before(spark):
    rows = [(i * 7 % 101, i % 5, i % 9) for i in range(300)] + [(None, 0, 4)]
    df = spark.createDataFrame(rows, "a int, b int, v long").selectExpr("*", "monotonically_increasing_id() AS u")
    got = sums_before(df, ["a", "b", "u"], "v", "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (-1 if r.a is None else r.a, r.b, r.u)):
        assert r.before == total
        total += r.v
