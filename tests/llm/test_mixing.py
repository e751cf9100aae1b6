from collections import defaultdict
from itertools import cycle

import pytest

from blockmill.llm import mixing
from tests.llm.fixtures import documents, nothing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight, cap, share the excess again, until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(names, cycle(weights)))
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9), s
    return taken


def test_budgets_are_exact(spark):
    rows = mixing.mix_sources(documents(spark), rows_per_range=2).collect()
    assert len(rows) == 12
    check(rows)
    again = mixing.mix_sources(documents(spark).repartition(3), rows_per_range=2).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


@pytest.mark.parametrize("most_broadcast", [0, 50_000])
def test_many_sources_and_a_hot_one(spark, most_broadcast):
    import random

    rng = random.Random(3)
    more = [(100 + i, " ".join(["w"] * rng.randrange(1, 30)), "en", "hot" if i % 2 else f"s{i % 37}", 0) for i in range(600)]
    rows = mixing.mix_sources(documents(spark, more), rows_per_range=10, most_broadcast=most_broadcast).collect()
    assert len(rows) == 612
    check(rows)


def test_the_mix_itself(spark):
    docs = documents(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = check(mixing.mix_sources(docs).collect())
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert (r["size"], r["key"], r["part"], r["_rest"], r["a b"]) == ("s", "k", 3, "u", "v")
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_no_rows_and_no_words(spark):
    assert mixing.mix_sources(nothing(spark)).count() == 0
    assert mixing.mixed_documents(nothing(spark)).count() == 0
    blank = documents(spark).where("doc_id in (2, 3, 4)")
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix_sources(blank).collect())
