import random

import pytest

from blockmill.llm import jaccard

SCHEMA = "doc_id long, text string, component_id string, class string, key string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in low(text).split(" ") if w]


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["the", "of", "and"] * 60
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 30, 60, 140, 500]))]
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                copy = copy + [rng.choice(vocabulary)] * rng.randrange(4)
            texts.append(" ".join(copy) if rng.random() < 0.8 else "\n".join(copy).upper())
    texts += ["", None, " \t\n", "A b", "a  B", "a", "É é", "x " * 4000, "x " * 5000]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize(("seed", "width", "percent", "block"), [(1, 3, 90, 1000), (2, 3, 90, 3), (3, 5, 80, 1000), (4, 5, 80, 4), (5, 2, 70, 1000)])
def test_equals_brute_force(spark, seed, width, percent, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, width, percent, block).collect())
    assert got == brute(rows, width, percent)


def test_one_of_each(spark):
    rows = corpus(6)
    rows += [rows[0], rows[0], (None, "a null id"), (None, None)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    want = {c for d, _, c in brute([r for r in rows if r[0] is not None], 5, 80)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2


@pytest.mark.parametrize("percent", [80, 90])
def test_rows_without_an_id_bridge_others(spark, percent):
    words = [f"w{k}" for k in range(200)]
    cut = 14 if percent == 80 else 7  # one cut keeps the threshold, two don't
    left, middle, right = words[:-cut], words, words[cut:]
    rows = [(5, " ".join(left)), (None, " ".join(middle)), (None, " ".join(middle)), (3, " ".join(right)), (None, "one of its own kind"), (0, "and another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, 3, percent).collect()), key=repr)
    assert got == sorted([(5, 3), (None, 3), (None, 3), (3, 3), (None, None), (0, 0)], key=repr)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_components(df).count() == 0
    assert jaccard.one_of_each(df).count() == 0


def test_pairs_of_one_size_class_share_a_key():
    """No linked pair may miss the routing: random sets at and around the threshold."""
    import numpy as np

    rng = np.random.default_rng(0)
    for percent in (70, 80, 90, 95):
        for _ in range(400):
            n = int(rng.integers(1, 800))
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(rng.integers(0, max(1, int(n * (100 - percent) / 100) + 2)))
            new = int(rng.integers(0, max(1, int(n * (100 - percent) / 100) + 2)))
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)])
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                frequent = np.sort(rng.choice(a, len(a) // 3)) if len(a) > 3 else a[:0]
                assert np.intersect1d(jaccard.set_keys(x, percent, frequent), jaccard.set_keys(y, percent, frequent)).size
