"""Rows that operators have to stand: nulls anywhere, empty and long texts, repeats, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, `row` string, `key` string, part int, `_rest` string, `a b` string"


def documents(spark, more=(), seed=0):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Été", "straße", "the", "of", "and", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [
        (1, text(40), "en", "b", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, " \t\n ", "en", "a", 4),
        (5, text(30_000), "en", "a", 5),
        (6, text(40), "en", None, 6),
        (7, "same text here", "en", "a", 7),
        (8, "same text here", "en", "c", 8),
        (8, "same text here", "en", "c", 8),
        (9, text(300), "en", "c", 9),
        (None, text(30), "en", "a", 1),
        (None, None, None, None, None),
        *more,
    ]
    return spark.createDataFrame([(*r, 0.5, "s", "r", "k", 3, "u", "v") for r in rows], DOCS)


def nothing(spark):
    return documents(spark).limit(0)
