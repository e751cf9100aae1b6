import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blockmill.llm import ngram_lm, queries

TEXTS = [(0, "a b a b c"), (1, "a b a b c"), (2, ""), (3, None), (4, "The the cat\tsat on the mat the cat"), (5, "b c a  b é"), (6, "x " * 300), (7, "the cat sat on a mat")]
SCHEMA = "doc_id long, text string, score string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(train, texts, order):
    """Interpolated modified Kneser-Ney by its definition, with tuples and dicts."""
    toks = lambda t: [*low(t).replace("\t", " ").split(" "), "</s>"]
    seq = lambda t: ["<s>"] * (order - 1) + [w for w in toks(t) if w]
    counts = {order: Counter()}
    for t in train:
        s = seq(t)
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    raw = Counter(w for t in train for w in seq(t)[order - 1 :])
    disc, ctx = {}, {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        disc[n] = [0.0] + [min(max(k - (k + 1) * y * up / lo, 0.1), k - 0.05) if lo and up else k / 2 for k, lo, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        ctx[n] = defaultdict(list)
        for g, x in c.items():
            ctx[n][g[:-1]].append(x)

    def p(g):
        n = len(g)
        lower = 1 / (len(raw) + 1) if n == 1 else p(g[1:])
        seen = ctx[n].get(g[:-1])
        if not seen:
            return lower
        x, d = counts[n].get(g, 0), disc[n]
        return (max(x - d[min(x, 3)], 0) + sum(d[min(k, 3)] for k in seen) * lower) / sum(seen)

    out = {}
    for i, t in texts:
        s = seq(t)
        inside = s[order - 1 :]
        base = sum(math.log10((raw[w] + 1) / (sum(raw.values()) + len(raw) + 1)) for w in inside)
        out[i] = (len(inside), sum(raw[w] > 0 for w in inside), base, sum(math.log10(p(tuple(s[k - order + 1 : k + 1]))) for k in range(order - 1, len(s))))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_equals_brute_force(spark, order):
    df = spark.createDataFrame([(*t, "clash") for t in TEXTS], SCHEMA)
    train = df.where("doc_id < 6")
    model = ngram_lm.fit_ngrams(train, order=order, parts=3)
    got = {r.doc_id: r for r in ngram_lm.score_ngrams(df, model).collect()}
    want = brute([t for i, t in TEXTS if i < 6], TEXTS, order)
    assert got.keys() == want.keys()
    for i, (n, known, base, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert got[i].score == pytest.approx(score, abs=1e-9), i


def test_a_missing_part_fails(spark):
    import os

    df = spark.createDataFrame([(*t, "clash") for t in TEXTS], SCHEMA)
    model = ngram_lm.fit_ngrams(df, order=3, parts=40)  # most parts are empty
    assert ngram_lm.score_ngrams(df, model).count() == len(TEXTS)
    folder = ngram_lm._local(model.folder)
    names = {n.rsplit("-", 1)[0] for n in os.listdir(folder)}
    assert all(os.path.exists(f"{folder}/{n}-{p}") for n in names for p in range(40))
    for p in range(40):
        os.remove(f"{folder}/2-{p}")
    ngram_lm._open.clear()
    with pytest.raises(Exception, match="a part of the model isn't there"):
        ngram_lm.score_ngrams(df, ngram_lm.NgramModel(model.folder + "/.", 3, 40, model.train_tokens, model.distinct, model.discounts, model.total, model.spared)).collect()


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b"), (1, "a c"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.score) for r in ngram_lm.score_ngrams(df, ngram_lm.fit_ngrams(df, order=3, parts=2)).collect())
    want = brute([t for _, t in rows], list(enumerate(t for _, t in rows)), 3)
    assert [d for d, _ in got] == [0, 0, 1, 1, 2]
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted((d or 0, want[i][3]) for i, (d, _) in enumerate(rows))], abs=1e-9)


def test_parts_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", 100)
    df = spark.createDataFrame([(i, "w " * 300) for i in range(10)], "doc_id long, text string")
    assert ngram_lm.fit_ngrams(df).parts == 10


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TEXTS], SCHEMA)
    model = ngram_lm.fit_ngrams(df.where("false"), parts=2)
    assert all(r.score == 0 and r.n_known == 0 for r in ngram_lm.score_ngrams(df, model).collect())
    assert ngram_lm.score_ngrams(df.where("false"), model).count() == 0


def test_more_than_255_of_a_kind(spark):
    df = spark.createDataFrame([(0, "x " * 1000, "")], SCHEMA)
    model = ngram_lm.fit_ngrams(df, parts=2)
    want = brute(["x " * 1000], [(0, "x " * 1000)], 2)[0]
    assert ngram_lm.score_ngrams(df, model).first().score == pytest.approx(want[3])


def test_query_uses_more_than_one_word_of_context(spark, tmp_path):
    texts = [(i, ["p a x", "q a y", "p a x z", "q a y z", "r a"][i % 5]) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute([t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2], texts, 3)
    got = {r.doc_id: r.score for r in queries.op5_kneser_ney(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: w[3] for i, w in want.items()})


@pytest.mark.parametrize("width", [1, 2, 3])
def test_blocks_keep_rows(width):
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**64, 300, np.uint64)
    for n in (0, 1, 2000):
        columns = [words[rng.integers(0, 300, n)] for _ in range(width)]
        if width == 1:
            columns = [np.sort(columns[0])]
        counts = [rng.integers(0, 2**32, n), np.arange(n)]
        back = ngram_lm._unpack(ngram_lm._pack(columns, counts))
        assert sorted(zip(*(c.tolist() for cs in back for c in cs))) == sorted(zip(*(c.tolist() for cs in (columns, counts) for c in cs)))
