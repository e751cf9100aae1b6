import random

import numpy as np
import pytest

from blockmill.llm import quality, toxicity
from tests.llm.fixtures import documents, nothing


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rude = ["idiot", "scum", "moron"]
    docs, labels = [], []
    for i in range(1000, 1000 + n):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(2, 12))]
        toxic, poor = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k] + " " + rng.choice(rude)
        text = ". ".join(sentences) + "."
        if poor:
            text = rng.choice([" | ".join(text.split()), (text.split()[0] + " ") * 80, text.upper().replace(" ", "!! ")])
        docs.append((i, text, "en", "a", 0))
        labels.append((i, int(not poor), int(toxic), "x", 0.1))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int, text string, label double"


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = corpus()
    labels += [(None, 1, 1, "x", 0.0), (5, None, None, "x", 0.0), (1000, None, None, "x", 0.0), (99999, 1, 0, "x", 0.0)]
    return documents(spark, docs), spark.createDataFrame(labels, LABELS)


def accuracy(rows, labels, field, held):
    truth = {r.doc_id: r[field] for r in labels.collect() if r[field] is not None and r.doc_id is not None}
    some = [(r.score, truth[r.doc_id]) for r in rows if r.doc_id in truth and r.doc_id >= 1000 and held(r.doc_id)]
    return some


def test_toxicity(spark, data):
    import zlib

    docs, labels = data
    model = toxicity.fit_toxicity(docs, labels)
    assert {"idiot", "scum", "moron"} <= set(model.terms)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    some = accuracy(rows, labels, "toxic", lambda d: zlib.crc32(str(d).encode()) % 4 == 2)
    assert len(some) > 50 and np.mean([(s >= 0.3) == t for s, t in some]) > 0.97
    for r in rows:
        for o in r.offending:
            assert r.text[o.start : o.end] == o.text and {"idiot", "scum", "moron"} & set(toxicity.WORDS.findall(o.text.lower()))
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 8}) == 1
    assert rows[0]["a b"] == "v" and rows[0]["_rest"] == "u"


def test_only_training_rows_teach(spark, data):
    import zlib

    docs, labels = data
    held = labels.where("crc32(cast(doc_id AS string)) % 4 = 2").selectExpr("doc_id", "quality", "1 - toxic AS toxic", "text", "label")
    turned = labels.where("NOT coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)").unionByName(held)
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, turned)
    assert a.terms == b.terms and np.allclose(a.weights, b.weights)
    assert zlib.crc32(b"1") % 4 in range(4)


def test_quality(spark, data):
    import zlib

    docs, labels = data
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    some = accuracy(rows, labels, "quality", lambda d: zlib.crc32(str(d).encode()) % 3 == 1)
    assert len(some) > 80 and np.mean([(s >= 0.5) == t for s, t in some]) > 0.97
    assert len({r.score for r in rows if r.doc_id in (7, 8)}) == 1
    assert {r.n_passages for r in rows if r.doc_id in (2, 3, 4)} == {1}


def test_toxicity_query_equals_plain_python(spark, data, tmp_path):
    """The registered query against sentences, logistic scores and noisy-or written out."""
    import math
    import re
    import zlib

    from blockmill.llm import queries

    docs, labels = data
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)

    def plain(text):
        clean, n = 1 - model.leak, 0
        for sentence in re.split(r"(?<=[.!?])(?![.!?])|\n", text or ""):
            held = {w for w in re.findall(r"[^\W\d_]+", sentence.lower()) if w in model.terms}
            if held:
                p = 1 / (1 + math.exp(-(model.bias + sum(model.weights[model.terms[w]] for w in held))))
                clean, n = clean * (1 - p), n + (p >= 0.5)
        return 1 - clean, n

    rows = sorted(queries.op6_noisy_or_toxicity(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id or 0, r.score))
    want = sorted(((r.doc_id or 0, *plain(r.text)) for r in docs.collect()))
    assert [r.score for r in rows] == pytest.approx([s for _, s, _ in want], abs=1e-9)
    assert [(r.doc_id or 0, r.n_offending, r.predicted) for r in rows] == [(d, n, int(s >= 0.3)) for d, s, n in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)


def test_quality_query_equals_plain_python(spark, data, tmp_path):
    """The registered query against passages, features, attention and score written out."""
    import math

    from blockmill.llm import queries

    docs, labels = data
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    p = {k: v.tolist() for k, v in model.params.items()}
    kinds = quality.CLASSES.tolist()
    dot = lambda v, m, k: sum(a * row[k] for a, row in zip(v, m))
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def features(raw, words, more):
        pairs = [0] * 144
        for a, b in zip(raw, raw[1:]):
            pairs[kinds[a] * 12 + kinds[b]] += 1
        total = max(sum(pairs), 1)
        tail = [sum(a == b for a, b in zip(words, words[1:])) / len(words), len(set(words)) / len(words), sum(map(len, words)) / len(words) / 10, math.log1p(len(words)) / 5]
        return [math.sqrt(n / total) for n in pairs] + tail

    def plain(text):
        raw = (text or "").encode().strip()
        words = raw.split()
        if not words:
            bags = [[0.0] * 148]
        else:
            bags, at, starts = [], 0, []
            for w in words:
                at = raw.index(w, at)
                starts.append(at)
                at += len(w)
            for k in range(0, len(words), 64):
                # a passage's pairs start inside it; the last one of each reaches the next passage's first byte
                end = starts[k + 64] + 1 if k + 64 < len(words) else len(raw)
                bags.append(features(raw[starts[k] : end], words[k : k + 64], None))
        hs, es = [], []
        for x in bags:
            x = [max(-6.0, min(6.0, (np.float32(a) - m) / s)) for a, m, s in zip(x, model.mean, model.scale)]
            h = [math.tanh(dot(x, p["W"], k) + p["b"][k]) for k in range(16)]
            gate = [math.tanh(dot(h, p["V"], k)) * sigmoid(dot(h, p["U"], k)) for k in range(8)]
            hs.append(h)
            es.append(math.exp(max(-20.0, min(20.0, sum(g * s for g, s in zip(gate, p["s"]))))))
        z = [sum(e / sum(es) * h[k] for e, h in zip(es, hs)) for k in range(16)]
        return sigmoid(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0]), len(bags)

    some = [r for r in docs.collect() if r.doc_id is not None and (r.doc_id < 10 or r.doc_id % 5 == 0)]
    rows = {r.doc_id: r for r in queries.op3_attention_quality(spark, str(tmp_path)).collect()}
    for r in some:
        score, n = plain(r.text)
        assert rows[r.doc_id].score == pytest.approx(score, abs=1e-4) and rows[r.doc_id].n_passages == n


def test_a_bounded_number_of_passages_teaches(spark, data, monkeypatch):
    docs, labels = data
    model = quality.fit_quality(docs, labels, most_passages=1, epochs=2)
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).collect())


def test_gradient_of_attention():
    rng = np.random.default_rng(0)
    x, bag, y = rng.normal(0, 1, (9, 5)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    f = lambda *s: rng.normal(0, 0.7, s)
    model = quality.QualityModel(np.zeros(5), 1.0, {"W": f(5, 4), "b": f(4), "V": f(4, 3), "U": f(4, 3), "s": f(3), "c": f(4), "d": f(1)})
    w = np.ones(4)

    def loss():
        p = model.forward(x, bag, 4)["y"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = model.gradient(model.forward(x, bag, 4), bag, y, w)
    for name, p in model.params.items():
        for at in np.ndindex(p.shape):
            kept = p[at]
            p[at] = kept + 1e-6
            up = loss()
            p[at] = kept - 1e-6
            down = loss()
            p[at] = kept
            assert grad[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_features_of_a_text_are_its_own():
    texts = ["a b c. D e!", "", None, " \n ", "x " * 200, "é | ü #1", "a b c. D e!"]
    x, of = quality.passage_features(texts)
    assert sorted(set(of)) == list(range(7)) and (of == 4).sum() == 4
    for k, t in enumerate(texts):
        alone, _ = quality.passage_features([t])
        assert np.array_equal(x[of == k], alone)


def test_no_labels_and_no_rows(spark, data):
    docs, labels = data
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score_quality(docs.limit(3), None).collect()} == {0.5}
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs.limit(3), model).collect()} == {0.0}
    assert toxicity.score_toxicity(nothing(spark), model).count() == 0
    assert quality.score_quality(nothing(spark), None).count() == 0
    assert quality.fit_quality(nothing(spark), labels) is None
