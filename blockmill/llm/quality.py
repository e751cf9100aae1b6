"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by how its bytes' classes follow
each other and how its words repeat; a gated attention weighs the passages, and the weighted passage
representation is scored. All weights are learned from document labels.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockmill.llm.common import schema_with, sub_batches, trimmed
from blockmill.llm.labelled import training_sample

#: Words of a passage; labelled documents and passages of each (spread over the whole text) to learn from.
PASSAGE_WORDS, MOST_LABELLED, MOST_PASSAGES = 64, 4_000, 64
_CLASSES = 12


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 11, np.uint8)  # control characters
    for k, chars in enumerate((" \t\x0b\x0c\r", "\n", string.ascii_lowercase, string.ascii_uppercase, string.digits, ".,", "!?", ";:'\"()-", "|", "")):
        kind[list(chars.encode())] = k
    for c in set(string.punctuation) - set(".,!?;:'\"()-|"):
        kind[ord(c)] = 9
    kind[128:] = 10
    return kind


CLASSES = _byte_classes()
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
N_FEATURES = _CLASSES * _CLASSES + 4


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document number) of each passage; a text without words has one passage of zeros."""
    raw = [(t or "").encode().strip() for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    begin = np.cumsum([1, *[len(r) + 1 for r in raw]])[: len(raw)]
    space = _SPACE[buf]
    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    last = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    doc = np.searchsorted(begin, first, "right") - 1
    n_words = np.bincount(doc, minlength=len(raw))
    nth = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    opens = nth % PASSAGE_WORDS == 0
    passage = np.cumsum(opens) - 1
    heads, owner = first[opens], doc[opens]
    n = len(heads)
    out = np.zeros((n, N_FEATURES), np.float32)
    if n:
        kind = CLASSES[buf].astype(np.int32)
        spread = np.zeros(len(buf), np.int32)
        spread[heads] = 1
        at = np.cumsum(spread)[:-1] - 1
        ends = np.r_[begin[1:] - 1, len(buf) - 1]
        ok = at >= 0
        ok[ends[:-1]] = ok[ends - 1] = False  # only pairs inside a text
        pairs = np.bincount((at * _CLASSES**2 + kind[:-1] * _CLASSES + kind[1:])[ok], minlength=n * _CLASSES**2).reshape(n, -1)
        out[:, : _CLASSES**2] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
        words = np.fromiter(map(hash, buf.tobytes().split()), np.int64, len(first))
        size = np.bincount(passage, minlength=n)
        same = np.r_[False, (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])]
        order = np.lexsort((words, passage))
        new = np.r_[True, (words[order][1:] != words[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
        out[:, -4] = np.bincount(passage, same, n) / size
        out[:, -3] = np.bincount(passage[order], new, n) / size
        out[:, -2] = np.bincount(passage, last - first, n) / size / 10
        out[:, -1] = np.log1p(size) / 5
    empty = np.flatnonzero(n_words == 0)
    return np.concatenate([out, np.zeros((len(empty), N_FEATURES), np.float32)]), np.concatenate([owner, empty])


@dataclass
class QualityModel:
    """h = tanh(xW + b); a = softmax_bag(s . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum(a h) + d)."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.params
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = np.exp(np.clip((t * g) @ p["s"], -20, 20))
        a = e / np.bincount(bag, e, n)[bag]
        z = np.stack([np.bincount(bag, a * h[:, k], n) for k in range(h.shape[1])], 1)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y}

    def gradient(self, f: dict[str, np.ndarray], bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, h, t, g, a = self.params, f["h"], f["t"], f["g"], f["a"]
        dy = (f["y"] - y) * weight / weight.sum()
        dz = np.outer(dy, p["c"])
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.bincount(bag, a * da, len(y))[bag])
        dt, dg = np.outer(de, p["s"]) * g * (1 - t * t), np.outer(de, p["s"]) * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "s": (t * g).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, most_labelled: int = MOST_LABELLED, most_passages: int = MOST_PASSAGES, epochs: int = 40, width: int = 16, seed: int = 5) -> QualityModel | None:
    """A model from at most most_labelled labelled rows and most_passages passages of each, evenly spread
    over its text, so the driver holds a bounded number of features; None if the rows don't hold both
    labels. Scoring takes all passages.
    """
    sample = training_sample(docs, labels, label, modulus, held_out, most_labelled)

    def features(batches):
        for b in batches:
            texts, given = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in sub_batches(texts):
                x, of = passage_features(texts[i:j])
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(j - i + 1))
                own = [order[cuts[k] : cuts[k + 1]] for k in range(j - i)]
                some = [o if len(o) <= most_passages else o[np.arange(most_passages) * len(o) // most_passages] for o in own]
                yield pa.RecordBatch.from_arrays([pa.array([x[o].tobytes() for o in some], pa.binary()), pa.array(given[i:j], pa.int32())], names=["passages", "label"])

    rows = sample.orderBy("doc_id").select("text", "label").mapInArrow(trimmed(features), "passages binary, label int").collect()
    y = np.array([r["label"] > 0 for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = [np.frombuffer(r["passages"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    every = np.concatenate(x)
    rng = np.random.default_rng(seed)
    f = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    model = QualityModel(every.mean(0), every.std(0) + 0.02, {"W": f(N_FEATURES, width), "b": np.zeros(width), "V": f(width, 8), "U": f(width, 8), "s": f(8), "c": f(width), "d": np.zeros(1)})
    m, v, step = {k: 0 * p for k, p in model.params.items()}, {k: 0 * p for k, p in model.params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), 128):
            part, step = order[i : i + 128], step + 1
            bag = np.repeat(np.arange(len(part)), [len(x[k]) for k in part])
            grad = model.gradient(model.forward(np.concatenate([x[k] for k in part]), bag, len(part)), bag, y[part], np.ones(len(part)))
            for k, p in model.params.items():
                d = grad[k] + 1e-4 * p
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                model.params[k] = p - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """docs with score, n_passages and attention (the largest passage weight).

    Null and empty texts are one passage without words. Without a model every score is 0.5. Columns
    of docs with these names are replaced; every row of docs gives one row.
    """
    new = ("score", "n_passages", "attention")
    carry = [c for c in docs.columns if c not in new]
    shared, at = docs.sparkSession.sparkContext.broadcast(model), carry.index("text")

    def score(batches):
        fitted = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, j in sub_batches(texts):
                x, bag = passage_features(texts[i:j])
                f = fitted.forward(x, bag, j - i) if fitted else {"y": np.full(j - i, 0.5), "a": np.ones(len(bag))}
                most = np.zeros(j - i)
                np.maximum.at(most, bag, f["a"])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(f["y"]), pa.array(np.bincount(bag, minlength=j - i)), pa.array(most)], names=[*carry, *new])

    return docs.select(*[f"`{c}`" for c in carry]).mapInArrow(trimmed(score), schema_with(docs, carry, "score double, n_passages long, attention double"))
