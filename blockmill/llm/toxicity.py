"""Toxicity by multiple-instance learning: sentences are scored, a noisy-or joins them.

A document is toxic if one of its sentences is: P(doc) = 1 - (1 - leak) * prod(1 - p_s). p_s is a
logistic function of the terms that a sentence holds; a sentence without any known term has p_s = 0,
so that length alone raises nothing; leak is the rate of labels that no term explains. Weights are
learned from document labels alone, by gradients through the noisy-or; the terms are found in Spark.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.llm.common import schema_with, trimmed
from blockmill.llm.labelled import training_sample

WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+[.!?]*")
MOST_LABELLED = 20_000


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    weights: np.ndarray
    bias: float
    leak: float

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence that holds a known term."""
        out = []
        if self.terms and not self.terms.keys().isdisjoint(WORDS.findall(text.lower())):
            for m in SENTENCES.finditer(text):
                if known := {self.terms[w] for w in WORDS.findall(m[0].lower()) if w in self.terms}:
                    out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.weights[list(known)].sum())))))))
        return out

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        clean = 1 - self.leak
        for *_, p in sentences:
            clean *= 1 - p
        return 1 - clean


def _terms(sample: DataFrame, least_g: float, least_seen: int) -> list[str]:
    """The words that toxic documents hold more often than chance allows (signed root of G squared).

    Positive evidence counts the documents that are the first to hold the word after some left
    neighbour, so the copies and near copies of one document count once.
    """

    def split(batches):
        for b in batches:
            for doc, text, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = WORDS.findall(text.lower())
                pairs = set(zip(words, ["", *words], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(pairs), pa.int64()), pa.array([w for w, _ in pairs], pa.string()), pa.array([x for _, x in pairs], pa.string()), pa.array([label] * len(pairs), pa.int32())], names=["doc", "word", "left", "label"])

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = float(n.get(1, 0)), float(n.get(0, 0))
    if not toxic or not clean:
        return []
    words = sample.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(trimmed(split), "doc long, word string, left string, label int")
    often = words.where("label = 1").groupBy("word", "left").agg(F.min("doc").alias("first")).groupBy("word").agg(F.countDistinct("first").alias("p")).where(F.col("p") >= least_seen)
    other = words.where("label = 0").groupBy("word").agg(F.countDistinct("doc").alias("n"))
    both = often.join(other, "word", "left").select("word", F.col("p").cast("double"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    seen, total = F.col("p") + F.col("n"), toxic + clean
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(F.col("p"), seen * toxic / total) + part(F.col("n"), seen * clean / total) + part(toxic - F.col("p"), toxic * (total - seen) / total) + part(F.greatest(clean - F.col("n"), F.lit(0.0)), clean * (total - seen) / total))
    g = F.when(F.col("p") * clean > F.col("n") * toxic, F.sqrt(F.greatest(g2, F.lit(0.0)))).otherwise(0.0)
    return [r["word"] for r in both.withColumn("g", g).where(F.col("g") >= least_g).orderBy(F.desc("g"), "word").collect()]  # of a bounded sample's words


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held_out: int = 2, most_labelled: int = MOST_LABELLED, least_g: float = 4.5, least_seen: int = 4, steps: int = 300) -> ToxicityModel:
    """A model from at most most_labelled labelled rows; without toxic and clean ones, one that scores 0."""
    sample = training_sample(docs, labels, label, modulus, held_out, most_labelled)
    terms = {w: k for k, w in enumerate(_terms(sample, least_g, least_seen))}
    blank = ToxicityModel(terms, np.zeros(len(terms)), 0.0, 0.0)
    if not terms:
        return blank

    def instances(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                found = [sorted({terms[w] for w in WORDS.findall(m[0].lower()) if w in terms}) for m in SENTENCES.finditer(text)] if not terms.keys().isdisjoint(WORDS.findall(text.lower())) else []
                rows.append([x for x in found if x])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.list_(pa.int32()))), b.column(1)], names=["bags", "label"])

    rows = sample.select("text", "label").mapInArrow(trimmed(instances), "bags array<array<int>>, label int").collect()
    y = np.array([r["label"] > 0 for r in rows], float)
    bag = np.array([k for k, r in enumerate(rows) for _ in r["bags"]], int)
    sentence = np.array([i for i, s in enumerate(s for r in rows for s in r["bags"]) for _ in s], int)
    term = np.array([t for r in rows for s in r["bags"] for t in s], int)
    w, b, z = np.zeros(len(terms)), -1.0, math.log(0.02)
    m, v, rate = np.zeros(len(terms) + 2), np.zeros(len(terms) + 2), 0.1
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(sentence, w[term], len(bag)), -30, 30)))
        leak = math.exp(z)
        log_clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + math.log1p(-leak)
        toxic = np.maximum(-np.expm1(log_clean), 1e-9)
        # d loss / d log_clean: clean documents pay for mass, toxic ones for the lack of it
        d = np.where(y > 0, np.exp(log_clean) / toxic, -1.0) / len(y)
        ds = d[bag] * -p
        grad = np.concatenate([np.bincount(term, ds[sentence], len(w)) + 1e-4 * w, [ds.sum()], [(d * -leak / (1 - leak)).sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b, z = w - move[:-2], b - move[-2], min(max(z - move[-1], math.log(1e-4)), math.log(0.1))
    return ToxicityModel(terms, w, float(b), math.exp(z))


def score_toxicity(docs: DataFrame, model: ToxicityModel, located: float = 0.5) -> DataFrame:
    """docs with score and offending: the sentences (start, end, probability, text) of at least `located`.

    Null and empty texts have no sentence and score the leak. Columns of docs with these names are
    replaced; every row of docs gives one row.
    """
    spark = docs.sparkSession
    carry = [c for c in docs.columns if c not in ("score", "offending")]
    shared, at = spark.sparkContext.broadcast(model), carry.index("text")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("text", pa.string())])

    def score(batches):
        fitted = shared.value
        for b in batches:
            scores, spans = [], []
            for text in b.column(at).to_pylist():
                found = fitted.sentences(text or "")
                scores.append(fitted.score(found))
                spans.append([{"start": i, "end": j, "probability": p, "text": text[i:j]} for i, j, p in found if p >= located])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=[*carry, "score", "offending"])

    return docs.select(*[f"`{c}`" for c in carry]).mapInArrow(trimmed(score), schema_with(docs, carry, "score double, offending array<struct<start:int,end:int,probability:double,text:string>>"))
