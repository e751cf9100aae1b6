"""From raw documents to packed training sequences.

Five stages, each an operator of blockmill.llm working on all that its predecessor kept: toxic
documents go, documents of low quality go, one document of each group of near copies stays, sources
are mixed to their weights, and the mix is packed. run() writes each stage's rows to the shared
folder and reads them again, so a lost executor costs no more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm import jaccard, mixing, packing, quality, toxicity
from blockmill.llm.common import around, discard, table, temporary, written
from blockmill.llm.queries import tokenizer_path

TOXIC, GOOD = 0.3, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is under TOXIC."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return around(docs, lambda rows: toxicity.score_toxicity(rows, model).where(F.col("score") < TOXIC))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD; all of them where no model can be fitted."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return around(docs, lambda rows: quality.score_quality(rows, model).where(F.col("score") >= GOOD))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets are linked by a Jaccard index of 0.8."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeats included."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their token ids and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", keep_one_copy), ("mixing", mix), ("packing", pack)]

#: Learned scores decide what stays, which SQL can't express; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with temporary() as kept:  # a stage's own tables go with it
            docs = kept(written(stage(spark, before, sf_dir), f"pipeline-{name}"))
        if hasattr(before, "_written"):
            discard(before)
    return docs
