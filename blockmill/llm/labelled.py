"""The labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.llm.common import id_crc, written


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` labelled documents, chosen by hash, as a written table.

    Only rows whose crc32(doc_id as text) mod modulus is not held_out take part. Null ids and null
    labels don't; of several labels of a document the largest counts, of several rows any one.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_crc(F.col("doc_id")) % modulus != held_out))
    picked = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return written(found.groupBy("doc_id").agg(F.first("text").alias("text"), F.first("_label").alias("label")), "labelled")
