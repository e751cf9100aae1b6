"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from blockmill.llm import jaccard, licenses, media, mixing, neighbours, ngram_lm, packing, quality, token_files, toxicity
from blockmill.llm.common import id_crc, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _decided(scored: DataFrame, held_out, least: float, *more: str) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *more)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, kind = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_files.read_tokens(spark, path, kind)


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), neighbours.fit_partitions(vectors))


def op3_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return _decided(quality.score_quality(docs.select("doc_id", "text"), model), id_crc(F.col("doc_id")) % 3 == 1, 0.5, "n_passages")


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(spark, media.write_media(table(spark, sf_dir, "documents")))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_crc(F.col("doc_id")) % 7 == 2, F.lit(False))
    model = ngram_lm.fit_ngrams(docs.where(~held_out), order=3)
    scored = ngram_lm.score_ngrams(docs.withColumn("held_out", held_out), model)
    return scored.withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def op6_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model).withColumn("n_offending", F.size("offending"))
    return _decided(scored, id_crc(F.col("doc_id")) % 4 == 2, 0.3, "n_offending")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_pack_min_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from blockmill.llm import oracles

    return {k: v for k, v in vars(oracles).items() if k.startswith("op")}
