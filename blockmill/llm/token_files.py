"""Token ids as a content-addressed binary store in document order."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.llm.chunk_store import Cutting, chunk_rows, read_store, write_store
from blockmill.llm.common import discard, written
from blockmill.llm.prefix import sums_before
from blockmill.llm.tokens import encoder

CUTTING = Cutting(window=8, bits=9, least=64, most=4_096)


def vocabulary(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> tuple[str, str]:
    """Encode every text of docs (null: empty), append end_id, and write the ids as a store.

    Returns the store's path and the type of its units: unsigned 16-bit little-endian ids if the
    vocabulary allows, else 32-bit. Recipes stand in ascending doc_id order, repeated rows side by side.
    """
    kind = "<u2" if max(vocabulary(tokenizer_path), end_id + 1) <= 1 << 16 else "<u4"

    def encode(texts):
        ends = np.array([end_id], kind)
        return [(b"", np.concatenate([ids.astype(kind), ends])) for ids in encoder(tokenizer_path).encode([t or "" for t in texts])]

    rows = written(chunk_rows(docs, encode, CUTTING), "token-rows", "none")  # encoded once
    path = write_store(docs.sparkSession, rows, rows, "tokens", ordered=True)
    discard(rows)
    return path, kind


def read_tokens(spark, path: str, kind: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the verified ids.

    start is the number of ids of all documents before it, n_tokens counts the end id, ids_crc32 is
    over the ids as little-endian unsigned 32-bit integers.
    """

    def measure(head: bytes, payload: bytes) -> tuple[int, int]:
        ids = np.frombuffer(payload, kind)
        return len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    read = read_store(spark, path, measure, "n_tokens long, ids_crc32 long").drop("size")
    return sums_before(written(read, "token-sums"), ["doc_id", "row_id"], "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def tokens_of(spark, path: str, kind: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32 bit) of each stored document."""
    recoded = read_store(spark, path, lambda head, payload: (np.frombuffer(payload, kind).astype("<u4").tobytes().hex(),), "ids string")
    return recoded.select("doc_id", F.unhex("ids").alias("ids"))
