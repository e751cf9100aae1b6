"""Media columns: texts as 8-bit samples in cut, deduplicated and verified chunks.

A payload's stored form is an 8-bit mono wave file: a head of 44 bytes, kept in the recipe, and the
samples, kept as content-defined chunks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from blockmill.llm.chunk_store import Cutting, chunk_rows, cutter, id_and_text, read_store, write_store

CUTTING = Cutting(window=16, bits=11, least=256, most=16_384)
RATE, UNIT = 8_000, 64


def wave_head(n: int) -> bytes:
    """The head of an 8-bit mono wave file of n samples (n is even, so no pad byte follows)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n & 0xFFFFFFFF)


def _payloads(texts):
    out = []
    for t in texts:
        raw = (t or "").encode()
        raw += bytes(-len(raw) % UNIT if raw else UNIT)
        out.append((wave_head(len(raw)) + struct.pack("<q", len((t or "").encode())), np.frombuffer(raw, np.uint8)))
    return out


def feature(samples: np.ndarray) -> str:
    """Sum, energy, sign changes around 128, and the most frequent sample, as whole numbers."""
    counts = np.bincount(samples, minlength=256)
    value = np.arange(256)
    over = samples > 127
    return f"sum={int(counts @ value)};energy={int(counts @ (value - 128) ** 2)};changes={int((over[1:] != over[:-1]).sum())};mode={int(counts.argmax())}"


def write_media(docs: DataFrame) -> str:
    """Store every text of docs (null: empty) as a payload and return the store's path.

    A text is cut anew for each pass over it, which costs less than keeping all payloads twice.
    """
    return write_store(docs.sparkSession, id_and_text(docs), chunk_rows(docs, _payloads, CUTTING, bodies=False), "media", first=cutter(_payloads, CUTTING))


def read_media(spark, path: str) -> DataFrame:
    """Each stored document's sizes, hashes and feature, from the bytes read back and verified."""

    def measure(head: bytes, payload: bytes) -> tuple:
        wave, (n,) = head[:44], struct.unpack("<q", head[44:])
        whole = hashlib.sha256(wave)
        whole.update(payload)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wave) + len(payload), whole.hexdigest(), feature(np.frombuffer(payload, np.uint8))

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_store(spark, path, measure, schema).drop("row_id", "size")
