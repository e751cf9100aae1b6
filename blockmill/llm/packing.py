"""Packing token pieces into fixed windows by minimum bin slack.

Only the histogram of piece lengths (at most one row a length) reaches the driver. There, for the
longest length left, a subset-sum bit set over the lengths left finds the multiset that comes closest
to the rest of the window; the counts are read back from the steps of the bit set, and the same
multiset is used as often as the histogram allows. Each such pattern uses up a length nearly always,
so the number of patterns follows the number of lengths, not the number of documents. Spark then ranks
the pieces of a length (in hash ranges, so that a length that a third of all pieces have is no single
task) and a piece's rank gives its sequence and place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockmill.llm.common import schema_with, sub_batches, trimmed, written
from blockmill.llm.tokens import encoder

PIECES_PER_RANGE = 500
#: Words whose ids a worker keeps; packing has CPU time to spare, but follows stages that fill memory.
KEPT_WORDS = 500_000
_HELPERS = ("_ranges", "_range", "_n", "_begin", "_rank")
_PIECE = "doc_id long, piece_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, with_ids: bool = False) -> DataFrame:
    """Each row of docs encoded, ended by end_id and cut every window ids: one row a piece.

    Null text counts as empty (the end id alone). piece_id tells repeated rows apart. With with_ids,
    ids (binary, little-endian unsigned 32 bit) comes along.
    """

    def cut(batches):
        part, n, coder = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, KEPT_WORDS)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in sub_batches(texts, 1_000_000):
                out: list[tuple] = []
                for key, ids in zip(keys[i:j], coder.encode([t or "" for t in texts[i:j]]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        raw = ids[at : at + window].tobytes()
                        out.append((key, (part << 40) + n, at, len(raw) // 4, zlib.crc32(raw), len(ids), *([raw] if with_ids else [])))
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 6 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))], names=names)

    names = [x.split()[0] for x in _PIECE.split(", ")] + ["ids"] * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(trimmed(cut), _PIECE + ", ids binary" * with_ids)


def slack_patterns(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: count}) that use up counts, each multiset at most window long."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    if any(not 0 < n <= window for n in left):
        raise ValueError("a length is outside the window")
    out = []
    while left:
        first = next(iter(left))
        room = window - first
        goal, mask = 1 << room, (1 << room + 1) - 1
        reach, steps = 1, []
        for n, have in left.items():
            have -= n == first
            if n > room or not have:
                continue
            k = 1
            while have and k * n <= room:  # binary parts of the multiplicity
                k = min(k, have)
                steps.append((n, k, reach))
                reach |= reach << (k * n) & mask
                have, k = have - k, 2 * k
            if reach & goal:
                break
        total, used = reach.bit_length() - 1, {first: 1}
        for n, k, before in reversed(steps):
            if not before >> total & 1:
                total -= k * n
                used[n] = used.get(n, 0) + k
        times = min(left[n] // c for n, c in used.items())
        out.append((times, used))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return out


def pack(pieces: DataFrame, window: int = 4096, pieces_per_range: int = PIECES_PER_RANGE) -> DataFrame:
    """pieces (length long, piece_id long, any more) with sequence_id and offset.

    Every piece gets a place; a sequence's pieces lie gapless from 0. Equal input, equal output. An
    empty table gives an empty table. pieces is read twice: give a written table. Columns named like
    the two new ones or the helpers (_ranges, _range, _n, _begin, _rank) don't come along.
    """
    spark, carry = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset", *_HELPERS)]
    pieces = pieces.select(*carry)
    histogram = dict(pieces.groupBy("length").count().collect())  # at most window rows
    starts, rows, base = dict.fromkeys(histogram, 0), [], 0
    for times, used in slack_patterns(histogram, window):
        offset = 0
        for n, c in used.items():
            rows.append((n, starts[n], c, base, offset))
            starts[n] += c * times
            offset += n * c
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5).T
    slots = spark.sparkContext.broadcast((table[0] * (1 << 44) + table[1], table))

    sizes = pieces.groupBy("length").count().select("length", F.ceil(F.col("count") / F.lit(pieces_per_range)).alias("_ranges"))
    dealt = pieces.join(F.broadcast(sizes), "length").withColumn("_range", F.pmod(F.xxhash64("piece_id"), F.col("_ranges")))
    begin = dealt.groupBy("length", "_range").agg(F.count("*").alias("_n")).select("length", "_range", (F.sum("_n").over(W.partitionBy("length").orderBy("_range")) - F.col("_n")).alias("_begin"))
    ranked = dealt.join(begin, ["length", "_range"]).withColumn("_rank", F.col("_begin") + F.row_number().over(W.partitionBy("length", "_range").orderBy("piece_id")) - 1)

    def place(batches):
        keys, (_, first, count, base, offset) = slots.value[0], slots.value[1]
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64) for c in ("length", "_rank"))
            k = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
            nth = rank - first[k]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(base[k] + nth // count[k]), pa.array(offset[k] + nth % count[k] * length)], names=[*carry, "sequence_id", "offset"])

    return ranked.select(*carry, "_rank").mapInArrow(trimmed(place), schema_with(pieces, carry, "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) encoded, cut and packed; the pieces are written once to the shared folder.
    With with_ids each row has its piece's ids (see token_pieces), so a sequence is its rows by offset."""
    return pack(written(token_pieces(docs, tokenizer_path, end_id, window, with_ids), "pieces"), window).drop("piece_id")
