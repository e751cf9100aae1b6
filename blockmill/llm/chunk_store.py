"""A content-addressed store of cut payloads.

A payload is cut where a rolling hash of its last units says so, so that shared stretches give equal
chunks wherever they stand. Chunks are named by their sha256; a document's recipe lists its chunks in
order, and the Merkle root of the names is its manifest. Chunks that occur once are kept in the row of
their document, chunks that may occur again are kept once in a table by name, and reading puts them
together and verifies every name and every root.

Which chunks may occur again is told by a bit field of fixed size, filled in Spark from the names that
more than one place has. Its false alarms only send a chunk to the table, so it is exact at any size:
beyond some tens of millions of repeated chunks it fills up and every chunk goes to the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm.common import new_path, spread_join, sub_batches, trimmed, written

FIELD_BITS = 24
#: Chunks (of at most some ten kB) that are fetched by broadcast because very many places have them.
MOST_HOT = 2_000
#: Compression of chunks: higher levels hardly make them smaller.
LEVEL = 5
_RECIPE = "doc_id long, row_id long, size long, head binary, root binary, lengths array<int>, names array<binary>, slots array<long>, held array<boolean>, body binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
_FIELDS = [x.split()[0] for x in _RECIPE.split(", ")]

#: Turns texts into (head, payload) pairs; a payload is an array of whole units.
Encode = Callable[[list], list[tuple[bytes, np.ndarray]]]


@dataclass(frozen=True)
class Cutting:
    """Cuts after a unit whose window hash ends in `bits` zeros, chunks being least to most units long."""

    window: int = 16
    bits: int = 11
    least: int = 256
    most: int = 16_384

    def cuts(self, units: np.ndarray) -> list[int]:
        """End positions of the chunks; none for no units."""
        n = len(units)
        h = _scramble(units)
        span = 1
        while span < self.window:  # h[i] covers the last span units, each shifted once per step (gear hash)
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        ends, last = [], 0
        for c in np.flatnonzero(h >> np.uint32(32 - self.bits) == 0) + 1:
            while c - last > self.most:
                last += self.most
                ends.append(last)
            if c - last >= self.least:
                ends.append(int(c))
                last = int(c)
        while n - last > self.most:
            last += self.most
            ends.append(last)
        return ends + [n] if last < n else ends


_GEAR = (np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint64)).astype(np.uint32)


def _scramble(units: np.ndarray) -> np.ndarray:
    if units.dtype == np.uint8:
        return _GEAR[units]
    h = units.astype(np.uint32) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)


def merkle_root(names: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd one goes up as it is. Of no names: the hash of nothing."""
    if not names:
        return hashlib.sha256(b"").digest()
    while len(names) > 1:
        names = [hashlib.sha256(b"".join(names[i : i + 2])).digest() if i + 1 < len(names) else names[i] for i in range(0, len(names), 2)]
    return names[0]


def _slot(name: bytes) -> int:
    return int.from_bytes(name[:8], "big", signed=True)


def cutter(encode: Encode, cutting: Cutting, bodies: bool = True) -> Callable:
    """Arrow batches of doc_id and text to batches of recipes, with all chunks in body."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, press = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in sub_batches(texts):
                rows = []
                for doc, (head, units) in zip(ids[i:j], encode(texts[i:j]), strict=True):
                    raw, width = units.tobytes(), units.itemsize
                    ends = [e * width for e in cutting.cuts(units)]
                    names = [hashlib.sha256(raw[s:e]).digest() for s, e in zip([0, *ends], ends, strict=False)]
                    rows.append((doc, (part << 40) + n, len(raw), head, merkle_root(names), np.diff([0, *ends]).tolist(), names, [_slot(x) for x in names], [True] * len(names), press.compress(raw) if bodies else None))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_FIELDS)

    return cut


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def chunk_rows(docs: DataFrame, encode: Encode, cutting: Cutting, bodies: bool = True) -> DataFrame:
    """A row for each row of docs (doc_id, text): its recipe."""
    return id_and_text(docs).mapInArrow(trimmed(cutter(encode, cutting, bodies)), _RECIPE)


def repeated_field(rows: DataFrame) -> np.ndarray:
    """The bit field of the slots that occur more than once; 2**FIELD_BITS bits at any input."""
    bit = F.col("slot").bitwiseAND(F.lit((1 << FIELD_BITS) - 1))
    again = rows.select(F.explode("slots").alias("slot")).groupBy("slot").count().where("count > 1")
    words = again.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    found = words.toArrow()  # at most 2**(FIELD_BITS - 6) rows
    field = np.zeros(1 << FIELD_BITS - 6, np.int64)
    field[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return field


def _may_repeat(field: np.ndarray, slots: list[int]) -> np.ndarray:
    at = np.array(slots, np.int64) & ((1 << FIELD_BITS) - 1)
    return (field[at >> 6] >> (at & 63)) & 1 == 1


def _pieces(raw: bytes, lengths: list[int]) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def write_store(spark: SparkSession, rows: DataFrame, counted: DataFrame, name: str, ordered: bool = False, first: Callable | None = None) -> str:
    """Write rows (chunk_rows) as a store and return its path: recipes/ and chunks/.

    counted is the same rows, of which only slots are read. With first (a cutter), rows are what it
    takes, and it runs in the same Python workers. With ordered, the recipes' files and rows
    are in ascending doc_id order, null ids first.
    """
    path, field = new_path(spark, name), spark.sparkContext.broadcast(repeated_field(counted))

    def hold(batches):
        press, loose = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            slots, lengths, bodies = (b.column(_FIELDS.index(c)).to_pylist() for c in ("slots", "lengths", "body"))
            held, kept = [], []
            for s, n, body in zip(slots, lengths, bodies, strict=True):
                away = _may_repeat(field.value, s)
                held.append((~away).tolist())
                kept.append(press.compress(b"".join(x for x, gone in zip(_pieces(loose.decompress(body), n), away, strict=True) if not gone)) if away.any() else body)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(held, pa.list_(pa.bool_())), pa.array(kept, pa.binary())], names=_FIELDS)

    def shared(batches):
        press, loose = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for b in batches:
            slots, names, lengths, bodies = (b.column(_FIELDS.index(c)).to_pylist() for c in ("slots", "names", "lengths", "body"))
            out: dict[bytes, bytes] = {}
            for s, name, n, body in zip(slots, names, lengths, bodies, strict=True):
                away = _may_repeat(field.value, s)
                if away.any():
                    out |= {k: x for k, x, gone in zip(name, _pieces(loose.decompress(body), n), away, strict=True) if gone and k not in out}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array([press.compress(x) for x in out.values()], pa.binary())], names=["name", "chunk"])

    recipes = rows.repartitionByRange("doc_id", "row_id").sortWithinPartitions("doc_id", "row_id") if ordered else rows
    before = first or (lambda batches: batches)
    recipes.mapInArrow(trimmed(lambda batches: hold(before(batches))), _RECIPE).write.option("compression", "none").parquet(f"{path}/recipes")
    rows.mapInArrow(trimmed(lambda batches: shared(before(batches))), "name binary, chunk binary").groupBy("name").agg(F.first("chunk").alias("chunk")).write.option("compression", "none").parquet(f"{path}/chunks")
    return path


def read_store(spark: SparkSession, path: str, measure: Callable[[bytes, bytes], tuple], schema: str) -> DataFrame:
    """doc_id, row_id, size and what measure(head, payload) gives (named and typed by schema), for each
    stored document. A chunk that isn't what its name says, and a recipe that doesn't match its root,
    fail the read."""
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    chunks = spark.read.schema("name binary, chunk binary").parquet(f"{path}/chunks")
    whole = ~F.exists("held", lambda x: ~x)
    kinds = [(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (x.split() for x in schema.split(", "))]

    def build(batches):
        loose = zstandard.ZstdDecompressor()
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("doc_id", "row_id", "size", "head", "root", "lengths", "names", "held", "body", "others")}
            for i in range(0, b.num_rows, 256):
                out = []
                for doc, row, size, head, root, lengths, names, held, body, others in zip(*(c[i : i + 256] for c in col.values()), strict=True):
                    own = iter(_pieces(loose.decompress(body), [n for n, h in zip(lengths, held, strict=True) if h]))
                    away = {x["at"]: x["chunk"] for x in others or ()}
                    parts = [next(own) if h else loose.decompress(away[k]) for k, h in enumerate(held)]
                    if [hashlib.sha256(x).digest() for x in parts] != names or merkle_root(names) != root:
                        raise ValueError(f"document {doc}: its chunks don't match its manifest")
                    payload = b"".join(parts)
                    if len(payload) != size:
                        raise ValueError(f"document {doc}: {len(payload)} bytes instead of {size}")
                    out.append((doc, row, size, *measure(head, payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [k for _, k in kinds], strict=True)], names=["doc_id", "row_id", "size", *[n for n, _ in kinds]])

    none = F.lit(None).cast("array<struct<at:int,chunk:binary>>")
    asked = recipes.where(~whole).select("row_id", F.posexplode(F.arrays_zip("names", "held")).alias("at", "x")).where("not x.held").select("row_id", "at", F.col("x.names").alias("name"))
    fetched = spread_join(written(asked, "asked-chunks"), chunks, "name", most_hot=MOST_HOT).groupBy("row_id").agg(F.collect_list(F.struct("at", "chunk")).alias("others"))  # as long as its document
    rows = recipes.where(whole).withColumn("others", none).unionByName(recipes.where(~whole).join(fetched, "row_id").select(*_FIELDS, "others"))
    return rows.select(*_FIELDS, "others").mapInArrow(trimmed(build), f"doc_id long, row_id long, size long, {schema}")
