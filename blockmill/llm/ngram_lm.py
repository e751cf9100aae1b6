"""Interpolated modified Kneser-Ney n-grams, counted in Spark.

Words come first: each gets a number, small for frequent ones, by which n-grams of all tasks are told
in few bytes. Then tasks count the n-grams of their rows and send each part, a range of n-gram hashes,
its share as one compressed block; a part's blocks are merged and what the merge leaves is written to
the shared folder: hashes sorted by their first bits, with counts. Ranges are of hashes of whole n-grams,
so a context that a third of all words follow is spread over all of them; each part sums its contexts
before these are sent on. Distinct n-grams become the next lower order's continuation counts in the same
way, one shuffle an order. Scoring tasks memory-map the parts and look up sorted queries, so no task
holds the model.

Counting tells n-grams apart by 64 bits of hash. The arrays keep a place in a directory and 32 bits of
these, so an n-gram that wasn't counted is taken for another one with a chance of about 4e-9 a look-up,
at any size of the model.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.llm.common import bounded_batches, new_path, schema_with, sub_batches, trimmed

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = np.uint64(xxhash.xxh3_64_intdigest(b"\nend"))  # no word holds white space
#: Numbers of the place before a text, and of words that no training text holds.
START, UNKNOWN = np.uint64(0), np.uint64(2**64 - 1)
_FLUSH = 3_000_000
#: Tokens of a part, by which a model's parts grow with its texts; bytes of a token to tell their number by.
PART_TOKENS, TOKEN_BYTES = 2_000_000, 6
#: Hashes of one place in a part's directory, about; files that a worker holds open.
_PLACE, _MOST_OPEN = 16, 10_000
_BLOCKS = "kind int, part int, block binary, figures array<long>"
_N_FIGURES = 7


def mix(*columns: np.ndarray) -> np.ndarray:
    """One well-mixed 64-bit hash for each row of the columns; a single column stays as it is."""
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


def _spread(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of hashes, which are ranges of them, and their places in the part as fractions of 2 ** 64."""
    mask, shift, n = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(parts)
    low = (h & mask) * n
    high = (h >> shift) * n + (low >> shift)
    return (high >> shift).astype(np.int64), (high << shift) | (low & mask)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return _spread(h, parts)[0]


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each text's number of tokens (words and one end)."""
    out, sizes, end = [], [], int(END).to_bytes(8, "big")
    for t in texts:
        words = (t or b"").translate(_LOWER).split()
        out.append(b"".join(map(xxhash.xxh3_64_digest, words)) + end)
        sizes.append(len(words) + 1)
    return np.frombuffer(b"".join(out), ">u8").astype(np.uint64), np.array(sizes, np.int64)


def grams(h: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """order columns: each token with the order - 1 tokens before it, starts where there are none."""
    first = np.cumsum(sizes) - sizes
    nth = np.arange(len(h)) - np.repeat(first, sizes)
    columns = []
    for back in range(order - 1, 0, -1):
        c = np.roll(h, back)
        c[nth < back] = START
        columns.append(c)
    return [*columns, h]


def _planes(c: np.ndarray) -> tuple[int, bytes]:
    """The bytes that a column's numbers need, and all first ones before all second ones."""
    width = max((int(c.max(initial=0)).bit_length() + 7) // 8, 1)
    return width, c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _pack(columns: list[np.ndarray], counts: list[np.ndarray]) -> bytes:
    """Rows as a block. Those in the order of their first columns make small blocks."""
    key = (columns[0] << np.uint64(32)) ^ columns[1] if len(columns) > 1 else columns[0]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key)
        columns, counts = [c[order] for c in columns], [c[order] for c in counts]
    first = np.diff(columns[0], prepend=np.uint64(0))  # wraps around where the order falls
    widths, raw = zip(*map(_planes, [first, *columns[1:], *[c.astype(np.uint64) for c in counts]]), strict=True)
    return zstandard.compress(b"".join([np.array([len(first), len(columns), len(widths), *widths], np.int64).tobytes(), *raw]), 1)


def _unpack(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = zstandard.decompress(block)
    n, width, kinds = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    at, columns = 24 + 8 * kinds, []
    for size in np.frombuffer(raw, np.int64, kinds, 24).tolist():
        c = np.zeros((n, 8), np.uint8)
        c[:, :size] = np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T
        columns.append(c.view(np.uint64).ravel())
        at += size * n
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:width]], [c.view(np.int64) for c in columns[width:]]


def _summed(columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Distinct rows, their sorted hashes, and the sums of their counts."""
    k = mix(*columns)
    order = np.argsort(k)
    k = k[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    at = order[heads]
    return [c[at] for c in columns], k[heads], [np.add.reduceat(c[order], heads) if len(k) else c for c in counts]


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and their numbers. Rows of numbers that fit in 64 bits are sorted as such."""
    bits = max(int(c.max(initial=0)).bit_length() for c in columns)
    if bits * len(columns) > 64 or len(columns) == 1:
        columns, _, (times,) = _summed(columns, [np.ones(len(columns[0]), np.int64)])
        return columns, times
    key, shift = columns[0], np.uint64(bits)
    for c in columns[1:]:
        key = key << shift | c
    key = np.sort(key)
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    times, key, out = np.diff(heads, append=len(key)), key[heads], []
    for _ in columns[1:]:
        out.append(key & np.uint64((1 << bits) - 1))
        key = key >> shift
    return [key, *out[::-1]], times


def _sent(kind: int, columns: list[np.ndarray], counts: list[np.ndarray], parts: int) -> Iterator[tuple]:
    """Blocks of distinct n-grams for the parts that they belong to."""
    return _dealt(kind, columns, counts, _part(columns, mix(*columns), parts))


def _part(columns: list[np.ndarray], keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of n-grams: by their hash, but those of single words by the word's number."""
    return part_of(keys, parts) if len(columns) > 1 else (keys % np.uint64(parts)).astype(np.int64)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with its rows."""
    if (part[1:] < part[:-1]).any():
        order = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
        heads = np.flatnonzero(np.diff(part[order], prepend=-1))
        for rows in np.split(order, heads[1:]):
            yield int(part[rows[0]]), rows
    else:
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        for i, j in zip(heads, [*heads[1:], len(part)], strict=False):
            yield int(part[i]), np.arange(i, j)


def _dealt(kind: int, columns: list[np.ndarray], counts: list[np.ndarray], part: np.ndarray) -> Iterator[tuple]:
    """A block of rows for each part."""
    for p, rows in _by_part(part):
        yield kind, p, _pack([c[rows] for c in columns], [c[rows] for c in counts]), None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "part", "block", "figures"])


@dataclass
class NgramModel:
    """folder holds one file for each order n and part p, n-p, and for each part of the word list, w-p.
    Every part has all its files, empty ones too: a file that isn't there fails the scoring.

    w-p: sorted hashes of words, their ranks in the part, and how often they were seen. A word's number
    is rank * parts + p. n-p: counts of n-grams and, below the highest order, their figures as contexts
    of order n + 1 (total, and numbers of words seen once, twice and more often); of single words by
    rank, of others by hash.
    """

    folder: str
    order: int
    parts: int
    train_tokens: int = 0
    distinct: int = 0
    #: by order: discounts for counts 1, 2 and from 3
    discounts: dict[int, np.ndarray] = field(default_factory=dict)
    #: of the lowest order: sum of continuation counts, and of its discounts
    total: float = 0.0
    spared: float = 0.0

    def width(self, n: int) -> int:
        return 1 if n == self.order else 5


def _local(folder: str) -> str:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return folder
    raise ValueError(f"{folder}: the model's arrays are memory-mapped, so spark.checkpoint.dir must be a folder that executors mount")


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """All arrays in one file, in place at once, so that a repeated task does no harm."""
    path = f"{_local(folder)}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    mine = f"{path}.{uuid.uuid4().hex}"
    head = json.dumps([[a.dtype.str, a.size] for a in arrays]).encode()
    with open(mine, "wb") as f:
        f.write(head + b" " * (-(len(head) + 1) % 8) + b"\n")
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(mine, path)


def _load(folder: str, name: str) -> list[np.ndarray]:
    path = f"{_local(folder)}/{name}"
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: a part of the model isn't there; executors must mount the folder in spark.checkpoint.dir")
    with open(path, "rb") as f:
        head = f.readline()
    raw, at, out = np.memmap(path, np.uint8, "r"), len(head), []
    for kind, n in json.loads(head):
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


_open: dict[str, dict] = {}


def _opened(folder: str, name: str) -> list[np.ndarray]:
    if folder not in _open or len(_open[folder]) >= _MOST_OPEN:
        _open.clear()  # a worker maps one model at a time
    held = _open.setdefault(folder, {})
    if name not in held:
        held[name] = _load(folder, name)
    return held[name]


def _coded(values: np.ndarray) -> list[np.ndarray]:
    """Rows of figures as one byte each: a place among the 255 most frequent rows of small figures, or
    255 for a row that stands apart, with its position."""
    width = values.shape[1]
    bits = 15 // width
    small = (values < 1 << bits).all(axis=1)
    key = np.where(small, values @ (1 << bits * np.arange(width)), 0)
    times = np.bincount(key[small], minlength=1)
    common = np.argsort(-times, kind="stable")[: min(255, np.count_nonzero(times))]
    rank = np.full(1 << 15, 255, np.uint8)
    rank[common] = np.arange(len(common), dtype=np.uint8)
    code = np.where(small, rank[key], np.uint8(255))
    apart = np.flatnonzero(code == 255)
    table = np.zeros((256, width), np.int64)
    table[: len(common)] = common[:, None] >> bits * np.arange(width) & (1 << bits) - 1
    return [code, table.ravel(), apart, values[apart].ravel()]


def _decoded(coded: list[np.ndarray], at: np.ndarray, width: int) -> np.ndarray:
    codes, common, apart, rare = coded
    code = codes[at]
    out = common.reshape(-1, width)[code]
    odd = np.flatnonzero(code == 255)
    if len(odd):
        out[odd] = rare.reshape(-1, width)[np.searchsorted(apart, at[odd])]
    return out


def _directory(keys: np.ndarray, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as places in the directory of their part, by the first bits after those that tell the part,
    and as the 32 bits that follow. Sorted hashes stay sorted."""
    inside = _spread(keys, parts)[1]
    return (inside >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64), (inside >> np.uint64(32 - bits)).astype(np.uint32)


def _save_grams(folder: str, name: str, keys: np.ndarray, values: np.ndarray, parts: int) -> None:
    bits = min(max(len(keys) // _PLACE, 1).bit_length() - 1, 32)
    place, tails = _directory(keys, parts, bits)
    starts = np.r_[0, np.cumsum(np.bincount(place, minlength=2**bits))]
    _save(folder, name, starts.astype(np.uint32), tails, *_coded(values))


def _held(starts: np.ndarray, tails: np.ndarray, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a part holds, and their positions: a binary search of all keys at once."""
    place, ask = _directory(keys, parts, (len(starts) - 1).bit_length() - 1)
    low, end = starts[place].astype(np.int64), starts[place + 1].astype(np.int64)
    step = 1 << int(np.max(end - low, initial=0)).bit_length() >> 1
    while step:  # low never passes the first tail that isn't below what is asked for
        further = low + step
        low = np.where((further <= end) & (tails[np.minimum(further, len(tails)) - 1] < ask), further, low)
        step >>= 1
    hit = (low < end) & (tails[np.minimum(low, len(tails) - 1)] == ask)
    return hit, low[hit]


def _numbers(folder: str, parts: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of sorted word hashes, and how often they were seen; UNKNOWN and 0 without an entry."""
    ids, seen = np.full(len(words), UNKNOWN), np.zeros(len(words), np.int64)
    for p, ask in _by_part(part_of(words, parts)):
        keys, ranks, *coded = _opened(folder, f"w-{p}")
        if len(keys):
            at = np.minimum(np.searchsorted(keys, words[ask]), len(keys) - 1)
            hit = keys[at] == words[ask]
            ids[ask[hit]] = ranks[at[hit]].astype(np.uint64) * np.uint64(parts) + np.uint64(p)
            seen[ask[hit]] = _decoded(coded, at[hit], 1)[:, 0]
    return ids, seen


def _find(model: NgramModel, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of figures for each distinct n-gram of word numbers, 0 where there is none, and the rows'
    n-grams."""
    keys, back = np.unique(mix(*columns), return_inverse=True)
    out = np.zeros((len(keys), model.width(len(columns))), np.int64)
    for p, ask in _by_part(part_of(keys, model.parts)):
        starts, tails, *coded = _opened(model.folder, f"{len(columns)}-{p}")
        if len(tails):
            hit, at = _held(starts, tails, keys[ask], model.parts)
            out[ask[hit]] = _decoded(coded, at, out.shape[1])
    return out, back


def _find_words(model: NgramModel, ids: np.ndarray) -> np.ndarray:
    """A row of figures for each word number, 0 for unknown ones."""
    out = np.zeros((len(ids), 5), np.int64)
    known = np.flatnonzero(ids != UNKNOWN)
    for p, ask in _by_part(_part([ids], ids[known], model.parts)):
        out[known[ask]] = _decoded(_opened(model.folder, f"1-{p}"), (ids[known[ask]] // np.uint64(model.parts)).astype(np.int64), 5)
    return out


def _list_words(folder: str, parts: int):
    def listed(group: pa.Table) -> pa.Table:
        """One part of the word list. Ranks follow the counts, then the hashes, and start at 1."""
        part = group.column("part")[0].as_py()
        blocks = [_unpack(x) for x in group.column("block").to_pylist()]
        _, keys, (seen,) = _summed([np.concatenate([c for (c,), _ in blocks])], [np.concatenate([n for _, (n,) in blocks])])
        ranks = np.empty(len(keys), np.uint32)
        ranks[np.lexsort((keys, -seen))] = np.arange(1, len(keys) + 1, dtype=np.uint32)
        _save(folder, f"w-{part}", keys, ranks, *_coded(seen[:, None]))
        return pa.Table.from_batches([_rows([(-1, part, None, [int(seen.sum()), len(keys)] + [0] * (_N_FIGURES - 2))])])

    return listed


def _merge(folder: str, n: int, parts: int, most: int):
    """Kinds of blocks: n n-grams of order n with their counts, 100 + n contexts of order n with their
    total and their numbers of words seen once, twice and more often; -n figures of order n."""

    def merge(group: pa.Table) -> pa.Table:
        """One part: its n-grams of this order and contexts of the next, and what the lower order gets."""
        part, out, found = group.column("part")[0].as_py(), [], []
        for kind, block, figures in zip(*(group.column(c).to_pylist() for c in ("kind", "block", "figures")), strict=True):
            if kind < 0:
                out.append((kind, part, None, figures))
                continue
            columns, counts = _unpack(block)
            none = np.zeros(len(columns[0]), np.int64)
            found.append((columns, [none, *counts] if kind > 100 else counts if n == most else [*counts, *[none] * 4]))
        if not found:
            return pa.Table.from_batches([_rows(out)])
        columns, keys, counts = _summed(*[[np.concatenate([x[w][i] for x in found]) for i in range(len(found[0][w]))] for w in (0, 1)])
        found.clear()
        values = np.stack(counts, axis=1)
        count = values[:, 0]
        if n == 1:  # sorted by number
            ranks = (keys // np.uint64(parts)).astype(np.int64)
            every = np.zeros((len(_opened(folder, f"w-{part}")[0]) + 1, 5), np.int64)
            every[ranks] = values
            _save(folder, f"1-{part}", *_coded(every))
        else:
            _save_grams(folder, f"{n}-{part}", keys, values, parts)
            own = count > 0
            columns, count = [c[own] for c in columns], count[own]
            suffixes, times = _counted(columns[1:])
            out += _sent(n - 1, suffixes, [times], parts)
            # most n-grams are seen once, and their contexts need no sums
            once, more = count == 1, count > 1
            contexts, times = _counted([c[once] for c in columns[:-1]])
            out += _sent(100 + n - 1, contexts, [times, times, times * 0, times * 0], parts)
            contexts, _, counts = _summed([c[more] for c in columns[:-1]], [x[more].astype(np.int64) for x in (count, count == 1, count == 2, count > 2)])
            out += _sent(100 + n - 1, contexts, counts, parts)
        out.append((-n, part, None, [int(x) for x in (*[(count == k).sum() for k in (1, 2, 3, 4)], (count > 2).sum(), count.sum(), 0)]))
        return pa.Table.from_batches([_rows(out)])

    return merge


def _complete(folder: str, parts: int, names: tuple[str, ...]):
    """Empty files of parts that nothing fell into; files that are there stay."""
    none = [np.zeros(0, k) for k in (np.uint8, np.int64, np.int64, np.int64)]

    def complete(rows) -> None:
        for r in rows:
            for name in names:
                if not os.path.exists(f"{_local(folder)}/{name}-{r['id']}"):
                    keys = {"w": [np.zeros(0, np.uint64), np.zeros(0, np.uint32)], "1": []}.get(name, [np.zeros(2, np.uint32), np.zeros(0, np.uint32)])
                    _save(folder, f"{name}-{r['id']}", *keys, *(_coded(np.zeros((1, 5), np.int64)) if name == "1" else none))

    return complete


def _figures(rows: DataFrame) -> dict[int, list[int]]:
    sums = rows.where("kind < 0").groupBy("kind").agg(*[F.sum(F.col("figures")[i]).alias(f"f{i}") for i in range(_N_FIGURES)])
    return {-r["kind"]: list(r)[1:] for r in sums.collect()}  # a row an order


def fit_ngrams(docs: DataFrame, order: int = 2, parts: int | None = None) -> NgramModel:
    """A model of the texts (column text; null is empty) of docs. order is 2 at least.

    parts grow by default with the bytes of the texts, about PART_TOKENS tokens each, whatever the
    number of shuffle partitions. Null ids and repeated rows don't matter: each row's text counts as
    often as it stands there. An empty table gives a model in which every token is unknown.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if order < 2:
        raise ValueError("order must be 2 at least")
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = -(-size // (TOKEN_BYTES * PART_TOKENS)) or 1
    model = NgramModel(new_path(spark, "ngrams"), order, parts)
    folder = model.folder

    def counted(flush):
        def count(batches):
            held: list = []

            def blocks():
                h, sizes = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                held.clear()
                rows = list(flush(h, sizes))
                for i in range(0, len(rows), 16):
                    yield _rows(rows[i : i + 16])

            for b in batches:
                texts = b.column(0).cast(pa.binary()).to_pylist()
                for i, j in sub_batches(texts):
                    held.append(tokens(texts[i:j]))
                    if sum(len(h) for h, _ in held) >= _FLUSH:
                        yield from blocks()
            if held:
                yield from blocks()

        return docs.select("text").mapInArrow(trimmed(count), _BLOCKS)

    def words(h, sizes):
        known, times = np.unique(h, return_counts=True)
        return _dealt(0, [known], [times], part_of(known, parts))

    def ngrams(h, sizes):
        known, at = np.unique(h, return_inverse=True)
        numbers = _numbers(folder, parts, known)[0]
        by_number = np.argsort(numbers)
        place = np.empty(len(known), np.uint64)  # places in the list of these numbers are smaller, in the same order
        place[by_number] = np.arange(1, len(known) + 1, dtype=np.uint64)
        columns, times = _counted(grams(place[at], sizes, order))
        listed = np.r_[START, numbers[by_number]]
        return _sent(order, [listed[c] for c in columns], [times], parts)

    every_part = spark.range(parts, numPartitions=min(parts, 64))
    model.train_tokens, model.distinct = (_figures(counted(words).groupBy("part").applyInArrow(_list_words(folder, parts), _BLOCKS)).get(1) or [0, 0])[:2]
    every_part.foreachPartition(_complete(folder, parts, ("w",)))
    rows = counted(ngrams)
    for n in range(order, 0, -1):
        rows = rows.groupBy("part").applyInArrow(_merge(folder, n, parts, order), _BLOCKS)
    stats = {n: [0] * _N_FIGURES for n in range(1, order + 1)} | _figures(rows)
    every_part.foreachPartition(_complete(folder, parts, tuple(str(n) for n in range(1, order + 1))))
    for n, s in stats.items():
        n1, n2, n3, n4 = (float(x) for x in s[:4])
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        model.discounts[n] = np.array([0.0, *[min(max(k - (k + 1) * y * up / low, 0.1), k - 0.05) if low and up else k * 0.5 for k, low, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]])
    low, d = stats[1], model.discounts[1]
    model.total = float(low[5])
    model.spared = float(d[1] * low[0] + d[2] * low[1] + d[3] * low[4])
    return model


def log_probabilities(model: NgramModel, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and training count of each token."""
    words, back = np.unique(h, return_inverse=True)
    numbers, seen = _numbers(model.folder, model.parts, words)
    ids = numbers[back]
    first = np.cumsum(sizes) - sizes
    p = np.full(len(h), 1 / (model.distinct + 1))
    total, spared = np.zeros(len(h)), np.zeros(len(h))
    for n in range(1, model.order + 1):
        figures, of = (_find_words(model, numbers), back) if n == 1 else _find(model, grams(ids, sizes, n))
        count, d = figures[:, 0], model.discounts[n]
        kept = np.maximum(count - d[np.minimum(count, 3)], 0)[of]
        if n > 1:
            p = np.where(total > 0, (kept + spared * p) / np.maximum(total, 1), p)
        elif model.total:
            p = (kept + model.spared / (model.distinct + 1)) / model.total
        if n < model.order:  # a token's context is the n-gram that ends before it
            total, spared = (np.roll(x[of], 1) for x in (figures[:, 1], figures[:, 2:] @ model.discounts[n + 1][1:]))
            before = [np.array([START])] * n
            start = (_find_words(model, *before) if n == 1 else _find(model, before)[0])[0]
            total[first], spared[first] = start[1], start[2:] @ model.discounts[n + 1][1:]
    return np.log10(p), seen[back]


def score_ngrams(docs: DataFrame, model: NgramModel) -> DataFrame:
    """docs with n_tokens, n_known, base_score (add-one unigrams), score and perplexity.

    Null texts are empty: one end token. Columns of docs with these names are replaced, text is left
    out, and every row gives one row, rows with a null or repeated id too.
    """
    new = ("n_tokens", "n_known", "base_score", "score", "perplexity")
    carry = [c for c in docs.columns if c not in (*new, "text")]
    room = float(model.train_tokens + model.distinct + 1)

    def score(batches):
        for b in batches:
            texts = b.column(len(carry)).cast(pa.binary()).to_pylist()
            for i, j in sub_batches(texts, 4_000_000):
                h, sizes = tokens(texts[i:j])
                log_p, count = log_probabilities(model, h, sizes)
                doc = np.repeat(np.arange(j - i), sizes)
                total = np.bincount(doc, log_p, j - i)
                base = np.bincount(doc, np.log10((count + 1) / room), j - i)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:-1], pa.array(sizes), pa.array(np.bincount(doc, count > 0, j - i).astype(np.int64)), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / sizes, 300))], names=[*carry, *new])

    return docs.select(*[f"`{c}`" for c in carry], F.col("text")).mapInArrow(trimmed(score), schema_with(docs, carry, "n_tokens long, n_known long, base_score double, score double, perplexity double"))
