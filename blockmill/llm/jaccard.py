"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct shingles; equal sets are one class. Shingles are hashed into
groups, and a class's counts by group are a point: the overlap of two sets is at most the summed
coordinate minima of their points, and at most those of a point and a box. A tree of boxes finds the
pairs that may reach the threshold; these are verified on the sets.

Boxes over all of a corpus would overlap everywhere, so classes are dealt out first, without losing a
pair, by keys that linked sets share:

- from 90 percent on, sets of similar size use one grouping with more groups than two linked sets can
  have different shingles, so linked sets agree on a whole group, which is a key;
- below, so many groups would hold too few shingles each to tell texts apart. There the keys are the
  shingles a set has first in one order for all sets, as many as it takes for linked sets to share one.
  Shingles that are frequent in a bounded sample come last; the order only steers the work. Sets with
  a common key are points of a tree, and only those that the bound lets pass go on together.

Classes that go on together are chained; nearly all classes stay alone and end here. Each chain is a
tree's points once more, with its sets; chains and keys over BLOCK classes are dealt in pairs of blocks.
Inside a task links are only sought between classes that aren't linked yet through others, so a group
of copies costs about one verified link a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.llm.common import MOST_HOT, around, spread_join, sub_batches, temporary, trimmed, written
from blockmill.llm.components import connected_components
from blockmill.llm.ngram_lm import _LOWER, mix

#: Classes of a block, and shingles of all of a block's sets (8 bytes each).
BLOCK, BLOCK_SHINGLES = 1_000, 2_000_000
#: Pairs of (key, class), 16 bytes each, that a task combines before they are shuffled.
_FLUSH = 2_000_000
#: Classes of one key, 16 bytes each, up to which one task looks at them together (below GROUPS_FROM).
HOT_KEY = 1_000_000
#: Rows of (class, chain), 24 bytes each, up to which they are broadcast to fetch texts.
MOST_BROADCAST = 400_000
#: From this threshold on keys are whole groups.
GROUPS_FROM = 90
#: Documents of the sample that tells frequent shingles, the least number of them, and shingles kept.
ORDER_SAMPLE, ORDER_SEEN, ORDER_MOST = 20_000, 3, 200_000
_BOX, _FULL = 16, 255


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of all words if these are fewer than width."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    width = min(width, len(h))
    s = mix(*[h[k : len(h) - width + 1 + k] for k in range(width)])
    return np.unique(s * np.uint64(2 * width + 1) if width < 3 else s)


def size_levels(most: int = 10**9) -> np.ndarray:
    levels = [1]
    while levels[-1] < most:
        levels.append(int(levels[-1] * 1.5) + 1)
    return np.array(levels)


_LEVELS = size_levels()


def group_keys(s: np.ndarray, top: int, percent: int, level: int) -> np.ndarray:
    """A hash for each group's shingles, for sets up to top shingles.

    Sets a <= b <= top that reach the threshold differ in at most (a + b)(100 - p) / (100 + p)
    shingles, so with `spare` more groups than that at least 1 + spare groups are equal. From 64
    shingles on, a set with at most spare weak groups (two shingles at most) keeps the strong ones
    only: one of the equal groups is strong.
    """
    differ = 2 * top * (100 - percent) // (100 + percent)
    spare = max(2, differ // 8) if top >= 64 else 0
    n = differ + 1 + spare
    group = ((s >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(group, np.arange(n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s, s), dtype=np.uint64)])
    keys = mix(sums[cuts[1:]] - sums[cuts[:-1]], np.arange(n, dtype=np.uint64) + np.uint64(level << 32))
    weak = np.diff(cuts) <= 2
    return keys[~weak] if top >= 64 and weak.sum() <= spare else keys


def set_keys(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The set's keys: sets that reach the threshold have one in common."""
    if percent < GROUPS_FROM:
        first = len(s) - -(-percent * len(s) // 100) + 1
        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
        return np.concatenate([s[~late], s[late]])[:first]
    level = int(np.searchsorted(_LEVELS, len(s), "right")) - 1
    keys = [group_keys(s, int(_LEVELS[level + 1]) - 1, percent, level)]
    if 100 * len(s) >= percent * int(_LEVELS[level + 1]):  # sets of the next level may reach it
        keys.append(group_keys(s, int(_LEVELS[level + 2]) - 1, percent, level + 1))
    return np.concatenate(keys)


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted shingles of at least ORDER_SEEN of about ORDER_SAMPLE documents, ORDER_MOST at most."""
    share = ORDER_SAMPLE / max(docs.count(), 1)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))).select("text")

    def count(batches):
        for b in batches:
            sets = [x for x in (shingles(t, width) for t in b.column(0).cast(pa.binary()).to_pylist()) if len(x)]
            if sets:
                seen, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(n)], names=["shingle", "n"])

    seen = some.mapInArrow(trimmed(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= ORDER_SEEN)
    return np.sort(np.array([r["shingle"] for r in seen.orderBy(F.desc("n"), "shingle").limit(ORDER_MOST).collect()], np.int64).astype(np.uint64))


def point_of(s: np.ndarray) -> np.ndarray:
    """Counts by group, _FULL standing for it and any larger number: 64 groups, and for large sets one
    for each 16 shingles, rounded up to a power of two, as few groups tell large sets apart badly."""
    bits = max(6, (max(len(s), 1) - 1 >> 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), _FULL).astype(np.uint8)


def _class_id(s: np.ndarray) -> int:
    return int(np.int64(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)))


def _counts(points: np.ndarray) -> np.ndarray:
    return np.where(points == _FULL, 1 << 20, points).astype(np.int32)


class CountTree:
    """An R-tree over points of one number of groups: points are put in an order by halving along the
    widest coordinate, 16 neighbours make a box, 16 boxes a box of the next level, up to one level of
    16 boxes or fewer. A search goes down from there into boxes that the bound lets pass."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        points, cells, todo = _counts(points), [], [np.arange(len(points))]
        while todo:
            ids = todo.pop()
            if len(ids) <= _BOX:
                cells.append(ids)
            else:
                own = points[ids]
                order = np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")
                todo += [ids[order[: len(ids) // 2]], ids[order[len(ids) // 2 :]]]
        self.order = np.concatenate(cells)
        #: from the points upwards: largest counts, least and largest size of each box
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > _BOX:
            most, least, largest = self.levels[-1]
            first = np.arange(0, len(least), _BOX)
            self.levels.append((np.maximum.reduceat(most, first), np.minimum.reduceat(least, first), np.maximum.reduceat(largest, first)))

    def near(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Points that may reach the threshold with a point (as counts) of n shingles."""
        ids = np.arange(len(self.levels[-1][1]))
        for depth, (most, least, largest) in reversed(list(enumerate(self.levels))):
            ids = ids[(100 * largest[ids] >= percent * n) & (percent * least[ids] <= 100 * n)]
            ids = ids[np.minimum(most[ids], point).sum(1, dtype=np.int64) * (100 + percent) >= percent * (n + least[ids])]
            if depth:
                ids = (ids[:, None] * _BOX + np.arange(_BOX)).ravel()
                ids = ids[ids < len(self.levels[depth - 1][1])]
        return self.order[ids]


def links_of(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets which verified links connect: a forest of the join's graph. sets are
    in order of size."""

    def linked(a: int, b: int) -> bool:
        x, y = sets[a], sets[b]
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 100 * both >= percent * (len(x) + len(y) - both)

    return _forest([point_of(s) for s in sets], np.array([len(s) for s in sets]), percent, linked)


def _forest(points: list[np.ndarray], sizes: np.ndarray, percent: int, linked=None) -> list[tuple[int, int]]:
    """Pairs that the bound and linked let pass, as few as connect what all such pairs connect.

    sizes ascend. A set is compared with those before it, which have its number of groups or half of
    it if they are large enough to reach the threshold (over 50 percent).
    """
    groups, trees = np.array([len(p) for p in points]), {}
    for g in np.unique(groups):
        ids = np.flatnonzero(groups == g)
        trees[int(g)] = ids, CountTree(np.array([points[k] for k in ids]), sizes[ids])
    label, out = np.arange(len(sizes)), []
    for q in range(1, len(sizes)):
        point, near = _counts(points[q]), []
        for g, p in ((len(point), point), (len(point) // 2, point.reshape(-1, 2).sum(1))):
            if g in trees:
                near.append(trees[g][0][trees[g][1].near(p, sizes[q], percent)])
        near = np.concatenate(near)
        near = near[(near < q) & (label[near] != label[q])]
        while len(near):
            if linked is None or linked(int(near[0]), q):
                out.append((int(near[0]), q))
                label[label == label[near[0]]] = label[q]
                near = near[label[near] != label[q]]
            else:
                near = near[1:]
    return out


def document_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, class (null without words): one row for each
    row of docs."""

    def classes(batches):
        for b in batches:
            sets = (shingles(t, width) for t in b.column(2).cast(pa.binary()).to_pylist())
            rows = [(len(s), _class_id(s) if len(s) else None) for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([n for n, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.int64())], names=["doc_id", "text_key", "n_shingles", "class"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(trimmed(classes), "doc_id long, text_key long, n_shingles long, class long")


def _null_id_text() -> Column:
    """A row's text as a number where its id is null, which then names the row; else null."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.xxhash64("text"))


def _keyed_classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """class, first_id (its smallest doc_id), null_text (of one of its rows without an id), size, point,
    keys: one row a class."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width) if percent < GROUPS_FROM else np.zeros(0, np.uint64))

    def keyed(batches):
        for b in batches:
            ids, nulls, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
            for i, j in sub_batches(texts):
                rows = []
                for doc, null, s in zip(ids[i:j], nulls[i:j], (shingles(t, width) for t in texts[i:j]), strict=True):
                    if len(s):
                        check = int(np.int64(xxhash.xxh3_64_intdigest(s.tobytes(), 1) - (1 << 63)))
                        rows.append((doc, null, _class_id(s), check, len(s), point_of(s).tobytes(), set_keys(s, percent, frequent.value).astype(np.int64)))
                if rows:
                    keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[-1]) for r in rows]]), pa.int32()), pa.array(np.concatenate([r[-1] for r in rows])))
                    yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows], pa.int64() if k < 5 else pa.binary()) for k in range(6)], keys], names=["doc_id", "null_text", "class", "check", "size", "point", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), _null_id_text().alias("null_text"), "text").mapInArrow(trimmed(keyed), "doc_id long, null_text long, class long, check long, size long, point binary, keys array<long>")
    one = rows.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.min("null_text").alias("null_text"), F.min("check").alias("low"), F.max("check").alias("high"), F.first(F.struct("size", "point", "keys")).alias("row"))
    sure = F.when(F.col("low") == F.col("high"), F.col("row")).otherwise(F.raise_error(F.lit("two sets share a 64-bit class id")))
    return one.select("class", "first_id", "null_text", sure.alias("row")).select("class", "first_id", "null_text", "row.*")


def _shared(batches) -> np.ndarray:
    """From a partition that holds whole keys: (classes' hash, class) for each set of several classes
    that some key has. Near copies share many keys; their set comes once."""
    parts = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1) for b in batches]
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *parts])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)][: len(pairs)]]
    same = pairs[1:, 0] == pairs[:-1, 0]
    pairs = pairs[(np.r_[False, same] | np.r_[same, False])[: len(pairs)]]
    if not len(pairs):
        return pairs
    head = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
    classes = pairs[:, 1].astype(np.uint64)
    marks = np.add.reduceat(mix(classes, classes), head)
    _, once = np.unique(marks, return_index=True)
    size = np.diff(np.r_[head, len(pairs)])
    pairs[:, 0] = np.repeat(marks, size).astype(np.int64)
    return pairs[np.repeat(np.isin(np.arange(len(head)), once), size)]


def _batched(pairs: np.ndarray, names: list[str]):
    for i in range(0, len(pairs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, k]) for k in (0, 1)], names=names)


def _shared_keys(batches):
    yield from _batched(_shared(batches), ["key", "class"])


def _stars(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, class) pairs: each key with its first class, and that class with each other of the key."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    key, cls = pairs.T
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    first = np.repeat(cls[head], np.diff(np.r_[head, len(key)]))
    return pairs[head], np.unique(np.stack([first, cls], 1)[first != cls], axis=0)


_LINKS = ["key", "a", "b"]


def _linked(key, a, b=None):
    """Rows (key, a, b); b is null for a class that stands for a key."""
    for i in range(0, len(a), 100_000):
        j = slice(i, i + 100_000)
        none = pa.nulls(len(a[j]), pa.int64()) if b is None else pa.array(b[j])
        yield pa.RecordBatch.from_arrays([pa.array(key[j]), pa.array(a[j]), none], names=_LINKS)


def _combined_stars(batches):
    """Before the shuffle: one class for each key that a task meets, so a key that very many classes
    have is few rows, and links from that class to the others."""
    held: list[np.ndarray] = []

    def flush():
        stars, links = _stars(np.concatenate(held))
        held.clear()
        yield from _linked(stars[:, 0], stars[:, 1])
        yield from _linked(links[:, 0], links[:, 0], links[:, 1])

    for b in batches:
        n = np.diff(np.asarray(b.column(1).offsets))
        held.append(np.stack([np.asarray(b.column(1).flatten()), np.repeat(np.asarray(b.column(0)), n)], 1))
        if sum(map(len, held)) > _FLUSH:
            yield from flush()
    if held:
        yield from flush()


def _merged_stars(batches):
    """After it: the classes that stand for a key linked with its first one."""
    held = [np.zeros((0, 2), np.int64)]
    for b in batches:
        last = np.asarray(b.column(2).is_null())
        key, a = np.asarray(b.column(0)), np.asarray(b.column(1))
        held.append(np.stack([key[last], a[last]], 1))
        if not last.all():
            yield pa.RecordBatch.from_arrays([pa.array(a[~last]), b.column(2).drop_null()], names=["a", "b"])
    yield from _batched(_stars(np.concatenate(held))[1], ["a", "b"])


def _bounded_chains(percent: int):
    """From rows sorted by task: forests of the pairs that the bound lets pass among a task's classes."""

    def chains(batches):
        last, held = None, []

        def passed():
            rows = sorted(held, key=lambda h: h[1])
            if found := _forest([np.frombuffer(r[2], np.uint8) for r in rows], np.array([r[1] for r in rows]), percent) if len(rows) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array([rows[x[k]][0] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for task, cls, size, point in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if task != last:
                    yield from passed()
                    last, held = task, []
                held.append((cls, size, point))
        yield from passed()

    return chains


def _in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (a written table with group, class, size) with task: groups of more than block classes, or of
    very large ones, are dealt in pairs of blocks, so each pair of a group's classes meets in a task."""
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("int")
    rows = spread_join(rows, written(rows.groupBy(group).agg(blocks.alias("blocks")), "blocks"), group)
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine"))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    return dealt.withColumn("task", F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other"))).drop("mine", "other", "blocks")


def _shared_by_key(classes: DataFrame, hot_key: int) -> DataFrame:
    """key, class: rows of the keys that several classes have."""
    keyed = classes.select(F.explode("keys").alias("key"), "class")
    most = max(hot_key, -(-classes.count() // MOST_HOT))
    hot = None
    if classes.count() > most:  # else no key can have so many
        hot = written(keyed.groupBy("key").count().where(F.col("count") > most).select("key"), "hot-keys")
        keyed, hot = keyed.join(F.broadcast(hot), "key", "left_anti"), keyed.join(F.broadcast(hot), "key", "left_semi")
    shared = keyed.repartition("key").mapInArrow(trimmed(_shared_keys), "key long, class long").distinct()
    return shared.unionByName(hot.distinct()) if hot is not None else shared


def class_links(docs: DataFrame, classes: DataFrame, width: int, percent: int, block: int = BLOCK, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links between classes that connect whatever the join's links connect."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50, and 100 at most")
    if percent >= GROUPS_FROM:
        stars = classes.select("class", "keys").mapInArrow(trimmed(_combined_stars), "key long, a long, b long")
        pairs = stars.repartition("key").mapInArrow(trimmed(_merged_stars), "a long, b long")
    else:
        shared = written(_shared_by_key(classes, hot_key).join(classes.select("class", "size"), "class"), "shared")
        dealt = _in_blocks(shared, "key", block).select("task", "class").join(classes.select("class", "size", "point"), "class")
        pairs = dealt.select("task", "class", "size", "point").repartition("task").sortWithinPartitions("task", "class").mapInArrow(trimmed(_bounded_chains(percent)), "a long, b long")
    chained = connected_components(pairs)
    chained = chained.select("node", "root").union(chained.select(F.col("root").alias("node"), "root").distinct())
    chained = written(chained.withColumnRenamed("node", "class").join(classes.select("class", "first_id", "null_text", "size"), "class"), "chained")
    asked = written(_in_blocks(chained, "root", block).select(F.col("first_id").isNull().alias("no_id"), F.coalesce("first_id", "null_text").alias("row"), "class", "task"), "asked")
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, _null_id_text()).alias("row"), "text")
    texts = texts.join(F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked, ["no_id", "row"])

    def link(batches):
        task, held = None, {}
        for b in batches:
            for t, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if t != task:
                    yield from found(held)
                    task, held = t, {}
                if c not in held and _class_id(s := shingles(text, width)) == c:  # another row may have the id
                    held[c] = s
        yield from found(held)

    def found(held):
        ids = sorted(held, key=lambda c: (len(held[c]), c))
        if links := links_of([held[c] for c in ids], percent) if len(ids) > 1 else []:
            yield pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = texts.select("task", "class", "text").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(trimmed(link), "a long, b long")


def _components(docs: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class, component_id, and whether the class is the one of its
    component that has the smallest doc_id (first)."""
    classes = written(_keyed_classes(docs, width, percent), "classes")
    linked = connected_components(class_links(docs, classes, width, percent, block))
    ids = classes.select("class", "first_id")
    members = linked.union(linked.select(F.col("root"), F.col("root")).distinct()).withColumnRenamed("node", "class")
    members = written(members.join(ids, "class"), "members")
    least = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "class"))
    smallest = written(members.groupBy("root").agg(least.alias("least")).select("root", F.col("least.first_id").alias("smallest"), F.col("least.class").alias("first_class")), "smallest")
    moved = spread_join(members, smallest, "root").select("class", "smallest", "first_class")
    first = F.coalesce(F.col("first_class") == F.col("class"), F.lit(True)).alias("first")
    of = written(ids.join(moved, "class", "left").select("class", F.coalesce("smallest", "first_id").alias("component"), first), "of")
    rows = written(document_classes(docs, width), "document-classes")
    named = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return spread_join(rows, of, "class", "left").select("doc_id", "text_key", "n_shingles", "class", named.alias("component_id"), "first")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links): a row for each row.

    Sets link when 100 x intersection >= percent x union; equal sets always do. A text without words
    (null, empty, blank) has no shingles and its own doc_id. Rows with a null id take part; a component
    of such rows alone has a null id. Rows that repeat an id are rows of their own.
    """
    return _components(docs, width, percent, block).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component: one of those whose doc_id names it (null if no row of it has
    an id).

    Rows count, not ids: of rows that share an id each stands for its own text. Texts without words all
    stay. Only the rows that go, or that are there several times, are joined with the documents.
    """
    with temporary() as kept:
        found = kept(written(_components(docs, width, percent, block).where("class is not null"), "components"))
    own = F.col("first") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = found.where(own).groupBy("doc_id", "class").agg(F.count("*").alias("n"), F.min("text_key").alias("least"), F.max("text_key").alias("most"))
    several = stays.where("n > 1")
    other = several.where("least <> most").select("class", "least")
    gone = found.where(~own).select("doc_id", "text_key")
    gone = gone.unionByName(found.where(own).join(other, "class").where("text_key <> least").select("doc_id", "text_key")).distinct()
    marks = gone.withColumn("_go", F.lit(True)).unionByName(several.select("doc_id", F.col("least").alias("text_key"), F.lit(False).alias("_go")))
    marks = written(marks.withColumnsRenamed({"doc_id": "_id", "text_key": "_mark"}), "marks")
    small = marks.count() <= MOST_BROADCAST

    def keep(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_text", F.xxhash64("text"))
        same = (F.col("_text") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        marked = rows.join(F.broadcast(marks) if small else marks, same, "left")
        return marked.where("_go is null").unionByName(marked.where("not _go").dropDuplicates(["doc_id", "_text"])).drop("_text", "_id", "_mark", "_go")

    return around(docs, keep)
