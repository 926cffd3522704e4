"""Jaccard join of word shingle sets over count vectors in R-trees.

A set is the distinct hashes of 5-word shingles. Its tokens are hashed into groups, twice:

* Finely, with as many groups as suit the set's size. Linked sets differ in at most D = (|A| + |B|) / 9 tokens
  (for a similarity of 0.8), so of the first D + 1 groups that are not empty at least one holds the same tokens in both.
  Those groups with their content are the cells a set is filed under; every linked pair meets in a cell. The sets
  are dealt out by cell, and only cells with two different sets go on.
* Coarsely, into ``DIMENSIONS`` groups. The counts per group are a point, and the sum of the smaller coordinates bounds
  how many tokens two sets share. An R-tree over the points of a cell gives the pairs whose bound is high enough.

Surviving pairs are verified on the sets. A first round verifies each cell's first set against the others, which
joins groups of near copies in time linear in their size; the R-trees then look only in cells that still hold
different components, for pairs between those. Cells of any size are searched in blocks.

Sets are filed under some more cells than the first D + 1 (``spare``), so linked sets meet as many times more, and each set
leaves as many of its most crowded cells: the least crowded cell that two linked sets share has at least as many behind it
in both. A passage that many texts share crowds a few cells of each, and none of them has to be searched for it.

Equal sets are one class, known by a 64-bit hash. That a set of 64 and more tokens has fewer than D + 1 groups has a
chance below 1e-9; shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import WIDE, settled, slices, written
from creditloom.llm.components import components
from creditloom.llm.spans import LAST, with_texts
from creditloom.llm.words import mix, window_hashes, word_hashes

SHINGLE = 5
DIMENSIONS = 256
SMALLEST = 64  # sizes from here on use one group per 1.4 tokens of the size class, smaller ones a group per token
LEAF, FAN = 32, 16
BLOCK = 512  # sets of a cell that one search holds
LOWEST = 16  # cells of a set that travel with it
STEP = 1 << 12  # rows or pairs that one step of a search holds
SLICE = 1 << 20
HELD = 1 << 19  # cells of a bucket between two sorts
NO_CLASS = 0


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes; of fewer words the whole sequence; empty without words."""
    words, at = word_hashes(texts, lower=True)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = words[a:b]
        out.append(np.unique(window_hashes(own, SHINGLE) if len(own) >= SHINGLE else window_hashes(own, max(1, len(own)))))
    return out


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - 2**63 if len(tokens) else NO_CLASS


def linked(shared, a, b):
    """100 * shared >= 80 * union, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def levels_of(n: int) -> list[int]:
    """Size classes that a set of ``n`` tokens is filed in: its own, and the next one if a partner can be in it."""
    own = n.bit_length() - 1
    return [own] + [own + 1] * (5 * n // 4 >= 2 << own)


def groups_of(level: int) -> int:
    return (1 << level) * 7 // 10 if 1 << level >= SMALLEST else 1 << 16


def differing(n: int) -> int:
    """The most tokens in which a set of ``n`` differs from a linked one."""
    return (n + 5 * n // 4) // 9


def filed_more(n: int) -> int:
    """Cells beyond the first D + 1, a quarter of D at most and no more than sets of that size have by far."""
    fewest = n
    for level in levels_of(n):
        groups = groups_of(level)
        full = -np.expm1(-n / groups)
        fewest = min(fewest, groups * full - 8 * np.sqrt(groups * full * (1 - full)) - 4)
    return int(max(0, min(fewest - differing(n) - 1, 4 + differing(n) // 4)))


@lru_cache(1 << 16)
def spare(n: int) -> int:
    """Cells beyond one in which a set of ``n`` tokens and any linked one meet at least."""
    low, high = -(-4 * n // 5), 5 * n // 4
    # between these sizes the number of cells grows or falls steadily
    turns = {t + d for level in range(1, high.bit_length() + 1) for t in (1 << level, -(-(2 << level) * 4 // 5)) for d in (-1, 0, 1)}
    return min(filed_more(m) for m in {low, n, high} | {t for t in turns if low <= t <= high})


def cells(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the cells of a set."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    wanted = differing(n) + 1 + filed_more(n)
    out = []
    for level in levels_of(n):
        group = ((tokens >> np.uint64(32)) * np.uint64(groups_of(level))) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(group, prepend=group[0] + np.uint64(1)))[: wanted + 1]
        content = np.add.reduceat(mix(tokens), starts)[:wanted]
        out.append(mix(content + mix(group[starts[:wanted]] + np.uint64(level << 40))))
    return np.concatenate(out)


def point(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((tokens & np.uint64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS).astype(np.int32)


def narrowed(counts: np.ndarray) -> bytes:
    """A point in as few bytes a coordinate as its largest one needs: 1, 2 or 4."""
    largest = int(counts.max(initial=0))
    return counts.astype(np.uint8 if largest < 1 << 8 else np.uint16 if largest < 1 << 16 else np.int32).tobytes()


def widened(points: list[bytes]) -> np.ndarray:
    out = np.empty((len(points), DIMENSIONS), dtype=np.int32)
    sizes = np.array([len(p) for p in points])
    for kind in (np.uint8, np.uint16, np.int32):
        own = np.flatnonzero(sizes == DIMENSIONS * np.dtype(kind).itemsize)
        out[own] = np.frombuffer(b"".join(points[i] for i in own), kind).reshape(-1, DIMENSIONS)
    return out


class RTree:
    """Count vectors in boxes of which only the upper corner matters, with the sizes that occur inside."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        wide = points.var(axis=0).argmax() if len(points) else 0
        self.order = np.lexsort((points[:, wide], sizes // 8))
        corner, low, high = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(corner, low, high)]
        step = LEAF
        while len(corner) > 1:
            cuts = np.arange(0, len(corner), step)
            corner = np.maximum.reduceat(corner, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((corner, low, high))
            step = FAN

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the points that may belong to a set linked with the one of point ``q`` and size ``n``."""
        found = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, low, high = self.levels[depth]
            near = found[(4 * n <= 5 * high[found]) & (4 * low[found] <= 5 * n)]
            bound = np.minimum(corner[near], q).sum(axis=1)
            found = near[linked(bound, n, np.maximum(low[near], -(-4 * n // 5)))]
            if depth:
                step = LEAF if depth == 1 else FAN
                spread = (found[:, None] * step + np.arange(step)).reshape(-1)
                found = spread[spread < len(self.levels[depth - 1][0])]
        return self.order[found]


# passes over the texts -------------------------------------------------------------------------------


def filed(docs: DataFrame, buckets: int) -> DataFrame:
    """Per document a row (doc_id, text_hash, n, class, spare, point); per slice and bucket a row with the cells that fall into it.

    A cell takes 8 bytes: 48 bits of its hash and the number of the class in the list that precedes the cells.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            sets = shingle_sets(batch.column(2).to_pylist())
            classes = np.array([class_of(s) for s in sets], dtype=np.int64)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            none = pa.nulls(len(sets))
            points = pa.array([narrowed(point(s)) for s in sets], pa.binary())
            spares = pa.array([spare(len(s)) if len(s) else 0 for s in sets], pa.int32())
            known = [batch.column(0), batch.column(1), pa.array(n), pa.array(classes), spares, points]
            yield pa.RecordBatch.from_arrays([*known, none.cast(pa.int32()), none.cast(pa.binary())], FILED)
            different, first = np.unique(classes, return_index=True)
            keep = different != NO_CLASS
            different, first = different[keep], first[keep]
            for a in range(0, len(first), 1 << 16):
                part = [cells(sets[i]) for i in first[a : a + (1 << 16)]]
                if not part:
                    continue
                owner = np.repeat(np.arange(len(part), dtype=np.uint64), [len(p) for p in part])
                hashes = np.concatenate(part)
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                packed = ((hashes >> np.uint64(16)) << np.uint64(16)) | owner
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                packed = packed[order]
                names, blobs = [], []
                for b in np.flatnonzero(np.diff(cuts)):
                    own = packed[cuts[b] : cuts[b + 1]]
                    used, number = np.unique(own & np.uint64(0xFFFF), return_inverse=True)
                    own = (own & ~np.uint64(0xFFFF)) | number.astype(np.uint64)
                    table = different[a + used.astype(np.int64)]
                    names.append(int(b))
                    blobs.append(len(used).to_bytes(8, "little") + table.tobytes() + own.tobytes())
                none = pa.nulls(len(names), pa.int64())
                blank = [none, none, none, none, pa.nulls(len(names), pa.int32()), pa.nulls(len(names), pa.binary())]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], FILED)

    schema = "doc_id bigint, text_hash bigint, n bigint, class bigint, spare int, point binary, bucket int, blob binary"
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text")
    ).mapInArrow(rows, schema)


FILED = ["doc_id", "text_hash", "n", "class", "spare", "point", "bucket", "blob"]


def shared_cells(blobs: DataFrame, buckets: int) -> DataFrame:
    """(cell, pivot, class) for every class of a cell but the first one seen, its pivot. Repeats are possible.

    A task keeps one pivot per cell of its bucket, never a cell's members.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = int.from_bytes(blob[:8], "little")
                table = np.frombuffer(blob, dtype=np.int64, offset=8, count=n)
                packed = np.frombuffer(blob, dtype=np.uint64, offset=8 + 8 * n)
                known.setdefault(bucket, []).append((packed & ~np.uint64(0xFFFF), table[(packed & np.uint64(0xFFFF)).astype(np.int64)]))
                held[bucket] = held.get(bucket, 0) + len(packed)
                if held[bucket] > HELD:
                    yield from emit(known, held, bucket)
        for bucket in list(known):
            yield from emit(known, held, bucket, last=True)

    def emit(known, held, bucket, last: bool = False):
        # pivots come first in the list, so a stable sort leaves each cell's pivot in front
        cell = np.concatenate([k[0] for k in known[bucket]])
        owner = np.concatenate([k[1] for k in known[bucket]])
        order = np.argsort(cell, kind="stable")
        cell, owner = cell[order], owner[order]
        first = np.flatnonzero(np.diff(cell, prepend=~cell[:1]))
        pivot = np.repeat(owner[first], np.diff(np.append(first, len(cell))))
        other = np.flatnonzero(owner != pivot)
        # the low bits of a cell's number are free: its bucket goes there
        number = (cell[other] | np.uint64(bucket & 0xFFFF)).view(np.int64)
        for a in range(0, len(other), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[part]), pa.array(pivot[other[part]]), pa.array(owner[other[part]])], ["cell", "pivot", "class"]
            )
        known[bucket] = [] if last else [(cell[first], owner[first])]
        # wait for as many new cells as are held, so that sorting stays proportional to the input
        held[bucket] = min(0, HELD - len(first))

    dealt = blobs.select("bucket", "blob").repartition(buckets, "bucket")
    return dealt.mapInArrow(rows, "cell bigint, pivot bigint, class bigint")


def sets_of(pairs: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """class and tokens of the classes in ``pairs``, from one document of each (place, text_hash in ``points``)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            sets = shingle_sets(batch.column(1).to_pylist())
            right = [i for i, (c, s) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)) if class_of(s) == c]
            tokens = pa.array([sets[i].tobytes() for i in right], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), tokens], ["class", "tokens"])

    classes = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = points.select("class", "place", "text_hash").join(classes, "class")
    return with_texts(wanted, docs).select("class", "text").mapInArrow(rows, "class bigint, tokens binary")


# pairs -----------------------------------------------------------------------------------------------


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose count vectors allow a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (widened(batch.column(i).to_pylist()) for i in (2, 3))
                keep = linked(np.minimum(p, q).sum(axis=1, dtype=np.int64), p.sum(axis=1, dtype=np.int64), q.sum(axis=1, dtype=np.int64))
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    points = lambda side: sets.select(F.col("class").alias(side), F.col("point").alias(f"p{side}"))
    joined = pairs.join(points("a"), "a").join(points("b"), "b")
    return joined.select("a", "b", "pa", "pb").mapInArrow(rows, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                keep.append(bool(linked(int((b[at] == a).sum()), len(a), len(b))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    tokens = lambda side: sets.select(F.col("class").alias(side), F.col("tokens").alias(f"t{side}"))
    joined = pairs.join(tokens("a"), "a").join(tokens("b"), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(rows, "a bigint, b bigint")


def undecided(members: DataFrame) -> DataFrame:
    """cell and size k of the cells that hold several components."""
    sides = members.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k"))
    return sides.where("lo <> hi").select("cell", "k")


def thinned(members: DataFrame, sets: DataFrame, *also: str) -> DataFrame:
    """``members`` (cell, class and more, each once) without the cells, most crowded first, that each class can spare.

    ``also`` names columns of ``sets`` to carry along.
    """
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("_k"))
    behind = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("_k"), F.desc("cell")))  # a document's cells
    placed = members.join(sizes, "cell").join(sets.select("class", "spare", *also), "class").withColumn("_behind", behind)
    return placed.where("_behind > spare").select(*members.columns, *also)


def tree_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of different components that meet in a cell and whose bound allows a link.

    ``members``: cell, class, component, each once; sets meet in at least one cell more than they have to spare. A cell's
    classes fall into blocks by hash; each pair of blocks is a search of its own: an R-tree over one block, the other one's
    points as queries. With each set go its lowest cells, so that a pair that meets in many is given by few.
    """
    members = written(thinned(members.join(undecided(members).select("cell"), "cell", "left_semi"), sets), "members")
    several = undecided(members)
    placed = (
        members.join(several.select("cell", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), "cell")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn(
            "search",
            F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) as i, greatest(o, block) as j))"),
        )
        .select("cell", "class", "component", "block", F.explode("search").alias("s"))
        .select("cell", "class", "component", "block", "s.i", "s.j")
    )
    lowest = members.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("cell")), 1, LOWEST).alias("lowest"))  # a document's cells
    narrow = sets.select("class", "n", "point").join(lowest, "class")
    dealt = placed.join(narrow, "class").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for search in whole_searches(batches):
            a, b = found_pairs(search)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = dealt.select("cell", "i", "j", "class", "component", "block", "n", "point", "lowest")
    return ordered.mapInArrow(rows, "a bigint, b bigint")


def starts_of(batch: pa.RecordBatch) -> np.ndarray:
    """First rows of the searches (cell, i, j) in a batch, and its end."""
    change = np.ones(batch.num_rows + 1, dtype=bool)
    change[1:-1] = np.logical_or.reduce([np.diff(batch.column(k).to_numpy()) != 0 for k in range(3)])
    return np.flatnonzero(change)


def whole_searches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches that end where a search ends; a search has two blocks at most."""
    rest = None
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            rest = part if rest is None else pa.concat_batches([rest, part])
            last = int(starts_of(rest)[-2])
            if last:
                yield rest.slice(0, last)
                rest = rest.slice(last)
    if rest is not None:
        yield rest


def found_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the pairs that the searches in ``batch`` give.

    A search of ``LEAF`` sets at most is one leaf, compared as such. Sets that meet in many cells are given by one of
    them where that can be told: not by a cell if both lists of lowest cells hold a lower one.
    """
    cell, i, j, names, parts, blocks, sizes = (batch.column(k).to_numpy() for k in range(7))
    vectors = widened(batch.column(7).to_pylist())
    ends = batch.column(8).offsets.to_numpy()
    place = np.arange(LOWEST)
    held = place < np.diff(ends)[:, None]
    lows = np.full((len(cell), LOWEST), LAST)
    lows[held] = batch.column(8).flatten().to_numpy()
    cuts = starts_of(batch)
    first, count = cuts[:-1], np.diff(cuts)
    left, right = [], []

    def keep(x: np.ndarray, y: np.ndarray, bounded: bool) -> None:
        fit = (parts[x] != parts[y]) & ((i[x] == j[x]) | (blocks[x] != blocks[y]))
        fit &= (5 * sizes[x] >= 4 * sizes[y]) & (5 * sizes[y] >= 4 * sizes[x])
        x, y = x[fit], y[fit]
        for a in range(0, len(x), STEP):
            u, v = x[a : a + STEP], y[a : a + STEP]
            both = np.sort(np.concatenate([lows[u], lows[v]], axis=1), axis=1)
            lower = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < cell[u][:, None])).any(axis=1)
            u, v = u[~lower], v[~lower]
            if not bounded:
                near = linked(np.minimum(vectors[u], vectors[v]).sum(axis=1), sizes[u], sizes[v])
                u, v = u[near], v[near]
            left.append(names[u])
            right.append(names[v])

    for k in np.unique(count[(count > 1) & (count <= LEAF)]):
        x, y = np.triu_indices(k, 1)
        for at in np.array_split(first[count == k], -(-int((count == k).sum()) * len(x) // (1 << 18))):
            keep((at[:, None] + x).reshape(-1), (at[:, None] + y).reshape(-1), False)
    for at, k in zip(first[count > LEAF], count[count > LEAF], strict=True):
        own = np.arange(at, at + k)
        one = blocks[own] == blocks[own].min()
        inside, queries = own[one], own if one.all() else own[~one]
        tree = RTree(vectors[inside], sizes[inside])
        for q in queries:
            near = inside[tree.search(vectors[q], sizes[q])]
            near = near[(blocks[near] != blocks[q]) | (names[near] < names[q])]
            keep(near, np.full(len(near), q), True)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their class (doc_id, text_hash, n, class), and the components of linked classes (node, component)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(filed(docs, buckets), "filed", WIDE)
    known = table.where("bucket is null").select("doc_id", "text_hash", "n", "class")
    members = written(shared_cells(table.where("bucket is not null"), buckets).distinct(), "cells")
    involved = members.select("class").union(members.select("pivot")).distinct()
    place = F.coalesce("doc_id", F.lit(LAST)).alias("place")
    points = written(
        table.where("bucket is null").select("class", place, "text_hash", "n", "spare", "point").join(involved, "class").dropDuplicates(["class"]),
        "points",
    )

    def checked(pairs: DataFrame) -> DataFrame:
        kept = written(pairs, "pairs", STEP)
        return written(verified(kept, written(sets_of(kept, points, docs), "sets", WIDE)), "verified", WIDE)

    everyone = written(members.select("cell", "class").union(members.select("cell", "pivot")).distinct(), "everyone")
    kept = written(thinned(everyone, points, "n"), "kept")
    first = kept.groupBy("cell").agg(F.min(F.struct("class", "n")).alias("_first"))
    # sizes rule out most pairs before they become rows
    meets = kept.join(first, "cell").where("_first.class < class and 5 * _first.n >= 4 * n and 5 * n >= 4 * _first.n")
    stars = meets.select(F.col("_first.class").alias("a"), F.col("class").alias("b")).distinct()
    links = checked(bounded(stars, points))
    joined = components(links)

    labelled = everyone.join(joined, F.col("class") == F.col("node"), "left").select(
        "cell", "class", F.coalesce("component", "class").alias("component")
    )
    more = checked(tree_pairs(written(labelled, "labelled"), points).distinct())
    return known, components(links.unionByName(more))


def representatives(docs: DataFrame) -> DataFrame:
    """place (doc_id, null last) and text_hash of one document of each component, the first by place, then hash.

    Documents without words are linked with nothing, so they all stay.
    """
    return settled(docs.sparkSession, lambda: _representatives(docs), "representatives")


def _representatives(docs: DataFrame) -> DataFrame:
    known, joined = link_classes(docs)
    at = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("place"), "text_hash")
    placed = known.join(joined, F.col("class") == F.col("node"), "left").select(
        at.alias("at"), "n", F.coalesce("component", "class").alias("component")
    )
    linked_ones = placed.where("n > 0").groupBy("component").agg(F.min("at").alias("at")).select("at.*")
    return linked_ones.unionByName(placed.where("n = 0").select("at.*").distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    A document without words is linked with nothing, so it is its own component. Documents with equal sets are linked.
    Rows with a null doc_id take part; a component of such rows alone has a null id. Repeated rows are equal documents.
    """
    return settled(docs.sparkSession, lambda: _components(docs), "components")


def _components(docs: DataFrame) -> DataFrame:
    known, joined = link_classes(docs)
    labelled = known.join(joined, F.col("class") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "class")).alias("_group")
    )
    smallest = labelled.where("_group is not null").groupBy("_group").agg(F.min("doc_id").alias("_least"))
    return labelled.join(smallest.withColumnRenamed("_group", "_of"), F.col("_group") == F.col("_of"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("_group").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id")
    )
