"""Boosted trees that grow by their best leaf, over quantile bins.

Feature values become bin numbers once. A step of a tree is one aggregation: gradients, second derivatives and rows per
leaf, feature and bin, added up in every task first. The driver sees these histograms only (leaves x features x bins,
whatever the table holds), picks the leaf whose split gains most and goes on until the tree has its leaves. A leaf's sibling is
its parent less the leaf. Leaves with few rows are grown to the end by one task each, as a step that aggregates
them again and again would cost more than their rows. Which leaf comes next is decided afterwards, in the same order.

A tree takes several jobs, so a job must cost little: rows are kept in blocks of columns (one row of the table holds some
thousand rows as bytes), and the histograms of a few tasks go to the driver without a shuffle. A table with as few rows as such
a leaf needs no job per tree: one task grows a hundred trees after one another and keeps the margins meanwhile.

Gradients are whole numbers of 2^-scale, so sums and with them splits don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.running import running
from creditloom.session import fresh_path, importable, remove

STEP_ROWS = 1_000_000  # a leaf with no more rows is grown by one task, and a table with no more rows is fitted by one
WRITE_EVERY = 10  # trees after which margins are written
TASK_TREES = 100  # trees that one task grows after one another
COUNT_ROWS = 8192  # rows that are counted at once, so that what is gathered of them stays in a core's cache
LEAST_GAIN = 1e-9
LOW_BITS = 26
LOW = (1 << LOW_BITS) - 1
BLOCK_TASK_ROWS = 10_000  # a task that reads blocks has that many rows or more
FEW_TASKS = 32  # histograms of more tasks are added up before they go to the driver


@dataclass(frozen=True)
class Growth:
    """How trees grow; the defaults are those of the scoring model."""

    trees: int = 500
    learning_rate: float = 0.03
    leaves: int = 31
    column_share: float = 0.8
    bins: int = 255
    least_rows: int = 20  # per leaf
    least_hessian: float = 1e-3  # per leaf
    seed: int = 42
    step_rows: int = STEP_ROWS

    def columns(self, tree: int, names: Sequence[str]) -> list[int]:
        """The columns a tree may split by: those with the smallest digests of seed, tree and name."""
        digest = [hashlib.md5(f"{self.seed}:{tree}:{name}".encode()).hexdigest() for name in names]
        count = max(1, math.floor(len(names) * self.column_share + 0.5))
        return sorted(sorted(range(len(names)), key=lambda i: (digest[i], i))[:count])


# bins ---------------------------------------------------------------------------------------------------


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int = 255) -> DataFrame:
    """feature, position (from 0) and edge, by which a value belongs to the first edge that isn't smaller.

    A column with at most ``bins`` values has an edge at each but the largest. Otherwise an edge is a value at which the
    share of rows up to it passes a multiple of 1 / ``bins``. Values are counted first, and the counts added up by a
    running total that no single task computes alone.
    """
    names = F.array(*[F.struct(F.lit(c).alias("feature"), _value(c).alias("edge")) for c in columns])
    counts = rows.select(F.inline(names)).groupBy("feature", "edge").agg(F.count(F.lit(1)).alias("n"))
    ordered = running(counts.withColumn("up_to", F.col("n")), ["feature"], ["edge"], sums=["up_to"])
    sizes = ordered.groupBy("feature").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"))
    placed = ordered.join(F.broadcast(sizes), "feature")  # one row per feature
    passes = f"up_to * {bins} div rows > (up_to - n) * {bins} div rows"
    edges = placed.where(f"up_to < rows AND (distinct <= {bins} OR ({passes}))")
    position = F.expr("row_number() OVER (PARTITION BY feature ORDER BY edge) - 1")  # at most ``bins`` rows each
    return edges.select("feature", position.alias("position"), "edge")


def collected_edges(edges: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    found: dict[str, list[float]] = {c: [] for c in columns}
    for row in edges.orderBy("feature", "position").collect():  # fewer than bins x features
        found[row["feature"]].append(row["edge"])
    return [np.array(found[c]) for c in columns]


def codes_of(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix of values."""
    found = [np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)]
    return np.stack(found, axis=1).astype(np.int16) if found else np.zeros((len(values), 0), dtype=np.int16)


def _codes(block: bytes, rows: int) -> np.ndarray:
    """The bin numbers of a block, one row per row; columns lie together."""
    return np.frombuffer(block, dtype=np.int16).reshape(-1, rows).T


def _block(codes: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes.T, dtype=np.int16).tobytes()


def _some(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.take(codes.T, rows, axis=1).T


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# trees --------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in lists; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, value: float = 0.0) -> int:
        for values, new in ((self.feature, -1), (self.bin, -1), (self.left, -1), (self.right, -1), (self.value, value)):
            values.append(new)
        return len(self.feature) - 1

    def leaves_of(self, codes: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in."""
        at = np.zeros(len(codes), dtype=np.int64)
        waiting = [(0, np.arange(len(codes)))]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0:
                at[rows] = node
            elif len(rows):
                over = codes[:, self.feature[node]][rows] > self.bin[node]
                waiting += [(self.left[node], rows[~over]), (self.right[node], rows[over])]
        return at

    def values_of(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves_of(codes)]


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    left: tuple[int, int, int]  # gradient, second derivative (whole numbers) and rows
    right: tuple[int, int, int]


@dataclass(eq=False)
class Node:
    """A node of the tree as far as it is known; ``split`` is its best one, ``known`` says whether it was looked for."""

    total: tuple[int, int, int]
    known: bool = False
    split: Split | None = None
    histogram: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return self.total[2]

    def settle(self, split: Split | None) -> None:
        self.known, self.split = True, split
        if split:
            self.children = [Node(split.left), Node(split.right)]


@dataclass(frozen=True)
class Rules:
    """What a task needs to look for splits."""

    columns: tuple[int, ...]
    features: int
    bins: int
    least_rows: int
    least_hessian: float
    unit: float  # of a gradient's whole numbers


def histogram(codes: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """(features, bins, 3): gradient, second derivative and rows, added up exactly."""
    features = codes.shape[1]
    out = np.empty((features, bins, 3), dtype=np.int64)
    parts = []
    for values in (g, h):
        # sums of doubles are exact below 2^53; larger ones are added up in two halves
        small = len(values) * int(np.abs(values).max(initial=0)) < 1 << 53
        halves = [(values, 0)] if small else [(values >> LOW_BITS, LOW_BITS), (values & LOW, 0)]
        parts.append([(half.astype(np.float64), shift) for half, shift in halves])
    for f in range(features):
        slot = codes[:, f].astype(np.int64)
        for i, halves in enumerate(parts):
            out[f, :, i] = sum(np.bincount(slot, half, bins).astype(np.int64) << shift for half, shift in halves)
        out[f, :, 2] = np.bincount(slot, minlength=bins)
    return out


def gains(counts: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(features, bins): gain of a cut behind each bin (-inf where it isn't allowed), and the sums up to it."""
    below = np.cumsum(counts, axis=1)
    total = below[:, -1:, :]
    above = total - below
    hl, hr, ht = (x[:, :, 1] * rules.unit for x in (below, above, total))
    gl, gr, gt = (x[:, :, 0] * rules.unit for x in (below, above, total))
    fine = (below[:, :, 2] >= rules.least_rows) & (above[:, :, 2] >= rules.least_rows)
    fine &= (hl >= rules.least_hessian) & (hr >= rules.least_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, gl * gl / hl + gr * gr / hr - gt * gt / ht, -np.inf)
    return gain, below


def best_split(counts: np.ndarray, rules: Rules) -> Split | None:
    """The cut with the largest gain, ties to the first feature and bin; None if no allowed cut gains anything."""
    gain, below = gains(counts, rules)
    allowed = np.full(len(gain), -np.inf)
    allowed[list(rules.columns)] = 0.0
    gain = gain + allowed[:, None]
    feature, cut = divmod(int(np.argmax(gain)), gain.shape[1])
    if not gain[feature, cut] > LEAST_GAIN:
        return None
    left = tuple(int(v) for v in below[feature, cut])
    right = tuple(int(v) for v in below[feature, -1] - below[feature, cut])
    return Split(float(gain[feature, cut]), feature, cut, left, right)


def _addends(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers as doubles whose sums are exact, with the binary digits to shift them by: one part below 2^53 in sum, or two."""
    small = int(np.abs(values).sum()) < 1 << 53
    halves = [(values, 0)] if small else [(values >> LOW_BITS, LOW_BITS), (values & LOW, 0)]
    return [(half.astype(np.float64), shift) for half, shift in halves]


class Held:
    """Rows in the memory of one task, to grow trees over.

    The bins of all columns lie in one row of slots, each column's after those of the column before, so a few rows are counted in
    all columns by one pass.
    """

    def __init__(self, codes: np.ndarray) -> None:
        sizes = codes.max(axis=0).astype(np.int64) + 1
        self.codes, self.ends = codes, np.cumsum(sizes)
        self.starts, self.size = self.ends - sizes, int(self.ends[-1])
        self.column = np.repeat(np.arange(len(sizes)), sizes)
        self.slots = np.empty(codes.shape, dtype=np.uint16 if self.size <= 1 << 16 else np.int32)
        for f, start in enumerate(self.starts):
            self.slots[:, f] = codes[:, f] + start
        self.row_numbers = np.arange(len(codes))
        self.row_counts = np.concatenate([np.bincount(codes[:, f], minlength=n) for f, n in enumerate(sizes)])

    def grown(self, g: np.ndarray, h: np.ndarray, splits: int, rules: Rules) -> tuple[list[tuple], dict[tuple, np.ndarray]]:
        """The best ``splits`` splits, best leaf first: (parent, side, split) by their order; and the rows of each leaf by (parent, side)."""
        slots = self.slots.take(rules.columns, axis=1)
        parts = [_addends(g), _addends(h)]
        allowed = np.isin(self.column, rules.columns)
        before = np.searchsorted(rules.columns, self.column)  # columns that are counted before a slot's
        first = int(self.ends[rules.columns[0]]) - 1
        waiting: list[tuple] = []
        out: list[tuple] = []
        ends = {(-1, 0): self.row_numbers}

        def counted(rows: np.ndarray) -> np.ndarray:
            """(3, slots): gradient, second derivative and rows, added up exactly."""
            total = np.zeros((3, self.size), dtype=np.int64)
            everything = len(rows) == len(self.codes)
            for i in range(0, len(rows), COUNT_ROWS):
                some = rows[i : i + COUNT_ROWS]
                here = (lambda x: x[i : i + COUNT_ROWS]) if everything else (lambda x: x.take(some, axis=0))
                cells = here(slots).ravel().astype(np.intp)
                for sums, part in zip(total, parts, strict=False):
                    for values, shift in part:
                        found = np.bincount(cells, np.repeat(here(values), slots.shape[1]), self.size)
                        sums += found.astype(np.int64) << shift
                if not everything:
                    total[2] += np.bincount(cells, minlength=self.size)
            if everything:
                total[2] = np.where(allowed, self.row_counts, 0)
            return total

        def best(counts: np.ndarray) -> Split | None:
            """As ``best_split``, in slots."""
            below = np.cumsum(counts, axis=1)
            total = below[:, first].copy()
            below -= total[:, None] * before  # what overflows here did so in the sums as well
            above = total[:, None] - below
            (gl, hl), (gr, hr), (gt, ht) = (x[:2] * rules.unit for x in (below, above, total))
            fine = allowed & (below[2] >= rules.least_rows) & (above[2] >= rules.least_rows)
            fine &= (hl >= rules.least_hessian) & (hr >= rules.least_hessian)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fine, gl * gl / hl + gr * gr / hr - gt * gt / ht, -np.inf)
            at = int(np.argmax(gain))
            if not gain[at] > LEAST_GAIN:
                return None
            feature = int(self.column[at])
            left, right = (tuple(int(v) for v in x[:, at]) for x in (below, above))
            return Split(float(gain[at]), feature, at - int(self.starts[feature]), left, right)

        def look(counts: np.ndarray, parent: int, side: int) -> None:
            split = best(counts)
            if split:
                heapq.heappush(waiting, (-split.gain, parent, side, split, counts))

        look(counted(self.row_numbers), -1, 0)
        while waiting and len(out) < splits:
            _, parent, side, split, counts = heapq.heappop(waiting)
            rows = ends.pop((parent, side))
            over = self.codes[:, split.feature].take(rows) > split.bin
            children = [rows[~over], rows[over]]
            ends |= {(len(out), i): child for i, child in enumerate(children)}
            out.append((parent, side, split))
            if len(out) == splits:
                break
            smaller = int(len(children[1]) < len(children[0]))
            part = counted(children[smaller])
            both = [part, counts - part] if smaller == 0 else [counts - part, part]
            for child in (0, 1):
                look(both[child], len(out) - 1, child)
        return out, ends


# one tree over a table ----------------------------------------------------------------------------------

# A block of rows: bin numbers column by column (smallint), then three columns of doubles, all as bytes.
STATE = "n int, codes binary, label binary, weight binary, margin binary"
HISTOGRAM = "cell binary, g binary, h binary, n binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Codes, label, weight and margin of each block of ``STATE``."""
    for batch in batches:
        for row in batch.to_pylist():
            yield _codes(row["codes"], row["n"]), *(np.frombuffer(row[c]) for c in ("label", "weight", "margin"))


def _packed(total: np.ndarray) -> pa.RecordBatch:
    """The filled cells of histograms, as one row of ``HISTOGRAM``."""
    flat = total.reshape(-1, 3)
    some = np.flatnonzero(flat[:, 2])
    columns = [some, *flat[some].T]
    return pa.RecordBatch.from_pydict({c: [v.astype(np.int64).tobytes()] for c, v in zip(["cell", *"ghn"], columns, strict=True)})


def _summed(packed: pa.Table, cells: int) -> np.ndarray:
    out = np.zeros((cells, 3), dtype=np.int64)
    for row in packed.to_pylist():
        cell = np.frombuffer(row["cell"], dtype=np.int64)  # each occurs once
        for i, name in enumerate("ghn"):
            out[cell, i] += np.frombuffer(row[name], dtype=np.int64)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    p = np.where(x >= 0, 1.0, small)
    p /= 1.0 + small
    return p


def derivatives(label: np.ndarray, weight: np.ndarray, margin: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    g, h = weight * (p - label), weight * p
    h *= 1.0 - p
    for x in (g, h):
        x *= math.ldexp(1.0, scale)
    return tuple(np.rint(x, out=x).astype(np.int64) for x in (g, h))


@dataclass(frozen=True)
class Round:
    """A tree under way: rows with margins as written, the trees since then, and what splits must obey."""

    state: DataFrame
    since: tuple[Tree, ...]
    scale: int
    rules: Rules
    tasks: int = FEW_TASKS

    def rows(self, wanted: dict[int, int], tree: Tree):
        """Codes, derivatives and slot of the rows that end in one of the ``wanted`` leaves, per batch."""
        since, scale = self.since, self.scale

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            slots = np.full(len(tree.feature), -1)
            for leaf, slot in wanted.items():
                slots[leaf] = slot
            for codes, label, weight, margin in _blocks(batches):
                slot = slots[tree.leaves_of(codes)]
                some = np.flatnonzero(slot >= 0)
                codes, slot, margin = _some(codes, some), slot[some], margin[some]
                for earlier in since:
                    margin += earlier.values_of(codes)
                g, h = derivatives(label[some], weight[some], margin, scale)
                yield codes, slot, g, h

        return read

    def histograms(self, leaves: list[int], tree: Tree) -> dict[int, np.ndarray]:
        """The histogram of each leaf: one aggregation over all rows."""
        features, bins = self.rules.features, self.rules.bins
        size = features * bins
        rows = self.rows({leaf: i for i, leaf in enumerate(leaves)}, tree)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(leaves), features, bins, 3), dtype=np.int64)
            for codes, slot, g, h in rows(batches):
                for i in np.unique(slot).tolist():
                    mine = slot == i
                    total[i] += histogram(_some(codes, np.flatnonzero(mine)), g[mine], h[mine], bins)
            yield _packed(total)

        def join(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_packed(_summed(table, len(leaves) * size))])

        parts = self.state.mapInArrow(add, HISTOGRAM)
        if self.tasks > FEW_TASKS:
            parts = parts.groupBy(F.spark_partition_id() % FEW_TASKS).applyInArrow(join, HISTOGRAM)
        out = _summed(parts.toArrow(), len(leaves) * size)
        return {leaf: out[i * size : (i + 1) * size].reshape(features, bins, 3) for i, leaf in enumerate(leaves)}

    def subtrees(self, leaves: list[int], tree: Tree, splits: int) -> dict[int, list[tuple]]:
        """The best splits below each leaf, every leaf's rows brought together in one task."""
        rows, rules = self.rows({leaf: leaf for leaf in leaves}, tree), self.rules
        names = ["leaf", "n", "codes", "g", "h"]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, slot, g, h in rows(batches):
                out = []
                for leaf in np.unique(slot).tolist():
                    mine = np.flatnonzero(slot == leaf)
                    out.append((leaf, len(mine), _block(_some(codes, mine)), g[mine].tobytes(), h[mine].tobytes()))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=blocks)

        def grow(table: pa.Table) -> pa.Table:
            parts = table.to_pylist()
            codes = np.concatenate([_codes(p["codes"], p["n"]).T for p in parts], axis=1).T
            g, h = (np.concatenate([np.frombuffer(p[c], dtype=np.int64) for p in parts]) for c in "gh")
            found, _ = Held(codes).grown(g, h, splits, rules)
            leaf = table.column("leaf")[0].as_py()
            flat = [(leaf, i, p, side, s.gain, s.feature, s.bin, *s.left, *s.right) for i, (p, side, s) in enumerate(found)]
            return pa.Table.from_pylist([dict(zip(fields, r, strict=True)) for r in flat], schema=kinds)

        fields = ["leaf", "place", "parent", "side", "gain", "feature", "bin", "lg", "lh", "ln", "rg", "rh", "rn"]
        types = [pa.int32()] * 4 + [pa.float64()] + [pa.int32()] * 2 + [pa.int64()] * 6
        kinds = pa.schema(list(zip(fields, types, strict=True)))
        blocks = pa.schema(list(zip(names, [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)))
        schema = ", ".join(f"{f} {t}" for f, t in zip(fields, ["int"] * 4 + ["double"] + ["int"] * 2 + ["bigint"] * 6, strict=True))
        sent = self.state.mapInArrow(send, "leaf int, n int, codes binary, g binary, h binary")
        sent = sent.repartition(min(len(leaves), self.tasks), "leaf")  # one task would grow all small leaves otherwise
        out: dict[int, list[tuple]] = {leaf: [] for leaf in leaves}
        found = sent.groupBy("leaf").applyInArrow(grow, schema).collect()  # at most ``splits`` rows per leaf
        for r in sorted(found, key=lambda r: (r["leaf"], r["place"])):
            split = Split(r["gain"], r["feature"], r["bin"], (r["lg"], r["lh"], r["ln"]), (r["rg"], r["rh"], r["rn"]))
            out[r["leaf"]].append((r["parent"], r["side"], split))
        return out


@dataclass(frozen=True)
class Step:
    """A split as it was chosen: the left part keeps the leaf's number, the right one gets the step's."""

    leaf: int
    split: Split


def replay(root: Node, leaves: int) -> tuple[list[tuple[Node, int]], list[Node] | None]:
    """Splits best leaf first as far as they can be told: (node, leaf number), and the nodes whose children have to be
    looked at next; None if the tree is finished.

    Besides the node at which it stopped these are the leaves that can still have their turn: there are no more of them
    than splits left to choose.
    """
    waiting = [(-root.split.gain, 0, root)] if root.split else []
    chosen: list[tuple[Node, int]] = []
    while waiting and len(chosen) < leaves - 1:
        _, number, node = heapq.heappop(waiting)
        chosen.append((node, number))
        if len(chosen) == leaves - 1:
            break
        if not all(child.known for child in node.children):
            likely = heapq.nsmallest(leaves - 1 - len(chosen), waiting)
            return chosen, [node, *(n for _, _, n in likely if not all(c.known for c in n.children))]
        for child, own in zip(node.children, (number, len(chosen)), strict=True):
            if child.split:
                heapq.heappush(waiting, (-child.split.gain, own, child))
    return chosen, None


def _structure(root: Node) -> tuple[Tree, dict[int, int]]:
    """All nodes found so far as a tree, and where each node without a split is in it."""
    tree, ends = Tree(), {}

    def add(node: Node) -> int:
        at = tree.leaf()
        if node.split:
            tree.feature[at], tree.bin[at] = node.split.feature, node.split.bin
            tree.left[at] = add(node.children[0])
            tree.right[at] = add(node.children[1])
        else:
            ends[id(node)] = at
        return at

    add(root)
    return tree, ends


def _adopt(node: Node, splits: list[tuple]) -> list[Node]:
    """Hangs the splits that a task found below ``node`` and returns what they split; below the last of them nothing can be chosen."""
    made: list[Node] = []
    node.settle(None)
    for parent, side, split in splits:
        at = node if parent < 0 else made[parent].children[side]
        at.settle(split)
        made.append(at)
        for child in at.children:
            child.known = True
    return made


def _look(this: Round, root: Node, parents: list[Node], splits: int, step_rows: int) -> None:
    """Finds the best splits of the children of ``parents`` (of the root itself if there are none), in one job.

    As long as one of them is large, all are counted, as that costs less than bringing the rows of the small ones together.
    """
    tree, ends = _structure(root)
    nodes = [c for p in parents for c in p.children if not c.known] if parents else [root]
    if all(n.rows <= step_rows for n in nodes):
        found = this.subtrees([ends[id(n)] for n in nodes], tree, splits)
        for node in nodes:
            _adopt(node, found[ends[id(node)]])
        return
    # of two children the smaller one is counted, the other is what is left of the parent
    pairs = [(p, *sorted(p.children, key=lambda n: n.rows)) for p in parents if any(c in nodes for c in p.children)]
    counted = [less for _, less, _ in pairs] if parents else nodes
    found = this.histograms([ends[id(n)] for n in counted], tree)
    for node in counted:
        node.histogram = found[ends[id(node)]]
    for parent, less, more in pairs:
        more.histogram = parent.histogram - less.histogram
    for node in nodes:
        node.settle(best_split(node.histogram, this.rules))


def grow_tree(this: Round, rows: int, growth: Growth) -> tuple[Tree, list[Step]]:
    """A tree over ``rows`` rows, and its splits in the order they were chosen."""
    root = Node((0, 0, rows))
    _look(this, root, [], growth.leaves - 1, growth.step_rows)
    while True:
        chosen, parents = replay(root, growth.leaves)
        if parents is None:
            break
        _look(this, root, parents, growth.leaves - 1 - len(chosen), growth.step_rows)
    tree, steps, _ = _finished(root, chosen, growth)
    return tree, steps


def _finished(root: Node, chosen: list[tuple[Node, int]], growth: Growth) -> tuple[Tree, list[Step], dict[int, int]]:
    """The tree of the chosen splits, these in their order, and where each node is in the tree."""
    tree, steps = Tree(), []
    place = {id(root): tree.leaf()}
    for node, number in chosen:
        steps.append(Step(number, node.split))
        at = place[id(node)]
        tree.feature[at], tree.bin[at] = node.split.feature, node.split.bin
        for child, side in zip(node.children, (tree.left, tree.right), strict=True):
            g, h, _ = child.total
            side[at] = place[id(child)] = tree.leaf(-growth.learning_rate * g / h)
    return tree, steps, place


def trees_by_steps(state: DataFrame, rows: int, scale: int, rules: list[Rules], growth: Growth) -> list[Tree]:
    """A tree by each of ``rules``, or as many as gain anything, over a table of any size."""
    tasks = state.rdd.getNumPartitions()
    trees: list[Tree] = []
    for of_tree in rules:
        tree, steps = grow_tree(Round(state, tuple(trees), scale, of_tree, tasks), rows, growth)
        if not steps:
            break
        trees.append(tree)
    return trees


# many trees in one task ---------------------------------------------------------------------------------

TREES = "feature array<int>, bin array<int>, left array<int>, right array<int>, value array<double>"


def trees_of_one_task(state: DataFrame, scale: int, rules: list[Rules], growth: Growth) -> list[Tree]:
    """A tree by each of ``rules``, or as many as gain anything, grown after one another by a task that holds all rows."""
    names = list(Tree.__dataclass_fields__)
    kinds = pa.schema([(c, pa.list_(pa.float64() if c == "value" else pa.int32())) for c in names])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = list(_blocks(batches))
        if not blocks:
            return
        held = Held(np.concatenate([codes.T for codes, *_ in blocks], axis=1).T)
        label, weight, margin = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3))
        del blocks
        for of_tree in rules:
            g, h = derivatives(label, weight, margin, scale)
            found, ends = held.grown(g, h, growth.leaves - 1, of_tree)
            if not found:
                return
            root = Node((0, 0, len(label)))
            made = _adopt(root, found)
            tree, _, place = _finished(root, replay(root, growth.leaves)[0], growth)
            for (parent, side), rows in ends.items():
                margin[rows] += tree.value[place[id(made[parent].children[side])]]
            yield pa.RecordBatch.from_pylist([{c: getattr(tree, c) for c in names}], schema=kinds)

    found = state.coalesce(1).mapInArrow(grow, TREES).toArrow().to_pylist()  # in their order, as one task made them
    return [Tree(**row) for row in found]


# the model ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostedTrees:
    columns: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def probability(self) -> Column:
        """The probability of class 1 from the feature columns; NULLs count as 0."""
        edges, trees, base = self.edges, self.trees, self.base

        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            codes = codes_of(_matrix(values), edges)
            margin = np.full(len(codes), base)
            for tree in trees:
                margin += tree.values_of(codes)
            return pa.array(sigmoid(margin))

        return score(F.array(*[_value(c) for c in self.columns]))

    def transform(self, features: DataFrame, name: str = "raw_probability") -> DataFrame:
        importable(features.sparkSession)
        return features.withColumn(name, self.probability())

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes, edges and base as three tables below ``path``."""
        nodes = [
            (t, i, *(int(getattr(tree, c)[i]) for c in ("feature", "bin", "left", "right")), float(tree.value[i]))
            for t, tree in enumerate(self.trees)
            for i in range(len(tree.feature))
        ]
        edges = [(c, f, i, float(e)) for f, (c, es) in enumerate(zip(self.columns, self.edges, strict=True)) for i, e in enumerate(es)]
        names = [(i, c, self.base) for i, c in enumerate(self.columns)]
        schema = "tree int, node int, feature int, bin int, left int, right int, value double"
        spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame(edges, "name string, feature int, position int, edge double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/edges")
        spark.createDataFrame(names, "feature int, name string, base double").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/columns"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        names = spark.read.parquet(f"{path}/columns").orderBy("feature").collect()
        edges: list[list[float]] = [[] for _ in names]
        for r in spark.read.parquet(f"{path}/edges").orderBy("feature", "position").collect():
            edges[r["feature"]].append(r["edge"])
        trees: list[Tree] = []
        for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
            if r["node"] == 0:
                trees.append(Tree())
            at = trees[-1].leaf(r["value"])
            for c in ("feature", "bin", "left", "right"):
                getattr(trees[-1], c)[at] = r[c]
        base = names[0]["base"] if names else 0.0
        return BoostedTrees([r["name"] for r in names], [np.array(e) for e in edges], base, trees)


def _state_row(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    columns = {"label": label, "weight": weight, "margin": margin}
    first = {"n": pa.array([len(codes)], pa.int32()), "codes": [_block(codes)]}
    return pa.RecordBatch.from_pydict(first | {c: [v.tobytes()] for c, v in columns.items()})


def coded(rows: DataFrame, columns: Sequence[str], edges: list[np.ndarray], label: str, weight: str, margin: float) -> DataFrame:
    """The rows of ``STATE``: bin numbers, label, weight and the margin to begin with."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = (batch.column(i).to_numpy() for i in (1, 2))
                yield _state_row(codes_of(_matrix(batch.column(0)), edges), *columns, np.full(batch.num_rows, margin))

    values = F.array(*[_value(c) for c in columns]).alias("values")
    plain = rows.select(values, F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight"))
    return plain.mapInArrow(encode, STATE)


def with_margins(state: DataFrame, trees: Sequence[Tree]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, label, weight, margin in _blocks(batches):
            margin = margin.copy()
            for tree in trees:
                margin += tree.values_of(codes)
            yield _state_row(codes, label, weight, margin)

    return state.mapInArrow(add, STATE)


def start(
    rows: DataFrame, columns: Sequence[str], label: str, weight: str, growth: Growth
) -> tuple[DataFrame, list[np.ndarray], float, int, int]:
    """Coded rows (written), edges, the margin to begin with, the scale of gradients and the number of rows."""
    spark = rows.sparkSession
    importable(spark)
    edges = collected_edges(bin_edges(rows, columns, growth.bins), columns)
    sums = rows.agg(
        F.sum(F.col(weight)).alias("w"), F.sum(F.col(weight) * F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).alias("n")
    ).first()
    share = min(max(sums["y"] / sums["w"], 1e-15), 1 - 1e-15)
    base = math.log(share / (1 - share))
    base = 0.0 if abs(base) < 1e-12 else base  # balanced weights
    tasks = max(1, min(spark.sparkContext.defaultParallelism, sums["n"] // BLOCK_TASK_ROWS))
    state = _kept(coded(rows, columns, edges, label, weight, base).repartition(tasks))  # whole blocks move
    return state, edges, base, scale_for(sums["w"]), sums["n"]


def _kept(state: DataFrame) -> DataFrame:
    path = fresh_path(state.sparkSession, "boosting")
    state.write.parquet(path)
    return state.sparkSession.read.schema(STATE).parquet(path)


def _dropped(state: DataFrame) -> None:
    """The end of a table that ``_kept`` returned."""
    files = state.inputFiles()
    state.unpersist()
    if files:
        remove(state.sparkSession, files[0].rsplit("/", 1)[0])


def scale_for(weight: float) -> int:
    """Binary digits of a gradient behind the point: sums of all rows stay within 63 bits."""
    return min(32, 61 - max(0, math.ceil(math.log2(weight + 1))))


def rules_for(growth: Growth, tree: int, columns: Sequence[str], edges: Sequence[np.ndarray], scale: int) -> Rules:
    bins = max((len(e) for e in edges), default=0) + 1
    chosen = tuple(growth.columns(tree, columns))
    return Rules(chosen, len(columns), bins, growth.least_rows, growth.least_hessian, math.ldexp(1.0, -scale))


def fit(rows: DataFrame, columns: Sequence[str], label: str, weight: str, growth: Growth = Growth()) -> BoostedTrees:
    """Boosted trees for a label of 0 and 1 on ``columns``; NULL values count as 0.

    Margins are written every ``WRITE_EVERY`` trees, so a lost executor costs a read and a few trees, not the fit; where one task
    grows the trees, every ``TASK_TREES``.
    """
    state, edges, base, scale, count = start(rows, columns, label, weight, growth)
    in_task = count <= growth.step_rows
    at_once = TASK_TREES if in_task else WRITE_EVERY
    trees: list[Tree] = []
    while len(trees) < growth.trees:
        numbers = range(len(trees), min(len(trees) + at_once, growth.trees))
        rules = [rules_for(growth, number, columns, edges, scale) for number in numbers]
        if in_task:
            since = trees_of_one_task(state, scale, rules, growth)
        else:
            since = trees_by_steps(state.persist(), count, scale, rules, growth)
        trees += since
        if len(since) < len(numbers) or len(trees) == growth.trees:
            break  # nothing is left to gain, or all are there
        before, state = state, _kept(with_margins(state, since))
        _dropped(before)
    _dropped(state)
    return BoostedTrees(list(columns), edges, base, trees)


def first_tree(rows: DataFrame, columns: Sequence[str], label: str, weight: str, growth: Growth = Growth()) -> DataFrame:
    """The splits of the first tree as they were chosen: step, leaf, feature, edge, gain, left_rows, right_rows.

    The left part keeps the leaf's number (the root has 0), the right one gets the number of the step.
    """
    state, edges, _, scale, count = start(rows, columns, label, weight, growth)
    state = state.persist()
    this = Round(state, (), scale, rules_for(growth, 0, columns, edges, scale), state.rdd.getNumPartitions())
    _, steps = grow_tree(this, count, growth)
    _dropped(state)
    found = [
        (i, s.leaf, columns[s.split.feature], float(edges[s.split.feature][s.split.bin]), s.split.gain, s.split.left[2], s.split.right[2])
        for i, s in enumerate(steps, 1)
    ]
    schema = "step int, leaf int, feature string, edge double, gain double, left_rows bigint, right_rows bigint"
    return rows.sparkSession.createDataFrame(found, schema)
