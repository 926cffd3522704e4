"""Best-fit packing by a linear grouping scheme.

The plan depends on how many pieces have each length, and lengths are at most the capacity, so the driver plans
over one count per length whatever the number of documents. Large lengths are sorted and cut into groups of
equal cardinality, each rounded up to its largest member; a linear programme over these few sizes, solved with
column generation, says how often each configuration is used. The groups' actual pieces then take the places
of the rounded ones, which leaves more room than planned, and what is left is put in by best fit, longest first.

The plan is a list of segments "pieces of this length, ranks lo to hi, go to sequences from s on, so many in each, at
this offset". Ranks are counted on Spark per length and hash salt, so that no length meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import slices, written
from creditloom.llm.tokens import chunk_ids

CAPACITY = 4096
SMALL_SHARE = 1 / 8  # lengths up to this share of the capacity are small
GROUPS = 32
END = (1).to_bytes(4, "little")


class Segment(NamedTuple):
    length: int
    rank: int
    count: int
    sequence: int
    per_sequence: int
    offset: int


# the plan ------------------------------------------------------------------------------------------


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, cut into groups of equal cardinality: [(length, count), ...] each."""
    total = sum(counts.values())
    size, out, room = -(-total // groups), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = size
            took = min(room, left)
            out[-1].append((length, took))
            room, left = room - took, left - took
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity (an unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for i, (size, value) in enumerate(zip(sizes, values, strict=True)):
        if value <= 0:
            continue
        for _ in range(capacity // size):
            with_one = best[: capacity + 1 - size] + value
            better = with_one > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = with_one[better]
            last[size:][better] = i
    # the last item of a cell is right for the value it had when written, so it is followed by value
    taken, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0 and last[room] >= 0:
        taken[last[room]] += 1
        room -= sizes[last[room]]
    return float(values @ taken), taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """How often to use which configuration: the whole part of a basic solution of the linear programme."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    uses = demand / np.diag(basis)
    for _ in range(40 * n):
        prices = np.linalg.solve(basis.T, np.ones(n))
        worth, column = best_configuration(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        limits = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(limits.argmin())
        uses = uses - limits[leave] * step
        uses[leave] = limits[leave]
        basis[:, leave] = column
    return [(int(use + 1e-7), basis[:, i].astype(np.int64)) for i, use in enumerate(uses) if use + 1e-7 >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL_SHARE):
    """Segments that place every piece, and the number of sequences."""
    counts = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("lengths have to be between 1 and the capacity")
    ranks: Counter[int] = Counter()
    segments: list[Segment] = []
    used = 0

    def place(length: int, count: int, sequence: int, per_sequence: int, offset: int) -> None:
        segments.append(Segment(length, ranks[length], count, sequence, per_sequence, offset))
        ranks[length] += count

    if capacity in counts:
        place(capacity, counts[capacity], 0, 1, 0)
        used = counts[capacity]

    large = {length: n for length, n in counts.items() if small * capacity < length < capacity}
    grouped: dict[int, list[tuple[int, int]]] = {}
    for group in linear_groups(large, groups) if large else []:
        grouped.setdefault(group[0][0], []).extend(group)
    rooms: dict[int, list[tuple[int, int]]] = {}  # free room -> runs of sequences
    if grouped:
        sizes = np.array(list(grouped))
        demand = np.array([sum(n for _, n in group) for group in grouped.values()], dtype=float)
        queues = [list(reversed(group)) for group in grouped.values()]
        for times, column in configurations(sizes, demand, capacity):
            slots = [i for i in np.flatnonzero(column) for _ in range(column[i])]
            while times and all(queues[i] for i in slots):
                # as many sequences as the next runs allow; slots of one group share its run
                same = min([times, *(queues[i][-1][1] // max(1, slots.count(i)) for i in set(slots))])
                offset, same_or_one = 0, max(1, same)
                for i in slots:
                    if not queues[i]:
                        continue
                    length, n = queues[i].pop()
                    place(length, same_or_one, used, 1, offset)
                    offset += length
                    if n > same_or_one:
                        queues[i].append((length, n - same_or_one))
                rooms.setdefault(capacity - offset, []).append((used, same_or_one))
                used += same_or_one
                times -= same_or_one

    free = np.zeros(capacity + 1, dtype=bool)
    free[[room for room in rooms]] = True

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            free[room] = True

    for length in sorted(counts, reverse=True):
        left = counts[length] - ranks[length]
        while left:
            fits = int(free[length:].argmax()) + length
            if free[fits]:
                first, n = rooms[fits].pop()
                free[fits] = bool(rooms[fits])
            else:
                fits, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = fits // length
            full = min(n, left // each)
            if full:
                place(length, full * each, first, each, capacity - fits)
                leave(fits - each * length, first, full)
                first, n, left = first + full, n - full, left - full * each
            if n and 0 < left < each:
                place(length, left, first, each, capacity - fits)
                leave(fits - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(fits, first, n)
    return segments, used


# on Spark ------------------------------------------------------------------------------------------


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: bytes = END, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is an empty one: the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(path)
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = ids.text(body) + end
                for n, start in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[start : start + 4 * capacity]
                    rows.append((doc, n, start // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)], PIECE_NAMES
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pack(lengths: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL_SHARE) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored rows with a ``length`` of 1 to ``capacity``.

    The rows are read twice and must be the same both times, so hand over a table, not a computation. Rows of equal
    length are ranked by hash salt and then by all other columns, so repeated rows get places of their own.
    An empty table gives an empty result. ``lengths`` may have any further columns but these three.
    """
    spark = lengths.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in lengths.columns if c != "length"]
    salted = lengths.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    counts = {r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _ = plan(counts, capacity, groups, small)  # at most ``capacity`` counts, whatever the input

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("length").alias("_length"),
        F.col("_salt").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*others))
    ranked = (
        salted.withColumn("_local", local)
        .join(starts, F.expr("length = _length and _salt = _of"))
        .withColumn("_rank", F.col("_start") + F.col("_local") - 1)
        .select(*lengths.columns, "_rank")
    )
    return ranked.mapInArrow(placed_by(segments), place_schema(lengths))


def place_schema(lengths: DataFrame) -> str:
    columns = [f"`{name}` {kind}" for name, kind in lengths.dtypes]
    return ", ".join([*columns, "sequence_id bigint", "offset bigint"])


def placed_by(segments: list[Segment]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Looks up each row's segment by (length, rank)."""
    table = np.array(sorted(segments), dtype=np.int64).reshape(-1, len(Segment._fields))
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False)
            found = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            at = rank - found[:, 1]
            out = {n: batch.column(i) for i, n in enumerate(names) if n != "_rank"}
            out["sequence_id"] = pa.array(found[:, 3] + at // found[:, 4])
            out["offset"] = pa.array(found[:, 5] + at % found[:, 4] * length)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return place


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises documents, cuts those longer than ``capacity`` and packs the pieces.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are one end id;
    a null doc_id stays null; other columns are ignored.
    """
    return pack(written(pieces(docs, path, capacity), "pieces"), capacity)
