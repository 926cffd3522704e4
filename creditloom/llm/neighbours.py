"""Nearest neighbours by multiprobe p-stable hashing.

A table's bucket is the cell of a few Gaussian projections, cut into steps of equal width. A query looks into its own
bucket and into perturbed ones (one step up or down in some projections) in the order in which they are likely to hold
near vectors: boundaries are ranked by distance, and sets of them by their expected squared distance. Candidates
of all tables are merged and ranked by the exact distance of the original vectors.

Width and number of probes are fitted on a bounded sample; the index holds every vector. Buckets are cut into
blocks, so a common bucket is many small searches, and a block gives each query its ``k`` best at most. A query that
found fewer than ``k`` looks into all blocks of one table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import written

TABLES = 4
PROJECTIONS = 4
SAMPLE = 2000  # vectors the width and the number of probes are fitted on
TARGET = 0.95  # share of the sample's neighbours that probes have to reach
BLOCK = 2048  # vectors in a block, about
SEED = 11


class Hashes(NamedTuple):
    directions: np.ndarray  # (tables, dimensions, projections)
    offsets: np.ndarray  # (tables, projections), in steps
    width: float
    probes: list[tuple[int, ...]]


def probe_order(projections: int, most: int) -> list[tuple[int, ...]]:
    """Sets of boundaries by rank (0 nearest), in order of expected squared distance; the own bucket first."""
    m = projections
    cost = [
        j * (j + 1) / (4 * (m + 1) * (m + 2))
        if j <= m
        else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
        for j in range(1, 2 * m + 1)
    ]
    out: list[tuple[int, ...]] = [()]
    waiting = [(cost[0], (0,))]
    while waiting and len(out) < most:
        total, ranks = heapq.heappop(waiting)
        if not any(2 * m - 1 - r in ranks for r in ranks):  # not both sides of one projection
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(waiting, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(waiting, (total + cost[last + 1], (*ranks, last + 1)))
    return out


def steps(hashes: Hashes, vectors: np.ndarray, table: int) -> np.ndarray:
    return vectors @ hashes.directions[table] / hashes.width + hashes.offsets[table]


def bucket_names(cells: np.ndarray) -> np.ndarray:
    """One number per cell tuple."""
    name = np.zeros(cells.shape[:-1], dtype=np.int64)
    for i in range(cells.shape[-1]):
        name = name * 4099 + (np.clip(cells[..., i], -2000, 2000).astype(np.int64) + 2001)
    return name


def probed(hashes: Hashes, vectors: np.ndarray, table: int) -> np.ndarray:
    """(vectors, probes) bucket names in the order of probing."""
    place = steps(hashes, vectors, table)
    cell = np.floor(place)
    inside = place - cell
    m = cell.shape[1]
    near = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
    out = np.empty((len(vectors), len(hashes.probes)), dtype=np.int64)
    every = np.arange(len(vectors))
    for p, ranks in enumerate(hashes.probes):
        moved = cell.copy()
        for r in ranks:
            side = near[:, r]
            moved[every, side % m] += np.where(side < m, -1, 1)
        out[:, p] = bucket_names(moved)
    return out


def fit(sample: np.ndarray, k: int, tables: int = TABLES, projections: int = PROJECTIONS, target: float = TARGET) -> Hashes:
    """Width: 1.4 times the sample's median distance to its k-th neighbour. Probes: as many as reach the target."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(tables, sample.shape[1], projections))
    offsets = rng.uniform(0, 1, size=(tables, projections))
    square = (sample**2).sum(axis=1)
    distance = np.maximum(square[:, None] + square[None] - 2 * sample @ sample.T, 0)
    np.fill_diagonal(distance, np.inf)
    k = min(k, len(sample) - 1)
    nearest = np.argsort(distance, axis=1, kind="stable")[:, :k]
    far = float(np.sqrt(np.median(distance[np.arange(len(sample)), nearest[:, -1]]))) if k else 1.0
    full = Hashes(directions, offsets, 1.4 * (far or 1.0), probe_order(projections, 3**projections))
    if not k:
        return full
    # the probe at which each neighbour is first met in any table
    met = np.full((len(sample), k), len(full.probes))
    for table in range(tables):
        own = bucket_names(np.floor(steps(full, sample, table)))
        looks = probed(full, sample, table)
        for p in range(looks.shape[1]):
            hit = looks[:, p][:, None] == own[nearest]
            met = np.where(hit & (met > p), p, met)
    reach = [(met <= p).mean() for p in range(len(full.probes))]
    enough = next((p for p, r in enumerate(reach) if r >= target), len(full.probes) - 1)
    return full._replace(probes=full.probes[: enough + 1])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, vector, distance) of the k nearest vectors of each query, itself left out; ties to the smaller id."""
    square = (queries**2).sum(axis=1)[:, None] + (vectors**2).sum(axis=1)[None] - 2 * queries @ vectors.T
    square[ids[:, None] == names[None]] = np.inf
    slack = 1e-9 * (1 + np.abs(square[np.isfinite(square)]).max(initial=0))
    for q in range(len(queries)):
        row = square[q]
        limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
        some = np.flatnonzero((row <= limit + slack) & np.isfinite(row))
        exact = np.sqrt(((vectors[some] - queries[q]) ** 2).sum(axis=1))
        for i in np.lexsort((names[some], exact))[:k]:
            yield int(ids[q]), int(names[some[i]]), float(exact[i])


def usable(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, embedding (doubles) of vectors that take part; equal rows once, vectors of the commonest length only."""
    real = f"`{embedding}` is not null and size(`{embedding}`) > 0 and `{vec_id}` is not null"
    finite = "x is not null and not isnan(x) and abs(x) < double('infinity')"
    plain = (
        table.where(real)
        .select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
        .where(F.expr(f"forall(embedding, x -> {finite}) and exists(embedding, x -> x <> 0)"))
    )
    length = plain.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return plain.where(F.size("embedding") == (length["d"] if length else 0)).dropDuplicates(["vec_id", "embedding"])


RESULT = "query_id long, vec_id long, score double"


def searched(indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each block. Both have table, bucket, block, id and embedding."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, vectors, names = None, [], []
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            ids, data = batch.column(4).to_numpy(), matrix(batch.column(5))
            a = 0
            for b in range(1, len(keys) + 1):
                if b == len(keys) or keys[b] != keys[a]:
                    if keys[a][:3] != key:
                        key, vectors, names = keys[a][:3], [], []
                    if keys[a][3]:
                        if vectors:
                            yield data[a:b], ids[a:b], np.concatenate(vectors), np.concatenate(names)
                    else:
                        vectors.append(data[a:b])
                        names.append(ids[a:b])
                    a = b

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for queries, ids, vectors, names in groups(batches):
            found = list(zip(*best(queries, ids, vectors, names, k), strict=True)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    key = ["table", "bucket", "block"]
    both = indexed.select(*key, F.lit(False).alias("asks"), "vec_id", "embedding").unionByName(
        asked.select(*key, F.lit(True).alias("asks"), "vec_id", "embedding")
    )
    return both.repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(rows, RESULT)


def top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    table: DataFrame, queries: str, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest vectors found for each query.

    ``queries`` is a condition on vec_id. Vectors that are null, zero, or hold null or non-finite numbers take no part,
    nor do rows without an id. Of equal vectors the k + 1 smallest ids are enough for any result. Without a
    candidate a query has no row.
    """
    everything = written(usable(table, vec_id, embedding), "vectors")
    order = Window.partitionBy("embedding").orderBy("vec_id")
    vectors = everything.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")
    chosen = everything.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # ``sample`` rows at most
    hashes = fit(np.array([r["embedding"] for r in chosen]) if chosen else np.zeros((1, 1)), k)
    tables = len(hashes.directions)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(tables):
                cells = np.floor(steps(hashes, matrix(batch.column(1)), t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), t, np.int32)), pa.array(bucket_names(cells)), batch.column(0), batch.column(1)],
                    ["table", "bucket", "vec_id", "embedding"],
                )

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(tables):
                looks = probed(hashes, matrix(batch.column(1)), t)
                owner = pa.array(np.repeat(np.arange(len(looks)), looks.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(looks.size, t, np.int32)), pa.array(looks.reshape(-1)), *[batch.column(i).take(owner) for i in (0, 1)]],
                    ["table", "bucket", "vec_id", "embedding"],
                )

    schema = "table int, bucket bigint, vec_id bigint, embedding array<double>"
    filed = vectors.mapInArrow(index, schema)
    blocks = filed.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = written(blocks, "buckets")
    indexed = filed.join(blocks, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = everything.where(queries)
    numbers = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    looked = asked.mapInArrow(probes, schema).join(blocks, ["table", "bucket"]).select("table", "bucket", "vec_id", "embedding", numbers)
    first = written(top(searched(indexed, looked, k), k), "nearest")

    full = first.groupBy("query_id").count().where(F.col("count") >= k)
    short = asked.join(full, F.col("vec_id") == F.col("query_id"), "left").withColumn("table", F.expr("if(query_id is null, 0, null)"))
    every = short.join(blocks, "table").select("table", "bucket", "vec_id", "embedding", numbers)
    second = top(searched(indexed.where("table = 0"), every, k), k)
    rest = second.join(full.select("query_id"), "query_id", "left_anti")
    return first.join(full.select("query_id"), "query_id", "left_semi").unionByName(rest)
