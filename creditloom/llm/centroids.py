"""Centroid clustering (Lloyd rounds in whole numbers) by a tournament of bisectors.

The bisector of two centroids is a plane; the side a vector lies on says which of the two is nearer. For centroids
i < j the normal ``2 (c_j - c_i)`` and the threshold ``|c_j|^2 - |c_i|^2`` are whole numbers, and j wins only where
``normal . x > threshold``: zero favours the smaller number. A vector's nearest centroid is the winner of k - 1 such
tests, played as rounds of pairs. Only the winner's distance is computed, in whole numbers as well.

Vectors are dealt out by Spark and stay where they are. Tasks return one row of counts and sums per centroid, so a
cluster that holds most vectors is no larger than any other; the driver sees ``k`` seeds and ``k`` sums a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import written

CENTROIDS = 40
ROUNDS = 5
SCALE = 256
LARGEST = 1 << 27  # of a component's size: products of 64 such components and their sums stay within 64 bits
ROWS = 4096  # vectors that one step of a task compares


class Bisectors(NamedTuple):
    centroids: np.ndarray  # (k, d), int64
    normals: np.ndarray  # (pairs, d), int64
    thresholds: np.ndarray  # (pairs,), int64
    pair: np.ndarray  # (k, k): the number of the pair i < j


def bisectors(centroids: np.ndarray) -> Bisectors:
    k = len(centroids)
    i, j = np.triu_indices(k, 1)
    square = (centroids**2).sum(axis=1)
    pair = np.zeros((k, k), dtype=np.int64)
    pair[i, j] = np.arange(len(i))
    return Bisectors(centroids, 2 * (centroids[j] - centroids[i]), square[j] - square[i], pair)


def winners(planes: Bisectors, vectors: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, ties to the smaller number, by k - 1 sign tests a vector."""
    k = len(planes.centroids)
    everyone = np.broadcast_to(np.arange(k), (len(vectors), k))
    while everyone.shape[1] > 1:
        left, right = everyone[:, 0:-1:2], everyone[:, 1::2]
        odd = everyone[:, -1:] if everyone.shape[1] % 2 else everyone[:, :0]
        won = np.empty(left.shape, dtype=np.int64)
        for place in range(left.shape[1]):
            a, b = left[:, place], right[:, place]
            if everyone.strides[0] == 0:  # the first round: all vectors meet the same planes
                plane = planes.pair[a[0], b[0]] if len(vectors) else 0
                side = vectors @ planes.normals[plane]
            else:
                plane = planes.pair[a, b]
                side = np.einsum("nd,nd->n", planes.normals[plane], vectors)
            won[:, place] = np.where(side > planes.thresholds[plane], b, a)
        everyone = np.concatenate([won, odd], axis=1)
    return everyone[:, 0] if k else np.zeros(len(vectors), dtype=np.int64)


def distances(planes: Bisectors, vectors: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    apart = vectors - planes.centroids[nearest]
    return np.einsum("nd,nd->n", apart, apart)


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)


def whole_numbers(table: DataFrame, dimensions: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, the components as floor(256 * value), of the vectors that take part."""
    scaled = F.transform(F.col(embedding).cast("array<double>"), lambda v: v * F.lit(float(SCALE)))
    plain = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), scaled.alias("scaled"))
    fits = f"v is not null and not isnan(v) and v >= {-LARGEST}.0D and v < {LARGEST}.0D"
    return plain.where(F.expr(f"size(scaled) = {dimensions} and forall(scaled, v -> {fits})")).select(
        "vec_id", F.transform("scaled", lambda v: F.floor(v).cast("bigint")).alias("x")
    )


def seeds(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``salt:vec_id``; equal ids in order of their components."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").withColumn("_order", order).orderBy("_order", "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), len(first[0]["x"]) if first else 0)


def sums(vectors: DataFrame, planes: Bisectors) -> DataFrame:
    """cluster, n and the sums s0, s1, ... of its vectors' components."""
    k, d = planes.centroids.shape
    names = ["cluster", "n", *(f"s{i}" for i in range(d))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, d), dtype=np.int64)
        for _, x in steps(batches):
            nearest = winners(planes, x)
            count += np.bincount(nearest, minlength=k)
            order = np.argsort(nearest, kind="stable")
            present, begin = np.unique(nearest[order], return_index=True)
            if len(present):
                total[present] += np.add.reduceat(x[order], begin, axis=0)
        some = np.flatnonzero(count)
        columns = [some, count[some], *total[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names)

    parts = vectors.mapInArrow(add, ", ".join(f"{c} bigint" for c in names))
    return parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[1:]])


def assigned(vectors: DataFrame, planes: Bisectors) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in steps(batches):
            nearest = winners(planes, x)
            columns = [ids, pa.array(nearest, pa.int64()).cast(pa.int32()), pa.array(distances(planes, x, nearest))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(rows, "vec_id bigint, cluster int, distance bigint")


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: int = 2) -> np.ndarray:
    """Centroids (k or as many as there are vectors, whole numbers) after ``rounds`` rounds over all ``vectors``."""
    centroids = seeds(vectors, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for row in sums(vectors, bisectors(centroids)).collect():  # k rows at most
            n = int(row["n"])
            moved[row["cluster"]] = [int(s) // n for s in row[2:]]
        centroids = moved
    return centroids


def clusters(
    table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = 64, salt: int = 2,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every vector that takes part, and the final centroids.

    Null vectors and vectors of another length, with null or non-finite components or with components of 2^19 and
    more in size (their squared distances pass 64 bits) take no part. Every row counts, repeated ones too. Rows without
    an id are assigned and counted, but are no seeds. An empty table has no centroids and no rows. Other columns are ignored.
    """
    vectors = written(whole_numbers(table, dimensions, vec_id, embedding), "vectors")
    centroids = fit(vectors, k, rounds, salt)
    if not len(centroids):  # nothing, or only rows without an id
        return assigned(vectors.limit(0), bisectors(np.zeros((1, dimensions), dtype=np.int64))), centroids
    return written(assigned(vectors, bisectors(centroids)), "assigned"), centroids


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256."""
    spark = found.sparkSession
    written_out = [",".join(map(str, c)) for c in centroids.tolist()]
    names = [(i, hashlib.sha256(c.encode()).hexdigest()) for i, c in enumerate(written_out)]
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    sizes = {r["cluster"]: int(r["d"]) for r in inertia.collect()}  # a row per centroid
    whole = sum(sizes.values())
    about = spark.createDataFrame(
        [(i, sizes.get(i, 0), whole, sha) for i, sha in names],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return found.join(F.broadcast(about), "cluster").select(  # as many rows as centroids
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
