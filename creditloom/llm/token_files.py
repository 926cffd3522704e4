"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Files follow each other in document order, one per range partition, rows sorted in each. A reader opens stripes in
parallel and skips those whose statistics or Bloom filter rule a document out. Where a document begins
in the stream of all ids is its place in its file plus the ids of earlier files, which are one sum per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditloom.llm.common import slices
from creditloom.llm.tokens import chunk_ids

END = (2).to_bytes(4, "little")
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000  # rows between index entries; a document is a row, so entries are kept close
FALSE_POSITIVES = 0.01
FILE_SCHEMA = "doc_id bigint, file int, local_start bigint, ids array<int>"


def encode(docs: DataFrame, path: str, end: bytes = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, file, local_start and ids, range-partitioned and sorted by doc_id (null first), then text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start = chunk_ids(path), 0
        for batch in slices(batches, 2):
            found = [ids.text(body) + end for body in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(start + ends[:-1]),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values),
                ],
                ["doc_id", "file", "local_start", "ids"],
            )
            start += int(ends[-1])

    ranged = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", F.spark_partition_id().alias("file"), "text")
    )
    return ranged.mapInArrow(rows, FILE_SCHEMA)


def write(encoded: DataFrame, folder: str) -> None:
    (
        encoded.write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", FALSE_POSITIVES)
        .option("compression", "zstd")
        .orc(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids; a filter on doc_id reaches the files."""
    stored = spark.read.schema(FILE_SCHEMA).orc(folder)
    ends = stored.groupBy("file").agg(F.max(F.col("local_start") + F.size("ids")).alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = ends.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    joined = stored.join(F.broadcast(starts), F.col("file") == F.col("_file"))
    return joined.select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            arrays = [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
