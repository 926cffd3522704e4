"""What the two repeated-passage operators share: document keys, runs of windows, and texts fetched again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import written

BITS = 1 << 24  # of the bitmap that keeps most unneeded texts out of a shuffle; its size doesn't depend on the data
PER_BUCKET = 32768  # bits in a row of Spark's bitmap functions
LAST = 2**63 - 1  # the place of a null doc_id: behind all others


def keyed(docs: DataFrame) -> DataFrame:
    """place (doc_id, null last), text_hash, doc_id, text."""
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    return docs.select(
        place.alias("place"), F.xxhash64("text").alias("text_hash"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")
    )


def sliding(values: np.ndarray, size: int, best=np.minimum) -> np.ndarray:
    """The smallest (or with ``best`` the largest) of every ``size`` neighbours."""
    out, width = values, 1
    while 2 * width <= size:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(out) - (size - width)], out[size - width :]) if size > width else out


def runs(least: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours, cut after ``longest``."""
    n = len(least)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if n else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, n))
    if n and lengths.max() > longest:
        pieces = -(-lengths // longest)
        first = np.repeat(starts, pieces)
        number = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + lengths, pieces)
        starts = first + number * longest
        lengths = np.minimum(longest, ends - starts)
    return starts, lengths


def with_texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """``keys`` (place, text_hash unique, and more) with ``text``; one row per key even where documents are repeated.

    A bitmap of fixed size over the wanted text hashes drops most other texts before they are shuffled.
    """
    keys = written(keys, "wanted")  # read for the bitmap and for the join
    bit = F.pmod("text_hash", F.lit(BITS))
    maps = (
        keys.select(bit.alias("b"))
        .groupBy(F.expr(f"b div {PER_BUCKET}").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.expr(f"b % {PER_BUCKET}")).alias("bits"))
        .collect()  # BITS / PER_BUCKET rows of 4 KB at most
    )
    wanted = np.zeros(BITS // 8, dtype=np.uint8)
    for row in maps:
        at = row["bucket"] * PER_BUCKET // 8
        wanted[at : at + PER_BUCKET // 8] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() % BITS
            keep = wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1
            if keep.any():
                yield batch.filter(pa.array(keep.astype(bool)))

    texts = keyed(docs).select("place", "text_hash", "text").mapInArrow(some, "place bigint, text_hash bigint, text string")
    return keys.join(texts, ["place", "text_hash"]).dropDuplicates(["place", "text_hash"])


def spans_by_document(spans: DataFrame) -> DataFrame:
    """place, text_hash and the spans (start, length) of a document: as many as it has runs at most."""
    return spans.groupBy("place", "text_hash").agg(F.collect_list(F.struct("start", "length")).alias("spans"))


def marked(n: int, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` units are covered by windows of ``size`` units starting in [start, start + length)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + lengths - 1 + size, n), -1)
    return np.cumsum(change[:n]) > 0


def lists(column: pa.Array, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths per row of an array<struct<start, length>> column."""
    ends = column.offsets.to_numpy()
    start, length = (column.values.field(i).to_numpy() for i in (0, 1))
    for i in range(rows):
        part = slice(ends[i], ends[i + 1])
        yield start[part], length[part]


