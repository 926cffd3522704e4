"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from creditloom.session import fresh_path

SLICE_BYTES = 8 << 20  # text that one step of a task holds in decoded form


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they start in another folder; elsewhere ship it as usual."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in smaller batches with about ``limit`` bytes in column number ``text``.

    A row is never split: a longer text makes a batch of its own.
    """
    for batch in batches:
        begin = size = 0
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for row, length in enumerate(lengths):
            if row > begin and size + length > limit:
                yield batch.slice(begin, row - begin)
                begin, size = row, 0
            size += length
        if begin < batch.num_rows:
            yield batch.slice(begin)


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
WIDE = 256  # rows of texts or token sets that the JVM hands to a Python worker at once


def written(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows never computes it a second time.

    ``batch`` is how many rows a Python worker gets at once meanwhile: the JVM holds them all outside its heap.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if _made.get() is not None:
        _made.get().append(path)
    before = spark.conf.get(BATCH)
    if batch is not None:
        spark.conf.set(BATCH, min(batch, int(before)) if int(before) > 0 else batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``build`` returns, written; the tables that it wrote on the way are deleted then."""
    made: list[str] = []
    before = _made.set(made)
    try:
        path = fresh_path(spark, label)
        df = build()
        df.write.parquet(path)
    finally:
        _made.reset(before)
    if before.old_value is not before.MISSING and before.old_value is not None:
        before.old_value.append(path)
    for each in made:
        place = spark._jvm.org.apache.hadoop.fs.Path(each)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return spark.read.schema(df.schema).parquet(path)
