"""Running totals over keys of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import shared_dir


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    minima: Sequence[str] = (),
) -> DataFrame:
    """Replaces the named columns by their running sum, maximum or minimum, this row included.

    A window over ``keys`` alone would put all rows of a key into one task. Here the rows are
    range-partitioned over keys and order, so a large key spans many partitions; each partition
    computes locally and then adds what earlier partitions of the same key ended with. Those offsets
    are one row per key and partition. ``keys`` may be empty for a total order over the whole table;
    ``order`` has to be unique within a key.

    The partition number becomes data, so the partitioned rows are checkpointed: a lost executor must
    not lead to another partitioning between the two uses.
    """
    shared_dir(df.sparkSession)  # sets the checkpoint folder
    parted = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()).checkpoint()

    kinds: list[tuple[str, object]] = [
        *[(c, F.sum) for c in sums],
        *[(c, F.max) for c in maxima],
        *[(c, F.min) for c in minima],
    ]
    ends = parted.groupBy(*keys, "_part").agg(*[kind(c).alias(f"_end_{c}") for c, kind in kinds])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*keys, "_part", *[kind(f"_end_{c}").over(earlier).alias(f"_offset_{c}") for c, kind in kinds])

    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = parted
    for c, kind in kinds:
        within = within.withColumn(f"_local_{c}", kind(c).over(local))

    def combined(c: str, kind) -> Column:
        here, before = F.col(f"_local_{c}"), F.col(f"_offset_{c}")
        if kind is F.sum:
            return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(here + before)
        return F.greatest(here, before) if kind is F.max else F.least(here, before)

    replaced = {c: combined(c, kind).cast(df.schema[c].dataType).alias(c) for c, kind in kinds}
    joined = within.join(offsets, [*keys, "_part"])
    return joined.select(*[replaced.get(c, F.col(c)) for c in df.columns])
