"""One or a few rows per key, safe for keys that hold a large share of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    # Spark keeps only n rows per key in every map task before the shuffle (WindowGroupLimit).
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str = "rank",
    spread_by: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """The first ``n`` rows of every key under ``order``, with their rank from 1.

    Map tasks already drop what cannot be among the first n, so the reducer of a hot key gets at
    most n rows per map task. For a large n that is still too much for one reducer: ``spread_by``
    names a column whose hash splits the key into ``salts`` groups that are cut to n first.
    """
    if spread_by is not None and salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)))
        df = _ranked(salted, [*keys, "_salt"], order, n, "_local_rank").drop("_salt", "_local_rank")
    return _ranked(df, keys, order, n, rank)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key; by default the smallest row over all other columns, never an arbitrary one.

    Rows are sorted by a hash of the key first, a number that settles nearly every comparison on its own: key and
    other columns are compared only among rows of one key.
    """
    if order is None:
        order = [F.col(c).asc_nulls_first() for c in df.columns if c not in set(keys)]
    hashed = df.withColumn("_key", F.xxhash64(*keys))
    return _ranked(hashed, ["_key", *keys], order or [F.lit(1)], 1, "_rank").drop("_rank", "_key")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key; NULLs in the order columns count as oldest."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that names one of the repeated keys."""
    repeated = duplicate_keys(df, keys).limit(1).collect()
    if repeated:
        raise ValueError(f"duplicate key {repeated[0].asDict()}")
    return df


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces the rows of ``old`` with the same key."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new)
