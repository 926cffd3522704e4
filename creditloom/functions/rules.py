"""Rule tables as SQL text: one array expression, parsed and evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: str) -> str:
    """A SQL text constant."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def struct(fields: Mapping[str, str]) -> str:
    """A SQL struct from field names and SQL expressions."""
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def texts(**values: str) -> str:
    """A SQL struct of text constants."""
    return struct({name: text(value) for name, value in values.items()})


def cases(rules: Iterable[tuple[str, str]]) -> str:
    """A SQL array with one entry per rule: the rule's struct, or NULL where its condition fails."""
    return "array(" + ", ".join(f"CASE WHEN {condition} THEN {entry} END" for condition, entry in rules) + ")"


def fired(rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The structs of the rules that hold, in the order given; just ``default`` if there are none."""
    rules = list(rules)
    if default is not None:
        none = " AND ".join(f"NOT coalesce({condition}, false)" for condition, _ in rules)
        rules.append((none, default))
    return F.expr(f"filter({cases(rules)}, entry -> entry IS NOT NULL)")


def first_entries(entries: Column, limit: int | None) -> Column:
    """The first ``limit`` entries of an array, or all."""
    return entries if limit is None else F.slice(entries, 1, limit)


def ranked(df, array: str, rank: str = "rank"):
    """One row per array entry, its fields as columns and its place counted from 1."""
    keep = [c for c in df.columns if c != array]
    flat = df.select(*keep, F.posexplode(array).alias("_place", "_entry"))
    return flat.select(*keep, (F.col("_place") + 1).alias(rank), "_entry.*")
