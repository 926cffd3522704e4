"""Sources and sinks on files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions.scoring import ScoringConfig
from creditloom.operators import serving
from creditloom.operators.keyed import last_per_key, require_unique


def scan_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table stored as one parquet file or folder ``name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _typed(name: str, kind: str) -> Column:
    """A text column as ``kind``; whole numbers may be written ``1``, ``1.0``, ``" 1 "`` or ``1e0``."""
    text = F.trim(F.col(f"`{name}`"))
    if kind in ("int", "long"):
        whole = text.try_cast("double")
        return F.coalesce(text.try_cast(kind), F.when(whole == F.rint(whole), whole).try_cast(kind)).alias(name)
    return (F.col(f"`{name}`") if kind == "string" else text.try_cast(kind)).alias(name)


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; only rows with a wrong number of fields are dropped.

    With ``schema`` its columns are found by name, read as text and converted value by value: a value that is no
    number is NULL, and a column that the file doesn't have is NULL. Without it types are inferred, which is an extra pass.
    """
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    rows = reader.csv(path)
    kinds = dict(field.split() for field in schema.split(","))
    missing = {name: F.lit(None).cast("string") for name in kinds if name not in rows.columns}
    return rows.withColumns(missing).select(*[_typed(name, kind) for name, kind in kinds.items()])


def scan_layer(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{layer}/{table}")


def scan_projected(df: DataFrame, columns: Sequence[str], **equals) -> DataFrame:
    """Columns and equality filters; both reach the parquet scan."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.select(*columns)


def scan_last_wins(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last value per key, as a lookup table built row by row would hold."""
    return last_per_key(df, [key], order).select(key, *columns)


def scan_scoring_config(spark: SparkSession, path: str) -> DataFrame:
    """field, text and number (where the text is one) of a metadata document; missing parts take their defaults."""
    keys = ScoringConfig.keys()
    sections: dict[str, list[str]] = {}
    for section, key, _ in keys:
        sections.setdefault(section, []).append(f"{key}: string")
    schema = ", ".join(f"{section} struct<{', '.join(fields)}>" for section, fields in sections.items())
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    defaults = ScoringConfig()
    rows = [
        F.struct(
            F.lit(name).alias("field"),
            F.coalesce(F.col(f"{section}.{key}"), F.lit(getattr(defaults, name)).cast("string")).alias("text"),
        )
        for section, key, name in keys
    ]
    return document.select(F.inline(F.array(*rows))).withColumn("number", F.col("text").try_cast("double"))


def load_scoring_config(spark: SparkSession, path: str) -> ScoringConfig:
    """Calibration, scorecard and risk bands of a trained model; missing parts take their defaults."""
    found = {r["field"]: r["text"] for r in scan_scoring_config(spark, path).collect()}  # eleven rows
    return ScoringConfig.from_texts(found)


def save_scoring_config(
    spark: SparkSession, config: ScoringConfig, path: str, only: set[str] | None = None, **extra
) -> None:
    """A JSON document with the fields of ``config`` (those named by ``only``) and ``extra``."""
    text = json.dumps({**config.to_metadata(only), **extra})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_layer(
    df: DataFrame, root: str, layer: str, table: str, max_files: int | None = None, rebalance: bool = False
) -> str:
    """Replace a table.

    By default nothing is shuffled for the write: adaptive execution has already sized the partitions
    that the last shuffle left. ``max_files`` pays one shuffle for that many files, so that the work before it keeps
    all its tasks; ``rebalance`` pays one for files of even size.
    """
    path = f"{root}/{layer}/{table}"
    if rebalance:
        df = df.hint("rebalance")
    if max_files is not None:
        df = df.repartition(max_files)
    df.write.mode("overwrite").parquet(path)
    return path


def write_bucketed(df: DataFrame, root: str, table: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """A table in buckets by ``keys``, sorted inside, read back as such: a join on the keys moves the other side only.

    ``buckets`` defaults to the session's shuffle partitions. The name it gets in the catalog is the session's own.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{table}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", f"{root}/bucketed/{table}").format("parquet").saveAsTable(name)
    return spark.table(name)


def write_serving(df: DataFrame, root: str, table: str, cluster_by: Sequence[str]) -> str:
    """Replace a serving table, range-clustered so that row-group statistics find one customer.

    Ranges over all of ``cluster_by`` also split a customer that holds a large share of the rows.
    """
    path = f"{root}/serving/{table}"
    clustered = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    clustered.write.mode("overwrite").parquet(path)
    return path


def publish_serving(
    root: str,
    customers: DataFrame,
    loans: DataFrame,
    scores: DataFrame,
    features: DataFrame,
    transactions: DataFrame,
    lookback_days: int = 1095,
) -> dict[str, str]:
    """Replace the five serving tables; a repeated customer in scores or features is an error."""
    recent = serving.within_lookback(transactions, scores, lookback_days)
    by_date = ["customer_id", "transaction_date", "transaction_id"]
    tables = {
        "customer_profile": (serving.serving_profile(customers), ["customer_id"]),
        "customer_loans": (serving.serving_loans(loans), ["customer_id", "loan_id"]),
        "customer_credit_scores": (require_unique(serving.serving_scores(scores), ["customer_id"]), ["customer_id"]),
        "customer_credit_features": (
            require_unique(serving.serving_features(features), ["customer_id"]),
            ["customer_id"],
        ),
        "customer_transactions": (recent.drop("created_at"), by_date),
    }
    return {name: write_serving(df, root, name, cluster_by) for name, (df, cluster_by) in tables.items()}
