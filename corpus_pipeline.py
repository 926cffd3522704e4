"""A corpus from raw documents to packed sequences: quality, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it. All but the
last return the columns of documents. Null texts count as empty ones, null ids as the largest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import packing, quality, shingle_join, suffixes
from creditloom.llm.common import documents, importable, written
from creditloom.llm.queries import vocabulary
from creditloom.llm.spans import LAST

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    return docs.withColumns({"_place": place, "_text_hash": F.xxhash64("text")})


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject. Empty texts are scored as well."""
    importable(spark)
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = quality.unused("score", docs.columns)
    return quality.scored(docs, net, score).where(F.col(score) >= 0.5).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join the document with the smallest doc_id; of repeated rows one."""
    importable(spark)
    kept = shingle_join.representatives(docs).select(F.col("place").alias("_place"), F.col("text_hash").alias("_text_hash"))
    key = ["_place", "_text_hash"]
    return _keyed(docs).join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 400 bytes that stand anywhere else, or of over 50 words that another document holds.

    Documents stay, also with nothing left. A piece of a character at a cut goes with the passage; ``n_chars`` follows the text.
    """
    importable(spark)
    changed = suffixes.without_repeats(docs).select(
        F.col("place").alias("_place"), F.col("text_hash").alias("_text_hash"), F.col("kept").alias("_kept")
    )
    joined = _keyed(docs).join(changed, ["_place", "_text_hash"], "left")
    text = F.coalesce("_kept", "text")
    new = {"text": text, "n_chars": F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("bigint"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    importable(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_copies", one_of_near_copies),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]

ORACLE_SQL = None  # trained scores, components and packing are tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
