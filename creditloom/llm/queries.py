"""The operators as named queries over a folder of tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm import (
    byte_bpe,
    centroids,
    licenses,
    neighbours,
    packing,
    periods,
    quality,
    shingle_join,
    spotsigs,
    sql,
    substrings,
    suffixes,
    token_files,
    warc,
)
from creditloom.llm.common import documents, importable
from creditloom.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.classify(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    token_files.write(token_files.encode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")), folder)
    return token_files.digests(token_files.read(spark, folder))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).withColumn("spans", F.to_json("spans"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op7_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(documents(spark, sf_dir))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trips(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op11_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    folder = fresh_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.described(warc.read(spark, folder))


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents (by the crc32 of doc_id) repeat from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(documents(spark, sf_dir), made_periodic))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return centroids.described(*centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict[str, Query]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return sql.statements()
