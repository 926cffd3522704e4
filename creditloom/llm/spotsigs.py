"""Document fingerprints from spot signatures.

A signature is a chain of content words that follows a common word (the anchor). Common words are everywhere in
running text and rare in navigation or lists, so signatures follow the running text, and an edit changes only those
near it. A fingerprint is the sorted set of signature hashes; two are compared by Jaccard similarity, which the
set lengths alone often bound.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import slices

# Common words of the languages covered. All are skipped in chains; chains start after any of them.
COMMON = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their "
    "there they this to was we were which will with you",
    "fr": "à au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou par pas "
    "pour que qui sa se ses son sur tu un une vous",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im in "
    "ist mit nach nicht noch nur oder sich sie sind so um und von war was wie wir zu zum zur",
    "es": "a al como con de del el ella en es esta este fue ha la las le lo los más me mi no o para pero por que se sin "
    "su sus un una y ya",
}
DISTANCE = 1  # content words from one link of a chain to the next
CHAIN = 2  # content words in a chain
CACHED = 500_000
WORD = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordCodes(dict):
    """word -> hash; common words have an odd one, all others an even one."""

    def __init__(self, common: frozenset[str], limit: int = CACHED) -> None:
        self.common, self.limit = common, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = (xxhash.xxh64_intdigest(word) & ~1) | (word in self.common)
        return code


def signatures(text: str, codes: WordCodes, distance: int = DISTANCE, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct signature hashes.

    A text whose anchors have no full chain after them uses pairs of neighbouring words, one without
    two words the hash of the text.
    """
    words = np.array([codes[w] for w in WORD.findall(text.lower())], dtype=np.uint64)
    common = (words & np.uint64(1)).astype(bool)
    content, anchors = np.flatnonzero(~common), np.flatnonzero(common)
    first = np.searchsorted(content, anchors) + distance - 1
    full = first + (chain - 1) * distance < len(content)
    anchors, first = anchors[full], first[full]
    if len(anchors):
        mixed = words[anchors]
        for link in range(chain):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX + words[content[first + link * distance]]
    elif len(words) > 1:
        mixed = (words[:-1] ^ (words[:-1] >> np.uint64(29))) * MIX + words[1:]
    else:
        mixed = np.array([xxhash.xxh64_intdigest(text)], dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX
    return np.unique((mixed >> np.uint64(32)).astype("<u4"))


def written_out(found: np.ndarray) -> str:
    """The set as text, its length class first: classes grow by a quarter, so only neighbours can be 0.8 alike."""
    return f"{length_class(len(found))}:{base64.b64encode(found.tobytes()).decode()}"


def length_class(n: int) -> int:
    return int(np.log(max(n, 1)) / np.log(1.25) + 1e-9)


def read_back(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard similarity of two sets, or 0 where their lengths show that it is below ``at_least``."""
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, length_class and fingerprint of every row; a null text is an empty one."""
    common = frozenset(" ".join(COMMON.values()).split())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(common)
        for batch in slices(batches, 1):
            found = [signatures(t or "", codes) for t in batch.column(1).to_pylist()]
            classes = pa.array([length_class(len(f)) for f in found], pa.int32())
            out = [batch.column(0), classes, pa.array([written_out(f) for f in found])]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "length_class", "fingerprint"])

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(rows, "doc_id bigint, length_class int, fingerprint string")


# each document and the next one ------------------------------------------------------------------------


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt by doc_id into sorted ranges, each range closed by the row that follows it.

    Returns doc_id, text, part and ``closing`` in an order within each task: by part, then doc_id descending (nulls
    last), then text. The ranges come from quantiles of the ids, at most one id per range reaches the driver (tasks find a row's
    range among them by binary search), and texts are shuffled once. The closing row of the last range is the first row of all.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    shares = [i / parts for i in range(1, parts)]
    ids = plain.select("doc_id").where("doc_id is not null")
    cuts = ids.agg(F.percentile_approx("doc_id", shares or [0.5], 10 * parts).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []), reverse=True)
    ascending = np.array(cuts[::-1], dtype=np.int64)

    def parts_of(ids: pa.Array) -> np.ndarray:
        """Part 0 has the largest ids, the last one the smallest and null."""
        larger = len(cuts) - np.searchsorted(ascending, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right")
        return np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), len(cuts), larger)

    part = F.arrow_udf(lambda ids: pa.array(parts_of(ids), pa.int32()), "int")("doc_id")
    heads = plain.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).collect()
    order = sorted(r["part"] for r in heads)  # at most ``parts`` rows
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the range that ends where p begins
    head = {r["part"]: r["head"] for r in heads}

    def closes_of(ids: pa.Array) -> pa.Array:
        """The range that a row closes: the one before its own, if it is the first of its own."""
        found = zip(ids.to_pylist(), parts_of(ids).tolist(), strict=True)
        return pa.array([before[p] if head[p] == i else None for i, p in found], pa.int32())

    rows = plain.withColumn("part", part)
    closes = F.arrow_udf(closes_of, "int")("doc_id")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("closing"))
    extra = F.struct(F.col("closes").alias("part"), F.lit(True).alias("closing"))
    return (
        rows.withColumn("closes", closes)
        .select("doc_id", "text", F.explode(F.when(F.col("closes").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("at"))
        .select("doc_id", "text", "at.part", "at.closing")
        .repartitionByRange(parts, "part")
        .sortWithinPartitions("part", "closing", F.col("doc_id").desc_nulls_last(), "text")
    )


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first characters of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The next document has the next smaller doc_id (equal ids and nulls, which come last, in order of text); after the
    last comes the first, so a single row is its own next. Null texts are empty; other columns are ignored.
    """
    common = frozenset(" ".join(COMMON.values()).split())

    def compared(rows: Iterator[tuple], codes: WordCodes) -> Iterator[tuple]:
        held = None  # the last row that waits for its next one
        for doc, text, part, closing in rows:
            text = text or ""
            if held and held[2] != part:
                held = None  # cannot happen: every range is closed
            if closing and held is None:
                continue  # further rows with the closing id
            found = signatures(text, codes)
            if held:
                own_doc, own_text, _, own = held
                new_text = edited(own_text, text)
                new = signatures(new_text, codes)
                sha = hashlib.sha256(new_text.encode("utf-8", "surrogatepass")).hexdigest()
                alike = likeness(own, new), likeness(own, found)
                yield (own_doc, len(own_text), sha, written_out(own), written_out(new), *alike)
            held = None if closing else (doc, text, part, found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(common)
        rows = (r for b in slices(batches, 1) for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        block: list[tuple] = []
        size = 0
        for row in compared(rows, codes):
            block.append(row)
            size += len(row[3]) + len(row[4])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*block, strict=True), TYPES)), NAMES)
                block, size = [], 0
        if block:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*block, strict=True), TYPES)), NAMES)

    return with_next(docs, parts).mapInArrow(work, SCHEMA)


def near_duplicates(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs (left, right, similarity) of different fingerprints that are alike, left doc_id smaller.

    Equal fingerprints count once, with their smallest doc_id. Signatures are ordered by hash; a pair shares one of the
    first (1 - at_least) * n + 1 of each set and lies in the same or neighbouring length classes, so rows meet on
    (length class, signature). ``prints`` has what ``fingerprints`` returns; rows with a null doc_id are left out.
    """
    if at_least < 0.8:
        raise ValueError("length classes are made for a similarity of at least 0.8")

    @F.pandas_udf("array<bigint>")
    def prefix(column):
        def first(fingerprint: str) -> list[int]:
            found = read_back(fingerprint)
            return found[: len(found) - int(np.ceil(at_least * len(found) - 1e-9)) + 1].tolist()

        return column.map(first)

    @F.pandas_udf("double")
    def similar(a, b):
        return a.combine(b, lambda x, y: likeness(read_back(x), read_back(y), at_least))

    one = prints.where("doc_id is not null").groupBy("fingerprint").agg(
        F.min("doc_id").alias("doc_id"), F.first("length_class").alias("length_class")
    )
    seen = one.select("doc_id", "fingerprint", "length_class", F.explode(prefix("fingerprint")).alias("signature"))
    left = seen.select(F.col("doc_id").alias("left"), F.col("length_class").alias("_class"), F.col("signature").alias("_sig"))
    right = seen.select(
        F.col("doc_id").alias("right"),
        F.explode(F.array(*[F.col("length_class") + d for d in (-1, 0, 1)])).alias("_class"),
        F.col("signature").alias("_sig"),
    )
    pairs = left.join(right, ["_class", "_sig"]).where("left < right").select("left", "right").distinct()
    names = lambda side: one.select(F.col("doc_id").alias(side), F.col("fingerprint").alias(f"_{side}"))
    checked = pairs.join(names("left"), "left").join(names("right"), "right")
    return checked.select("left", "right", similar("_left", "_right").alias("similarity")).where(
        F.col("similarity") >= at_least
    )


