"""Repeated word passages by compaction of a De Bruijn graph.

Edges of the graph are windows of ``SIZE`` words, its nodes the words two neighbouring windows share. Windows are dealt out
by their smallest inner 5-word hash, so equal windows meet. Neighbouring windows with the same smallest hash
are a path; where all paths of a hash read alike it doesn't branch and is one compact piece: one row stands for its edges.
Only paths that branch are opened into single edges, one copy of each.

Joins on (hash, path) and on the edge give the first document of each; the coordinates carried along (document,
first window, number of windows) say which words go. Windows are told apart by 64-bit hashes of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import slices, written
from creditloom.llm.spans import keyed, lists, marked, runs, sliding, spans_by_document, with_texts
from creditloom.llm.words import BLANK, PLACES, mix, window_hashes, word_hashes

SIZE = 13
INNER = 5
LONGEST = 15  # windows in a path
SLICE = 2 << 20  # text whose paths are dealt out at once
STEP = 1 << 18  # text that is hashed at once: its words and their hashes take some forty times as much
HELD = 1 << 20  # path rows a bucket gathers before it looks for shared hashes
# a path in a blob: 48 bits of its hash and the number of its document, its reading, its first window and its length
PATH = np.dtype([("hash", "<u8"), ("reading", "<u8"), ("at", "<u4")])
WALKS = ["doc_id", "place", "text_hash", "n_words", "kept_sha256", "bucket", "blob"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(BLANKS).split()


BLANKS = bytes(32 if BLANK[b] else b for b in range(256))


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def paths(words: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest inner hash, reading, first window and number of windows of each path of a document."""
    if len(words) < size:
        none = np.zeros(0, dtype=np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    inner = window_hashes(words, INNER)
    least = sliding(inner, size - INNER + 1)
    starts, lengths = runs(least, LONGEST)
    edges = window_hashes(words, size)
    # the reading of a path: its edges in order
    number = np.arange(len(edges)) - np.repeat(starts, lengths)
    weighted = mix(edges + PLACE_HASHES[number])
    reading = np.add.reduceat(weighted, starts) + lengths.astype(np.uint64)
    return least[starts], reading, starts, lengths


PLACE_HASHES = mix(np.array(PLACES[:LONGEST], dtype=np.uint64))


def dealt_out(found: list[tuple], place: np.ndarray, text_hash: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Buckets and blobs of the paths of many documents: per document hashes, readings, first windows and lengths."""
    names, blobs = [], []
    for a in range(0, len(found), 1 << 16):
        some = found[a : a + (1 << 16)]
        out = np.zeros(sum(len(f[0]) for f in some), dtype=PATH)
        owner = np.repeat(np.arange(len(some), dtype=np.uint64), [len(f[0]) for f in some])
        hashes = np.concatenate([f[0] for f in some])
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        out["hash"] = ((hashes >> np.uint64(16)) << np.uint64(16)) | owner
        out["reading"] = np.concatenate([f[1] for f in some])
        out["at"] = np.concatenate([f[2] for f in some]) << 4 | np.concatenate([f[3] for f in some])
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = out[order]
        for b in np.flatnonzero(np.diff(cuts)):
            own = out[cuts[b] : cuts[b + 1]].copy()
            used, number = np.unique(own["hash"] & np.uint64(0xFFFF), return_inverse=True)
            own["hash"] = (own["hash"] & ~np.uint64(0xFFFF)) | number.astype(np.uint64)
            used = a + used.astype(np.int64)
            names.append(int(b))
            blobs.append(len(used).to_bytes(8, "little") + place[used].tobytes() + text_hash[used].tobytes() + own.tobytes())
    return names, blobs


def walks(docs: DataFrame, buckets: int, size: int = SIZE) -> DataFrame:
    """Per document its key, number of words and the hash of all words; per slice and bucket a blob of paths."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE):
            shas, counts, found = [], [], []
            for part in slices([batch], 3, STEP):
                texts = part.column(3).to_pylist()
                for text in texts:
                    words = words_of(text)
                    shas.append(sha(words))
                    counts.append(len(words))
                hashes, at = word_hashes(texts)
                found += [paths(hashes[a:b], size) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = len(found)
            blank = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            columns = [batch.column(2), batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas), *blank]
            yield pa.RecordBatch.from_arrays(columns, WALKS)
            names, blobs = dealt_out(found, batch.column(0).to_numpy(), batch.column(1).to_numpy(), buckets)
            none = [pa.nulls(len(names), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], WALKS)

    schema = "doc_id bigint, place bigint, text_hash bigint, n_words bigint, kept_sha256 string, bucket int, blob binary"
    return keyed(docs).select("place", "text_hash", "doc_id", "text").mapInArrow(rows, schema)


def shared_paths(blobs: DataFrame, buckets: int, texts: bool = False) -> DataFrame:
    """(hash, reading, place, text_hash, start, length) of all paths whose hash occurs in documents of two places, or
    with ``texts`` also in two texts of one place.

    A task holds, per bucket, the paths whose hash has one place so far; of a shared hash it keeps a mark only.
    """
    kept = np.dtype([("hash", "<u8"), ("reading", "<u8"), ("at", "<u4"), ("place", "<i8"), ("text", "<i8"), ("shared", "?")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = int.from_bytes(blob[:8], "little")
                place = np.frombuffer(blob, dtype=np.int64, offset=8, count=n)
                text = np.frombuffer(blob, dtype=np.int64, offset=8 + 8 * n, count=n)
                raw = np.frombuffer(blob, dtype=PATH, offset=8 + 16 * n)
                own = np.zeros(len(raw), dtype=kept)
                number = (raw["hash"] & np.uint64(0xFFFF)).astype(np.int64)
                own["hash"] = (raw["hash"] & ~np.uint64(0xFFFF)) | np.uint64(bucket & 0xFFFF)
                own["reading"], own["at"] = raw["reading"], raw["at"]
                own["place"], own["text"] = place[number], text[number]
                held.setdefault(bucket, []).append(own)
                size[bucket] = size.get(bucket, 0) + len(own)
                if size[bucket] > HELD:
                    left = yield from settle(np.concatenate(held[bucket]))
                    # wait for as many new rows as are held, so that sorting stays proportional to the input
                    held[bucket], size[bucket] = [left], min(0, HELD - len(left))
        for bucket in list(held):
            yield from settle(np.concatenate(held.pop(bucket)))

    def settle(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = own[np.argsort(own["hash"], kind="stable")]
        first = np.flatnonzero(np.diff(own["hash"], prepend=~own["hash"][:1]))
        counts = np.diff(np.append(first, len(own)))
        shared = np.minimum.reduceat(own["place"], first) != np.maximum.reduceat(own["place"], first)
        if texts:
            shared |= np.minimum.reduceat(own["text"], first) != np.maximum.reduceat(own["text"], first)
        shared |= np.logical_or.reduceat(own["shared"], first)
        every = np.repeat(shared, counts)
        out = own[every & ~own["shared"]]
        for a in range(0, len(out), 1 << 16):
            part = out[a : a + (1 << 16)]
            start, length = (part["at"] >> 4).astype(np.int64), (part["at"] & 15).astype(np.int64)
            columns = [part["hash"].view(np.int64), part["reading"].view(np.int64), part["place"], part["text"], start, length]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], SHARED)
        marks = own[first[shared]]
        marks["shared"] = True
        return np.concatenate([own[~every], marks])

    dealt = blobs.select("bucket", "blob").repartition(buckets, "bucket")
    return dealt.mapInArrow(rows, "hash bigint, reading bigint, place bigint, text_hash bigint, start bigint, length bigint")


SHARED = ["hash", "reading", "place", "text_hash", "start", "length"]


def opened(border: DataFrame, docs: DataFrame, buckets: int, size: int = SIZE) -> DataFrame:
    """Per slice and bucket a blob of the single windows of the paths in ``border``; a window's hash is its reading as well."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE):
            found = []
            for part in slices([batch], 3, STEP):
                hashes, at = word_hashes(part.column(3).to_pylist())
                for i, (starts, lengths) in enumerate(lists(part.column(2), part.num_rows)):
                    edges = window_hashes(hashes[at[i] : at[i + 1]], size)
                    own = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                    found.append((edges[own], edges[own], own, np.ones_like(own)))
            names, blobs = dealt_out(found, batch.column(0).to_numpy(), batch.column(1).to_numpy(), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    texts = with_texts(spans_by_document(border), docs).select("place", "text_hash", "spans", "text")
    return texts.mapInArrow(rows, "bucket int, blob binary")


def cut(docs: DataFrame, spans: DataFrame, size: int = SIZE) -> DataFrame:
    """place, text_hash, n_removed, kept_sha256 and kept (the text) of the documents that lose words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            removed, shas, texts = [], [], []
            spans_of = lists(batch.column(2), batch.num_rows)
            for text, (starts, lengths) in zip(batch.column(3).to_pylist(), spans_of, strict=True):
                words = words_of(text)
                gone = marked(len(words), starts, lengths, size)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(len(words) - len(kept))
                shas.append(sha(kept))
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, ["place", "text_hash", "n_removed", "kept_sha256", "kept"])

    found = with_texts(spans_by_document(spans), docs).select("place", "text_hash", "spans", "text")
    return found.mapInArrow(rows, "place bigint, text_hash bigint, n_removed bigint, kept_sha256 string, kept string")


def repeated_windows(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, place, text_hash, n_words, kept_sha256) and spans (place, text_hash, start, length) of
    windows that also start in a document with a smaller doc_id."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = written(walks(docs, buckets, size), "walks")
    shared = written(shared_paths(table.where("bucket is not null"), buckets), "paths")

    readings = shared.groupBy("hash", "reading").agg(F.min("place").alias("first"))
    branches = readings.groupBy("hash").agg((F.count(F.lit(1)) > 1).alias("branching"))
    seen = written(
        shared.join(readings, ["hash", "reading"])
        .join(branches, "hash")
        .where("first < place or branching")
        .select("place", "text_hash", "start", "length", (F.col("first") < F.col("place")).alias("whole")),
        "spans",
    )
    whole = seen.where("whole").select("place", "text_hash", "start", "length")
    border = seen.where("not whole").select("place", "text_hash", "start", "length").distinct()
    # windows are dealt as paths are: only those that documents of two places hold become rows
    edges = written(shared_paths(written(opened(border, docs, buckets, size), "opened"), buckets), "edges")
    firsts = edges.groupBy("reading").agg(F.min("place").alias("first"))
    single = edges.join(firsts, "reading").where("first < place").select("place", "text_hash", "start", "length")
    return table.where("bucket is null").drop("bucket", "blob"), whole.unionByName(single).distinct()


def shared_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Spans (place, text_hash, start, length) of windows that start in two documents, in every document that holds them.

    Rows with the same doc_id and text are one document.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blobs = written(walks(docs, buckets, size).where("bucket is not null").select("bucket", "blob"), "walks")
    shared = written(shared_paths(blobs, buckets, texts=True), "paths")

    own, span = F.struct("place", "text_hash"), ["place", "text_hash", "start", "length"]
    readings = shared.groupBy("hash", "reading").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    branches = readings.groupBy("hash").agg((F.count(F.lit(1)) > 1).alias("branching"))
    # the windows of a branching reading start in two documents if its first and last are two, or those of another reading
    edge = F.col("branching") & ((own == F.col("low")) | (own == F.col("high")))
    several = F.col("low") < F.col("high")
    seen = written(
        shared.join(readings, ["hash", "reading"])
        .join(branches, "hash")
        .where(several | edge)
        .select(*span, several.alias("several"), edge.alias("edge")),
        "spans",
    )
    border = seen.where("edge").select(*span).distinct()
    edges = written(shared_paths(written(opened(border, docs, buckets, size), "opened"), buckets, texts=True), "edges")
    held = edges.groupBy("reading").agg((F.min(own) < F.max(own)).alias("several"))
    single = edges.join(held.where("several"), "reading", "left_semi").select(*span)
    return seen.where("several").select(*span).unionByName(single).distinct()


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A window goes if it also starts in a document with a smaller doc_id; a null doc_id counts as larger than all others,
    and rows with the same doc_id never take words from each other. Null texts have no words; other columns are ignored.
    """
    known, spans = repeated_windows(docs, size)
    changed = cut(docs, spans, size).select(
        F.col("place").alias("_place"), F.col("text_hash").alias("_hash"), "n_removed", F.col("kept_sha256").alias("_sha")
    )
    joined = known.join(changed, (F.col("place") == F.col("_place")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("_sha", "kept_sha256").alias("kept_sha256"),
    )
