"""Repeated byte strings by difference-cover suffix sorting, dealt out so that equal strings meet.

A string of ``SIZE`` bytes that occurs twice has the same smallest 16-byte hash both times. Neighbouring windows with the
same smallest hash are a run; runs whose hash occurs once in all texts hold nothing repeated and are never looked at
again. Runs that read alike cover each other whole. What is left, one copy of each run that shares its hash
with a different one, is cut out of the texts and sorted:

suffixes at places that are not multiples of three are sorted by triples, named, and the names sorted by recursion where
triples repeat; the remaining suffixes follow from their first byte and the name behind it; both lists are merged. Windows
whose neighbours in this order share the first ``SIZE`` bytes are repeated.

A sort works on texts of at most ``AT_ONCE`` bytes, all runs of a hash together. Hashes with more than ``WIDE`` bytes of
different runs don't go into a task: their windows are counted as rows, by a hash of all their bytes. Runs and
windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm import substrings
from creditloom.llm.common import WIDE as FEW
from creditloom.llm.common import settled, slices, written
from creditloom.llm.spans import keyed, lists, runs, sliding, spans_by_document, with_texts
from creditloom.llm.words import prefix_hashes, span_hashes, word_bounds

SIZE = 400
WORDS = 51  # words of a passage that other documents hold as well, in ``without_repeats``
GRAM = 16
LONGEST = 1024  # windows in a run
SLICE = 2 << 20
PIECE = 1 << 19  # windows of a text that are looked at together
AT_ONCE = 1 << 19  # symbols of a sort: names have to fit into 21 bits
WIDE = 1 << 20


# suffix sorting --------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places of all suffixes of ``symbols`` (1 to 2**21 - 1) in ascending order."""
    n = len(symbols)
    if n < 4:
        text = symbols.tolist()
        return np.array(sorted(range(n), key=lambda i: text[i:]), dtype=np.int64)
    s = np.concatenate([symbols.astype(np.uint64), np.zeros(4, dtype=np.uint64)])
    shift, wide = np.uint64(21), np.uint64(42)
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with the empty suffix if it ends the first list
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triple = s[sample] << wide | s[sample + 1] << shift | s[sample + 2]
    order = np.argsort(triple, kind="stable")
    new = np.diff(triple[order], prepend=triple[order[0]] + np.uint64(1)) != 0
    names = np.empty(len(sample), dtype=np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_order(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, dtype=np.uint64)
    rank[sample] = names
    sample = sample[order]
    sample = sample[sample < n]

    rest = np.arange(0, n, 3)
    one_key = lambda at: s[at] << shift | rank[at + 1]
    two_key = lambda at: s[at] << wide | s[at + 1] << shift | rank[at + 2]
    rest = rest[np.argsort(one_key(rest), kind="stable")]
    before = np.searchsorted(one_key(sample[sample % 3 == 1]), one_key(rest))
    before += np.searchsorted(two_key(sample[sample % 3 == 2]), two_key(rest))
    out = np.empty(n, dtype=np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    others = np.ones(n, dtype=bool)
    others[at] = False
    out[others] = sample
    return out


def repeated_starts(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """Per text the places where ``size`` bytes start that also start elsewhere in one of the texts."""
    joined = b"\0".join(texts)  # a symbol of its own: bytes count from 2 below
    data = np.frombuffer(joined, dtype=np.uint8)
    symbols = data.astype(np.int64) + 2
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols[ends[:-1]] = 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    window = np.zeros(len(data), dtype=bool)
    for a, b in zip(begins, ends, strict=True):
        window[a : max(a, b - size + 1)] = True
    order = suffix_order(symbols)
    order = order[window[order]]
    same = np.zeros(len(data), dtype=bool)
    if len(order) > 1:
        prefix = prefix_hashes(data)
        code = span_hashes(prefix, order, order + size)
        equal = code[1:] == code[:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
    return [np.flatnonzero(same[a:b]) for a, b in zip(begins, ends, strict=True)]


# passes over the texts -------------------------------------------------------------------------------


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_runs(text: bytes, size: int = SIZE, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Smallest hash, reading, start, windows and whether that hash stands twice in it, of each run of a text.

    A longer text is looked at in pieces that overlap by all but one byte of a window; a run is cut where a piece ends.
    """
    found = [piece_runs(text[a : a + piece + size - 1], size) for a in range(0, max(1, len(text) - size + 1), piece)]
    least, reading, starts, lengths, twice = (np.concatenate([f[k] for f in found]) for k in range(5))
    return least, reading, starts + np.repeat(np.arange(len(found)) * piece, [len(f[0]) for f in found]), lengths, twice


def piece_runs(text: bytes, size: int) -> tuple[np.ndarray, ...]:
    if len(text) < size:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none.astype(bool)
    data = np.frombuffer(text, dtype=np.uint8)
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = span_hashes(prefix, at, at + GRAM)
    inside = size - GRAM + 1
    least = sliding(grams, inside)
    starts, lengths = runs(least, LONGEST)
    reading = span_hashes(prefix, starts, starts + lengths - 1 + size)
    blank = np.zeros(inside - 1, dtype=np.uint64)
    chosen = np.flatnonzero(grams == sliding(np.concatenate([blank, least, blank]), inside, np.maximum))
    values, group = np.unique(grams[chosen], return_inverse=True)
    key = np.sort(group * (len(data) + 1) + chosen)
    own = np.searchsorted(values, least[starts]) * (len(data) + 1)
    times = np.searchsorted(key, own + starts + lengths + inside - 2, "right") - np.searchsorted(key, own + starts)
    return least[starts], reading, starts, lengths, times > 1


WALKS = ["doc_id", "place", "text_hash", "n_bytes", "kept_sha256", "hash", "reading", "start", "length", "twice"]
TYPES = [*[pa.int64()] * 4, pa.string(), *[pa.int64()] * 4, pa.bool_()]


def walks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Per document its key, size and hash; per run its hash, reading, coordinates and whether its hash stands in it twice."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE):
            texts = [raw(t) for t in batch.column(3).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            shas = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
            blank = [pa.nulls(len(texts), t) for t in TYPES[5:]]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), batch.column(1), sizes, shas, *blank], WALKS)
            found = [text_runs(t, size) for t in texts]
            counts = [len(f[0]) for f in found]
            n = sum(counts)
            least, reading, starts, lengths, twice = (np.concatenate([f[k] for f in found]) for k in range(5))
            columns = [
                pa.nulls(n, pa.int64()),
                pa.array(np.repeat(batch.column(0).to_numpy(), counts)),
                pa.array(np.repeat(batch.column(1).to_numpy(), counts)),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.string()),
                *[pa.array(c) for c in (least.view(np.int64), reading.view(np.int64), starts, lengths, twice)],
            ]
            for a in range(0, n, 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(a, 1 << 16) for c in columns], WALKS)

    schema = (
        "doc_id bigint, place bigint, text_hash bigint, n_bytes bigint, kept_sha256 string, hash bigint, reading bigint, "
        "start bigint, length bigint, twice boolean"
    )
    return keyed(docs).select("place", "text_hash", "doc_id", "text").mapInArrow(rows, schema)


def contexts(border: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``border`` (hash, wide, place, text_hash, start, length) with the bytes of each run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE):
            spans = batch.column(2)
            counts = np.diff(spans.offsets.to_numpy())
            own = spans.flatten()
            start, length = own.field("start").to_numpy(), own.field("length").to_numpy()
            texts = [raw(t) for t in batch.column(3).to_pylist()]
            owner = np.repeat(np.arange(len(texts)), counts)
            cut = [texts[o][s : s + n - 1 + size] for o, s, n in zip(owner, start, length, strict=True)]
            columns = [
                own.field("hash"),
                own.field("wide"),
                pa.array(np.repeat(batch.column(0).to_numpy(), counts)),
                pa.array(np.repeat(batch.column(1).to_numpy(), counts)),
                own.field("start"),
                pa.array(cut, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "wide", "place", "text_hash", "start", "bytes"])

    by_document = border.groupBy("place", "text_hash").agg(
        F.collect_list(F.struct("hash", "wide", "start", "length")).alias("spans")
    )
    texts = with_texts(by_document, docs).select("place", "text_hash", "spans", "text")
    return texts.mapInArrow(rows, "hash bigint, wide boolean, place bigint, text_hash bigint, start bigint, bytes binary")


SPANS = ["place", "text_hash", "start", "length"]
SPAN_SCHEMA = "place bigint, text_hash bigint, start bigint, length bigint"


def sorted_repeats(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Spans (place, text_hash, start, length) of repeated windows; all runs of a hash are sorted together."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        block: list[tuple] = []
        group: list[tuple] = []
        total = own = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[0] != group[0][0]:
                    if block and total + own > AT_ONCE:
                        yield block
                        block, total = [], 0
                    block, total, group, own = block + group, total + own, [], 0
                group.append(row)
                own += len(row[4]) + 1
        if block and total + own > AT_ONCE:
            yield block
            block = []
        if block or group:
            yield block + group

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            place, text, start, length = [], [], [], []
            for row, found in zip(block, repeated_starts([r[4] for r in block], size), strict=True):
                if len(found):
                    first = np.flatnonzero(np.diff(found, prepend=-2) != 1)
                    place += [row[1]] * len(first)
                    text += [row[2]] * len(first)
                    start += (found[first] + row[3]).tolist()
                    length += np.diff(np.append(first, len(found))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (place, text, start, length)], SPANS)

    dealt = cut.select("hash", "place", "text_hash", "start", "bytes").repartition("hash").sortWithinPartitions("hash")
    return dealt.mapInArrow(rows, SPAN_SCHEMA)


def counted_repeats(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The same by a row per window, for hashes with too many different runs for a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text, start, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                prefix = prefix_hashes(np.frombuffer(data, dtype=np.uint8))
                at = np.arange(len(data) - size + 1)
                code = span_hashes(prefix, at, at + size).view(np.int64)
                columns = [code, np.full(len(at), place), np.full(len(at), text), at + start]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["code", "place", "text_hash", "start"])

    windows = cut.select("place", "text_hash", "start", "bytes").mapInArrow(
        rows, "code bigint, place bigint, text_hash bigint, start bigint"
    )
    often = windows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code")
    return windows.join(often, "code", "left_semi").select("place", "text_hash", "start", F.lit(1).cast("bigint").alias("length"))


def stretches(n: int, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches covered by windows that start in [start, start + length)."""
    return covered(starts, np.minimum(starts + lengths - 1 + size, n))


def covered(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches covered by [begin, end)."""
    order = np.argsort(begins, kind="stable")
    begins = begins[order]
    reach = np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], begins[1:] > reach[:-1]])) if len(begins) else np.zeros(0, dtype=np.int64)
    return begins[first], reach[np.append(first[1:], len(begins)) - 1] if len(first) else first


def cut_out(docs: DataFrame, spans: DataFrame, size: int = SIZE, word_spans: DataFrame | None = None, words: int = WORDS) -> DataFrame:
    """place, text_hash, n_removed, n_spans, kept_sha256 and kept of the documents that lose bytes.

    ``spans`` are of windows of ``size`` bytes, ``word_spans`` of windows of ``words`` words. ``kept`` is what is left as
    text, without pieces of characters at the cuts; the hash is of all bytes left.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            out = []
            spans_of = zip(lists(batch.column(2), batch.num_rows), lists(batch.column(4), batch.num_rows), strict=True)
            for text, ((starts, lengths), (first, windows)) in zip(batch.column(3).to_pylist(), spans_of, strict=True):
                data = raw(text)
                begins, ends = stretches(len(data), starts, lengths, size)
                if len(first):
                    at, to = word_bounds(np.frombuffer(data, dtype=np.uint8))
                    last = first + windows + words - 2
                    begins, ends = covered(np.append(begins, at[first]), np.append(ends, to[last]))
                bounds = zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)
                kept = b"".join(data[a:b] for a, b in bounds)
                removed = len(data) - len(kept)
                out.append((removed, len(begins), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            removed, pieces, shas, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(removed, pa.int64()),
                    pa.array(pieces, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(kept, pa.string()),
                ],
                ["place", "text_hash", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    keys = spans_by_document(spans)
    if word_spans is None:
        keys = keys.withColumn("word_spans", none)
    else:
        keys = keys.join(spans_by_document(word_spans).withColumnRenamed("spans", "word_spans"), ["place", "text_hash"], "full")
        keys = keys.withColumns({c: F.coalesce(c, none) for c in ("spans", "word_spans")})
    found = with_texts(keys, docs).select("place", "text_hash", "spans", "text", "word_spans")
    schema = "place bigint, text_hash bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"
    return found.mapInArrow(rows, schema)


def repeated_spans(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, place, text_hash, n_bytes, kept_sha256) and the spans of their repeated windows."""
    table = written(walks(docs, size), "walks", FEW)
    paths = table.where("hash is not null").select("hash", "reading", "place", "text_hash", "start", "length", "twice")
    met = paths.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("hash")
    shared = written(paths.join(met, "hash", "left_semi"), "runs")

    at = F.struct("place", "text_hash", "start")
    readings = written(
        shared.groupBy("hash", "reading").agg(
            F.count(F.lit(1)).alias("n"), F.min(at).alias("at"), F.first("length").alias("length"), F.first("twice").alias("twice")
        ),
        "readings",
    )
    often = readings.where("n > 1").select("hash", "reading")
    whole = shared.join(often, ["hash", "reading"], "left_semi").select(*SPANS)

    groups = readings.groupBy("hash").agg(
        F.count(F.lit(1)).alias("k"), F.max("twice").alias("t"), F.sum(F.col("length") + size).alias("bytes")
    )
    border = readings.join(
        groups.where("k > 1 or t").select("hash", (F.col("bytes") > WIDE).alias("wide")), "hash"
    ).select("hash", "wide", "at.place", "at.text_hash", "at.start", "length")
    cut = written(contexts(border, docs, size), "contexts")
    spans = whole.unionByName(sorted_repeats(cut.where("not wide"), size)).unionByName(counted_repeats(cut.where("wide"), size))
    return table.where("hash is null").select("doc_id", "place", "text_hash", "n_bytes", "kept_sha256"), spans.distinct()


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Every byte covered by ``size`` bytes that also start anywhere else goes, in all copies. Repeated rows are copies of
    each other, null texts are empty, a null doc_id takes part like any other; other columns are ignored.
    """
    return settled(docs.sparkSession, lambda: _removed(docs, size), "removed")


def without_repeats(docs: DataFrame, size: int = SIZE, words: int = WORDS) -> DataFrame:
    """What ``cut_out`` returns for the repeated passages of ``docs``: the documents that lose bytes and what is left.

    Passages are ``size`` bytes that also start anywhere else, as in ``remove_repeats``, and ``words`` words, however
    short, that another document holds as well. Both are judged on ``docs`` and go from all documents.
    """
    spark = docs.sparkSession

    def build() -> DataFrame:
        shared = settled(spark, lambda: substrings.shared_windows(docs, words), "words")
        return cut_out(docs, repeated_spans(docs, size)[1], size, shared, words)

    return settled(spark, build, "cut")


def _removed(docs: DataFrame, size: int) -> DataFrame:
    known, spans = repeated_spans(docs, size)
    changed = cut_out(docs, spans, size).select(
        F.col("place").alias("_place"), F.col("text_hash").alias("_hash"), "n_removed", "n_spans", F.col("kept_sha256").alias("_sha")
    )
    joined = known.join(changed, (F.col("place") == F.col("_place")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("_sha", "kept_sha256").alias("kept_sha256"),
    )
