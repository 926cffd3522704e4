"""Document quality by a small convolutional network over bytes, written in numpy.

Bytes are embedded, learned filters slide over them, and each filter's largest answer is taken per chunk. Chunks overlap
by half and cover the whole document; their answers are combined by mean and maximum into one vector and that into
one probability. Only the text is an input.

The model is fitted on the driver on a bounded sample of labelled documents, ``rows`` per class, with their whole texts;
scoring reads every byte of every document, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import slices

ROWS_PER_CLASS = 700  # bound of the training sample
EPOCHS = 16
BATCH = 32
HALF = 256  # bytes of half a chunk
STRIDE = 4
WIDTH = 8
EMBEDDED = 8
FILTERS = 24
PAD = 256  # the byte value beyond the end of a text
AT_ONCE = 256  # half chunks held in embedded form


class Net(NamedTuple):
    embedding: np.ndarray  # (257, EMBEDDED)
    filters: np.ndarray  # (WIDTH * EMBEDDED, FILTERS)
    bias: np.ndarray
    weights: np.ndarray  # mean and maximum of each filter
    intercept: np.ndarray  # (1,)


def padded(text: bytes) -> np.ndarray:
    """Byte values, filled up so that windows of the last half chunk end inside; at least one half chunk."""
    n = -(-(len(text) + WIDTH - STRIDE) // HALF) * HALF
    out = np.full(max(n, HALF), PAD, dtype=np.int16)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out


def windows(values: list[np.ndarray]) -> np.ndarray:
    """(half chunks, windows in each, WIDTH) byte values; a text's last windows look into padding, not into the next text."""
    halves = np.concatenate(values).reshape(-1, HALF)
    ahead = np.full((len(halves), WIDTH - STRIDE), PAD, dtype=halves.dtype)
    ahead[:-1] = halves[1:, : WIDTH - STRIDE]
    ahead[np.cumsum([len(v) // HALF for v in values]) - 1] = PAD
    return sliding_window_view(np.concatenate([halves, ahead], axis=1), WIDTH, axis=1)[:, ::STRIDE]


def responses(net: Net, values: list[np.ndarray]) -> np.ndarray:
    """(half chunks, FILTERS): the largest answer of each filter."""
    seen = windows(values)
    out = np.empty((len(seen), net.filters.shape[1]), dtype=net.filters.dtype)
    for a in range(0, len(seen), AT_ONCE):
        part = seen[a : a + AT_ONCE]
        embedded = net.embedding[part.reshape(-1)].reshape(-1, net.filters.shape[0])
        out[a : a + AT_ONCE] = (embedded @ net.filters).reshape(*part.shape[:2], -1).max(axis=1)
    return np.maximum(out + net.bias, 0)


def combined(halves: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Chunk answers (two halves each; a single half is a chunk) and their mean and maximum per document."""
    chunks, vectors, at = [], [], 0
    for n in counts:
        own = halves[at : at + n]
        chunk = np.maximum(own[:-1], own[1:]) if n > 1 else own
        chunks.append(chunk)
        vectors.append(np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)]))
        at += n
    return chunks, np.array(vectors)


def probability(net: Net, vectors: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(vectors @ net.weights + net.intercept[0], -30, 30).astype(np.float64)))


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probabilities to 12 digits, in double precision: the same for a text in whatever batch it comes."""
    net = Net(*(p.astype(np.float64) for p in net))
    values = [padded(t) for t in texts]
    halves = responses(net, values)
    return np.round(probability(net, combined(halves, [len(v) // HALF for v in values])[1]), 12)


# fitting -------------------------------------------------------------------------------------------


def parts(n: int) -> list[slice]:
    return [slice(a, a + AT_ONCE) for a in range(0, n, AT_ONCE)]


def gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> Net:
    """Of the mean logistic loss, by the chain rule through maxima and means."""
    values = [padded(t) for t in texts]
    counts = [len(v) // HALF for v in values]
    seen = windows(values)
    k = net.filters.shape[1]
    best = np.empty((len(seen), k), dtype=np.int64)
    raw = np.empty((len(seen), k), dtype=net.filters.dtype)
    for part in parts(len(seen)):  # a long text is never held in embedded form
        embedded = net.embedding[seen[part].reshape(-1)].reshape(*seen[part].shape[:2], -1)
        answers = embedded @ net.filters
        best[part] = answers.argmax(axis=1)
        raw[part] = answers.max(axis=1) + net.bias
    halves = np.maximum(raw, 0)
    chunks, vectors = combined(halves, counts)
    error = (probability(net, vectors) - labels).astype(np.float32) / len(labels)

    back = np.zeros_like(halves)
    at = 0
    for chunk, n, e in zip(chunks, counts, error, strict=True):
        grad = np.repeat(e * net.weights[None, :k] / len(chunk), len(chunk), axis=0)
        np.add.at(grad, (chunk.argmax(axis=0), np.arange(k)), e * net.weights[k:])
        own = halves[at : at + n]
        if n > 1:
            first = own[:-1] >= own[1:]
            back[at : at + n - 1] += grad * first
            back[at + 1 : at + n] += grad * ~first
        else:
            back[at : at + n] += grad
        at += n
    back *= raw > 0
    filters, embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    for part in parts(len(seen)):
        chosen = seen[part][np.arange(len(best[part]))[:, None], best[part]]  # (halves, FILTERS, WIDTH) bytes
        inputs = net.embedding[chosen.reshape(-1)].reshape(*chosen.shape[:2], -1)
        filters += np.einsum("hfw,hf->wf", inputs, back[part], optimize=True)
        shares = (back[part][:, :, None] * net.filters.T[None]).reshape(-1, embedding.shape[1])
        at = chosen.reshape(-1)
        for d in range(embedding.shape[1]):
            embedding[:, d] += np.bincount(at, shares[:, d], len(embedding)).astype(embedding.dtype)
    return Net(embedding, filters, back.sum(axis=0), vectors.T @ error, np.array([error.sum()], dtype=np.float32))


def fit(texts: list[bytes], labels: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam steps on shuffled batches. ``share`` is how often label 1 is expected; the fit, which has learned how often
    it stands in ``labels``, is shifted by the difference of the two log odds."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Net(
        normal(257, EMBEDDED, scale=0.5),
        normal(WIDTH * EMBEDDED, FILTERS, scale=(WIDTH * EMBEDDED) ** -0.5),
        np.zeros(FILTERS, dtype=np.float32),
        normal(2 * FILTERS, scale=0.1),
        np.zeros(1, dtype=np.float32),
    )
    mean, square = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    steps = 0
    total = max(1, epochs * -(-len(texts) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            steps += 1
            rate = 0.02 * (1 - steps / (total + 1))
            for p, g, m, s in zip(net, gradients(net, [texts[i] for i in chosen], labels[chosen]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-7)
    ones = int((labels == 1).sum())
    learned = np.log((ones + 1) / (len(labels) - ones + 1))  # smoothed as ``share`` is: no shift if all labels were fitted
    return net._replace(intercept=net.intercept + np.float32(np.log(share / (1 - share)) - learned))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS, epochs: int = EPOCHS) -> Net:
    """Fits on the labelled documents with the ``rows`` smallest hashes of each class, none of them held out.

    A document labelled twice counts with its smaller label; null labels, ids and texts are left out. Without
    any label the score is one half, with one class only its smoothed share.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
    )
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    chosen = None
    for label in sorted(counts):
        some = known.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    if chosen is None:
        return fit([], np.zeros(0), 0.5, 0)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).where("_text is not null")
    sample = (
        texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # at most ``rows`` ids per class
        .groupBy("_id", "_label")
        .agg(F.min("_text").alias("_text"))
        .select("_id", "_label", F.col("_text").cast("binary").alias("_text"))
        .orderBy("_id")
        .collect()
    )
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return fit([bytes(r["_text"]) for r in sample], np.array([r["_label"] for r in sample]), share, epochs)


def unused(name: str, columns: list[str]) -> str:
    """``name``, behind as many underscores as no column has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def scored(docs: DataFrame, net: Net, name: str = "score") -> DataFrame:
    """``docs`` with the score as ``name``, which no column may have; a null text is scored as an empty one."""
    names = docs.columns
    at = names.index("text")
    width = len(names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 1 << 20):
            found = score(net, [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found)], [*names, name])

    return docs.mapInArrow(rows, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), f"`{name}` double"]))


def classify(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, repeated ones and null ids included."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return scored(plain, net).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
