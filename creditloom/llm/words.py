"""Hashes of all words of many texts at once."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240601)
BYTES = _random.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PLACES = [np.uint64(int(x) | 1) for x in _random.integers(1, 2**63, 64, dtype=np.uint64)]
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, UNBASE)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; [0] is 0. ``span_hashes`` reads hashes of spans from it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of bytes [start, end), the same wherever the span stands."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~BLANK[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without white space of ASCII) and, per text, where its words begin (and the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    if lower:
        joined = joined.translate(LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = word_bounds(data)
    texts_at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return span_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, texts_at)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for place in range(size):
        out += words[place : place + n] * PLACES[place % len(PLACES)]
    return mix(out)
