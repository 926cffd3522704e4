"""License notices, exact and with edits.

A text is reduced to its words, one blank between them. Exact phrases are counted as they stand. Notices may differ from
their wording by some edits: a notice with at most k edits keeps one of k + 1 pieces unharmed, so the exact
pieces, found all at once by an Aho-Corasick automaton, point at every place worth looking at; there the regex library
matches the whole notice with a bounded number of errors and gives span and edits.
Edits are counted in bytes of the reduced UTF-8 text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import slices

# Phrases counted exactly, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Openings of well-known notices, as words, and their labels.
NOTICES = {
    "this work is licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
EDIT_SHARE = 0.1  # edits allowed per byte of a notice

TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Span(NamedTuple):
    first_word: int
    last_word: int
    label: str
    edits: int
    similarity: float


class Base(NamedTuple):
    words: int
    places: int
    first: int | None
    last: int | None
    labels: set[str]


def reduced(text: str | None) -> bytes:
    """Words (digits, letters, anything beyond ASCII; A-Z lower-cased), a blank before and after each."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def base(words: bytes, phrases: dict[str, str] = PHRASES) -> Base:
    at: list[int] = []
    labels: set[str] = set()
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        found = words.find(wanted)
        while found >= 0:
            at.append(found)
            labels.add(label)
            found = words.find(wanted, found + 1)
    n = words.count(b" ")
    first, last = (words.count(b" ", 0, min(at)), words.count(b" ", 0, max(at))) if at else (None, None)
    return Base(n - 1, len(at), first, last, labels)


class Finder:
    """Notices with their edits. ``notices``: wording in words -> label."""

    def __init__(self, notices: dict[str, str] = NOTICES, edit_share: float = EDIT_SHARE) -> None:
        import ahocorasick
        import regex

        self.notices = []
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for n, (wording, label) in enumerate(notices.items()):
            edits = int(len(wording) * edit_share)
            cuts = [len(wording) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                by_seed.setdefault(wording[a:b], []).append((n, b))
            by_seed.setdefault(wording, []).append((n, 0))  # the whole notice, unharmed
            pattern = regex.compile(rf"(?:{regex.escape(wording)}){{e<={edits}}}", regex.ENHANCEMATCH)
            self.notices.append((wording, label, edits, pattern))
        for seed, owners in by_seed.items():
            self.seeds.add_word(seed, (len(seed), owners))
        self.seeds.make_automaton()

    def spans(self, words: bytes) -> list[Span]:
        """Spans in text order that don't overlap; where notices compete for a place, the most similar one has it.

        An unharmed notice wins any place, so pieces inside one start no search.
        """
        text = words.decode("latin-1")
        hits = list(self.seeds.iter(text))
        found = [
            (0.0, end + 1 - size, end + 1, self.notices[n][1], 0)
            for end, (size, owners) in hits
            for n, seed_end in owners
            if not seed_end
        ]
        taken = np.zeros(len(text) + 1 if found else 0, dtype=bool)
        for _, a, b, *_ in found:
            taken[a:b] = True
        windows: dict[int, list[list[int]]] = {}
        for end, (size, owners) in hits:
            if found and taken[end + 1 - size : end + 1].any():
                continue
            for n, seed_end in owners:
                wording, _, edits, _ = self.notices[n]
                a = max(0, end + 1 - seed_end - edits)
                b = end + 1 + len(wording) - seed_end + edits
                known = windows.setdefault(n, [])
                if known and a <= known[-1][1]:
                    known[-1][1] = max(b, known[-1][1])
                else:
                    known.append([a, b])
        for n, areas in windows.items():
            wording, label, _, pattern = self.notices[n]
            for a, b in areas:
                for m in pattern.finditer(text[a:b]):
                    edits = sum(m.fuzzy_counts)
                    found.append((edits / len(wording), a + m.start(), a + m.end(), label, edits))
        kept: list[tuple] = []
        for one in sorted(found, key=lambda f: (f[0], -(f[2] - f[1]), f[1], f[3])):
            if all(one[2] <= k[1] or one[1] >= k[2] for k in kept):
                kept.append(one)
        return [
            Span(text.count(" ", 0, a + 1) - (text[a] != " "), text.count(" ", 0, b) - 1, label, edits, 1 - ratio)
            for ratio, a, b, label, edits in sorted(kept, key=lambda k: k[1])
        ]


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    notices: dict[str, str] = NOTICES,
    edit_share: float = EDIT_SHARE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: words, exact places, labels, spans of notices and a score.

    ``score`` is 1 with an exact phrase, else the similarity of the best notice, 0 without any. A null text is empty
    and has no words. Rows stay as they are, repeated ones and null ids included; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices, edit_share)
        for batch in slices(batches, 1):
            out = []
            for body in batch.column(1).to_pylist():
                words = reduced(body)
                exact, spans = base(words, phrases), finder.spans(words)
                out.append(
                    {
                        "n_words": exact.words,
                        "n_base": exact.places,
                        "first_word": exact.first,
                        "last_word": exact.last,
                        "base_labels": ",".join(sorted(exact.labels)),
                        "labels": ",".join(sorted(exact.labels | {s.label for s in spans})),
                        "score": 1.0 if exact.places else max((s.similarity for s in spans), default=0.0),
                        "spans": [s._asdict() for s in spans],
                    }
                )
            built = pa.Table.from_pylist(out, ROWS).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), *built.columns], ["doc_id", *ROWS.names])

    schema = (
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<first_word: bigint, last_word: bigint, label: string, "
        "edits: bigint, similarity: double>>"
    )
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)


ROWS = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("first_word", pa.int64()),
                        ("last_word", pa.int64()),
                        ("label", pa.string()),
                        ("edits", pa.int64()),
                        ("similarity", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)
