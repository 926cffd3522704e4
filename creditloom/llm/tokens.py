"""Token ids of whole texts with a BPE vocabulary of the tokenizers library.

White space ends every piece that the vocabulary's pattern cuts, so a text is the sequence of its chunks
between blanks, and equal chunks have equal ids. A task keeps the ids of chunks it has met; a chunk of plain
letters and punctuation is put together from the ids of its two parts, every other one goes through the whole
tokenizer, also one that holds the string of a special token (no such string has a blank or is plain). Both caches are
emptied at a fixed size.
"""

from __future__ import annotations

import os
import re
import struct

CACHED = 500_000  # chunks, and as many letter runs, that a task remembers

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters that the normaliser only lower-cases
PUNCTUATION = r"!-/:-@\[-`{-~"
PLAIN = re.compile(rf"([{LETTERS}]+)([{PUNCTUATION}]*)\Z")


def byte_alphabet() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(256 + rest.index(b)) for b in range(256)]


class ChunkIds(dict):
    """chunk -> ids as little-endian unsigned 32-bit integers.

    With ``special`` the string of a special token gets that token's id, as the library does by itself; without, it is
    ordinary text.
    """

    def __init__(self, path: str, limit: int = CACHED, special: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.limit = limit
        self.runs: dict[str, bytes] = {}
        self.bytes = byte_alphabet()

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, letters: str) -> bytes:
        ids = self.runs.get(letters)
        if ids is None:
            if len(self.runs) >= self.limit:
                self.runs.clear()
            mapped = letters if letters.isascii() else "".join(map(self.bytes.__getitem__, letters.encode()))
            found = [token.id for token in self.tokenizer.model.tokenize(mapped)]
            ids = self.runs[letters] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        plain = PLAIN.match(chunk)
        if plain:
            letters, marks = plain.groups()
            ids = self.run(letters.lower()) + (self[marks] if marks else b"")
        else:
            ids = self.whole(chunk)
        self[chunk] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text is an empty one."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))) if text else b""


_loaded: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One per worker process and vocabulary; ids as the library's plain call gives them."""
    if path not in _loaded:
        _loaded[path] = ChunkIds(path, special=True)
    return _loaded[path]
