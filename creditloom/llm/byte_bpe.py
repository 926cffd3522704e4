"""Byte-level BPE with ranks, run by a sentencepiece model made from the vocabulary.

Every rank becomes a piece whose characters stand for its bytes, scored by the negative rank, so that the best-scored
merge is the one of lowest rank, leftmost first. The model neither normalises nor marks blanks. A pre-token that is in the
vocabulary is its rank; any other goes through the model. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import slices

CACHED = 500_000  # chunks that a task remembers
FIRST = 0x100  # the character of byte 0

# White space other than a blank or a single line end, or two in a row with a blank among them: there the cut
# at blanks could differ from the pattern's.
ODD_BLANKS = re.compile("  |\n | \n|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def piece(data: bytes) -> str:
    return "".join(chr(FIRST + b) for b in data)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: an unknown piece, then the vocabulary in order of rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(ranks) + 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id = 0, -1
    model.trainer_spec.eos_id, model.trainer_spec.pad_id = -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    unknown = model.pieces.add()
    unknown.piece, unknown.type = "<unk>", pb.ModelProto.SentencePiece.UNKNOWN
    for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
        one = model.pieces.add()
        one.piece, one.score = piece(token), -float(rank)
    return model.SerializeToString()


class Coded(NamedTuple):
    n: int
    ids: bytes  # decimal, each followed by a comma
    decoded: bytes


class Codec:
    """Encodes texts to ids and ids to bytes. What it has coded it keeps, per chunk between blanks."""

    def __init__(self, path: str, pattern: str, limit: int = CACHED) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.in_order = sorted(self.ranks.values())
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.pre_tokens = regex.compile(pattern).findall
        self.limit = limit
        self.coded: dict[str, Coded] = {}

    def encode(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token. The model is called once for all that the vocabulary doesn't hold as they are."""
        data = [token.encode("utf-8", "surrogatepass") for token in pre_tokens]
        ids = [[self.ranks[d]] if d in self.ranks else [] for d in data]
        merged = [i for i, known in enumerate(ids) if not known]
        if merged:
            coded = self.model.encode([piece(data[i]) for i in merged], num_threads=1)
            for i, found in zip(merged, coded, strict=True):
                ids[i] = [self.in_order[k - 1] for k in found]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        """A pre-token never goes past a blank that has no other white space beside it, except to start with it."""
        if not text or ODD_BLANKS.search(text):
            return self.pre_tokens(text)
        first, *rest = text.split(" ")
        return [first, *[" " + chunk for chunk in rest]]

    def code(self, texts: list[str]) -> list[list[Coded]]:
        cut = [self.chunks(text) for text in texts]
        if len(self.coded) > self.limit:
            self.coded.clear()
        new = [chunk for chunk in set().union(*cut) if chunk not in self.coded]
        inside = [self.pre_tokens(chunk) for chunk in new]
        tokens = list(set().union(*inside)) if inside else []
        ids = dict(zip(tokens, self.encode(tokens), strict=True)) if tokens else {}
        for chunk, parts in zip(new, inside, strict=True):
            own = [i for part in parts for i in ids[part]]
            self.coded[chunk] = Coded(len(own), "".join([f"{i}," for i in own]).encode(), self.decode(own))
        return [list(map(self.coded.__getitem__, chunks)) for chunks in cut]


def round_trips(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; a null text is an empty one.

    Rows stay as they are, repeated ones and null ids included; other columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in slices(batches, 1):
            counts, ids, decoded = [], [], []
            for coded in codec.code([body or "" for body in batch.column(1).to_pylist()]):
                counts.append(sum(c.n for c in coded))
                ids.append(hashlib.sha256(b"".join([c.ids for c in coded])[:-1]).hexdigest())
                decoded.append(hashlib.sha256(b"".join([c.decoded for c in coded])).hexdigest())
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, schema)
