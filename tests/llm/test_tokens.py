"""Packing, token files and byte-level BPE against the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from creditloom.llm import byte_bpe, packing, token_files
from creditloom.llm.tokens import ChunkIds
from creditloom.session import fresh_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["it's don't 'tis O'Neil's", "<|endoftext|> x<|startoftext|>", "ÀÉß ß! ŒŸŸ İ", "x\x1cy\x85z w  \t\r\n q", "12ab34", "日本 ñ ª", "áb ́"]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


def little(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_chunks_equal_the_whole_tokenizer(encode, texts):
    chunks = ChunkIds(WORDS, limit=50)
    for text in [*texts, *ODD]:
        assert chunks.text(text) == little(encode(text))


def test_operators_give_the_ids_of_the_plain_call(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    texts = ["end <|endoftext|> next", "x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "a\n<|endoftext|>\u0338 's"]
    ids = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [806, 49407, 1131]
    chunks = ChunkIds(WORDS, special=True)
    assert [chunks.text(t) for t in [*texts, *ODD]] == [little(whole.encode(t, add_special_tokens=False).ids) for t in [*texts, *ODD]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = {r["doc_id"]: r for r in packing.pack_documents(docs, WORDS).collect()}
    assert [(packed[i]["length"], packed[i][4]) for i in range(len(texts))] == [(len(x) + 1, zlib.crc32(little([*x, 1]))) for x in ids]
    folder = fresh_path(spark, "test-special")
    token_files.write(token_files.encode(docs, WORDS), folder)
    stored = token_files.read(spark, folder).orderBy("doc_id").collect()
    assert [r["ids"] for r in stored] == [[*x, 2] for x in ids]


def test_pieces_and_places(docs, plain, encode):
    capacity = 256
    rows = packing.pack_documents(docs, WORDS, capacity).collect()
    want = Counter()
    for doc, text in plain:
        ids = [*encode(text), 1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[(doc, n, start, len(part), zlib.crc32(little(part)))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= 1.1 * math.ceil(sum(k[3] for k in want.elements()) / capacity) + 1


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 4096])
    counts = {rng.randint(1, capacity): rng.randint(1, 300) for _ in range(rng.randint(1, 60))}
    segments, used = packing.plan(counts, capacity, groups=rng.choice([1, 8, 32]))
    ends, seen = defaultdict(list), Counter()
    for s in segments:
        for i in range(s.count):
            ends[s.sequence + i // s.per_sequence].append((s.offset + i % s.per_sequence * s.length, s.length))
            seen[(s.length, s.rank + i)] += 1
    assert seen == Counter({(length, i): 1 for length, n in counts.items() for i in range(n)})
    for placed in ends.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    assert max(ends) + 1 == len(ends) == used


def test_token_files_round_trip(spark, docs, plain, encode):
    folder = fresh_path(spark, "test-tokens")
    token_files.write(token_files.encode(docs, WORDS), folder)
    rows = token_files.digests(token_files.read(spark, folder)).collect()
    ids = {}
    for doc, text in plain:
        ids.setdefault(doc, []).append([*encode(text), 2])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter(
        (d, len(i), zlib.crc32(little(i))) for d, all_ids in ids.items() for i in all_ids
    )
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order == sorted(order)
    stored = token_files.read(spark, folder).where("doc_id = 3")
    assert [r["ids"] for r in stored.collect()] == [[2]]


def test_byte_bpe_equals_the_rank_library(docs, plain):
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc, text in plain:
        ids = own.encode_ordinary(text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[(doc, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    rows = byte_bpe.round_trips(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(map(tuple, rows)) == want

    codec, rng = byte_bpe.Codec(RANKS, public_tokenizers.PATTERN, limit=100), random.Random(2)
    letters = [" ", "\n", "\t", "a", "b", "'s", "'", "1", "é", "\x85", "\xa0", "　", "\x1c", "!", "日", "\r\n", "٣", "²", "​"]
    odd = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(3000)]
    for text, coded in zip(odd, codec.code(odd), strict=True):
        assert b"".join(c.ids for c in coded).decode() == "".join(f"{i}," for i in own.encode_ordinary(text))


def test_empty_tables(spark, empty):
    assert packing.pack_documents(empty, WORDS).count() == 0
    folder = fresh_path(spark, "test-tokens")
    token_files.write(token_files.encode(empty, WORDS), folder)
    assert token_files.digests(token_files.read(spark, folder)).count() == 0
    assert byte_bpe.round_trips(empty, RANKS, public_tokenizers.PATTERN).count() == 0
