"""Jaccard join, byte passages and word passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import shingle_join, substrings, suffixes
from creditloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LAST = 2**63 - 1


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def joined(plain):
    sets = [shingles(t) for _, t in plain]
    parent = list(range(len(plain)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(plain):
        groups.setdefault(root(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((doc, len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(plain))


def test_jaccard_components(docs, plain, multiset):
    result = shingle_join.jaccard_components(docs)
    assert multiset(result, "doc_id", "n_shingles", "component_id") == joined(plain)


def test_jaccard_representatives(docs, plain):
    kept = shingle_join.representatives(docs).collect()
    groups = {c for _, n, c in joined(plain) if n}
    assert {r["place"] for r in kept if r["place"] != LAST} >= {g for g in groups if g is not None}


def test_cells_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(600):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = a[rng.random(len(a)) > rng.choice([0.02, 0.08, 0.1])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 9)), dtype=np.uint64)]))
        if len(b) and shingle_join.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            assert np.intersect1d(shingle_join.cells(a), shingle_join.cells(b)).size


def test_linked_sets_meet_in_spare_cells():
    """In one cell more than either has to spare, whatever crowds the others."""
    rng = np.random.default_rng(13)
    met = 0
    for _ in range(1500):
        n = int(rng.choice([rng.integers(1, 80), rng.integers(80, 300), rng.integers(300, 3000)]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        lost = int(rng.integers(0, 1 + len(a) // 9))
        keep = np.sort(rng.permutation(a)[lost:])
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 9)), dtype=np.uint64)]))
        if len(b) and shingle_join.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            least = max(shingle_join.spare(len(a)), shingle_join.spare(len(b)))
            met += least > 0
            assert np.intersect1d(shingle_join.cells(a), shingle_join.cells(b)).size > least
    assert met > 300


def test_points_keep_their_counts():
    counts = [np.zeros(256, np.int32), np.full(256, 255, np.int32), np.full(256, 256, np.int32), np.full(256, 70_000, np.int32)]
    blobs = [shingle_join.narrowed(c) for c in counts]
    assert [len(b) for b in blobs] == [256, 256, 512, 1024]
    assert np.array_equal(shingle_join.widened(blobs), np.array(counts))


def test_crowded_cells_lose_no_link(spark, monkeypatch, multiset):
    """Texts that share a passage, some of them near copies: small blocks make many cells crowded."""
    monkeypatch.setattr(shingle_join, "BLOCK", 5)
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared, texts = prose(60), []
    for _ in range(60):
        own = prose(240)
        texts.append(own + shared)
        near = list(own)
        for _ in range(rng.choice([0, 1, 3, 9])):
            near[rng.randrange(240)] = "edit"
        texts.append((shared + near) if rng.random() < 0.3 else near + shared)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    sets = [set(zip(*[t[k:] for k in range(5)], strict=False)) for t in texts]
    least = list(range(len(texts)))
    for _ in range(5):
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    want = {(i, len(s), least[i]) for i, s in enumerate(sets)}
    got = shingle_join.jaccard_components(table)
    assert set(multiset(got, "doc_id", "n_shingles", "component_id")) == want and len({w[2] for w in want}) < 100


def test_tree_finds_every_linked_point():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, int(rng.integers(5, 300)), dtype=np.uint64) for _ in range(40)]
    sets = [np.unique(s[rng.random(len(s)) > d]) for s in base for d in (0, 0.03, 0.08, 0.2, 0.5)]
    sets = [s for s in sets if len(s)]
    points, sizes = np.array([shingle_join.point(s) for s in sets]), np.array([len(s) for s in sets])
    tree = shingle_join.RTree(points, sizes)
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], sizes[i]).tolist())
        for j, t in enumerate(sets):
            if shingle_join.linked(len(np.intersect1d(s, t)), len(s), len(t)):
                assert j in found


def test_cells_with_several_components_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(40)]
    sets += [np.sort(np.concatenate([s[1:], rng.integers(0, 2**63, 1, dtype=np.uint64)])) for s in sets]
    table = spark.createDataFrame(
        [(i, len(s), 0, bytearray(shingle_join.narrowed(shingle_join.point(s))), bytearray(s.tobytes())) for i, s in enumerate(sets)],
        "class long, n long, spare int, point binary, tokens binary",
    )
    members = spark.range(len(sets)).select(F.lit(1).cast("long").alias("cell"), F.col("id").alias("class"), F.col("id").alias("component"))
    pairs = shingle_join.verified(shingle_join.tree_pairs(members, table).distinct(), table)
    assert {tuple(r) for r in pairs.collect()} == {(i, i + 40) for i in range(40)}


def test_a_pair_that_meets_in_many_cells_is_given_once(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 50, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base, rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(40)]
    table = spark.createDataFrame(
        [(i, len(s), 0, bytearray(shingle_join.narrowed(shingle_join.point(s)))) for i, s in enumerate(sets)], "class long, n long, spare int, point binary"
    )
    members = spark.range(40).select(F.col("id").alias("class"), F.col("id").alias("component"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("cell"))
    # every third set is missing in most cells, and the first ten meet in cells of their own as well
    met = members.where("class % 3 > 0 or cell % 20 = 7 or cell > 58 and class < 10").selectExpr("cast(cell as long) as cell", "class", "component")
    pairs = shingle_join.tree_pairs(met, table)
    assert pairs.distinct().count() == 40 * 39 // 2 and pairs.count() == 40 * 39 // 2


def test_star_pairs_fit_in_size(spark, monkeypatch, multiset):
    """Texts of many lengths that share a beginning: only pairs whose sizes allow a link are made."""
    made, plain_bounded = [], shingle_join.bounded

    def counted(pairs, sets):
        size = {r["class"]: r["n"] for r in sets.select("class", "n").collect()}
        made.extend((size[r["a"]], size[r["b"]]) for r in pairs.collect())
        return plain_bounded(pairs, sets)

    monkeypatch.setattr(shingle_join, "bounded", counted)
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    table = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(64, 128, 2)], "doc_id long, text string").repartition(3)
    got = shingle_join.jaccard_components(table)
    assert {r["component_id"] for r in got.collect()} == {64}
    assert made and all(5 * m >= 4 * n and 5 * n >= 4 * m for m, n in made)


def test_components_of_long_and_wide_graphs(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 500)] + [(7, 7), (3, 150)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {3} and found[3] == 3
    assert {found[i] for i in range(200, 500)} == {7} and found[7] == 7


def without_byte_repeats(plain, size):
    raw = [(d, (t or "").encode()) for d, t in plain]
    seen = Counter(t[i : i + size] for _, t in raw for i in range(len(t) - size + 1))
    out = Counter()
    for doc, text in raw:
        gone = [False] * len(text)
        for i in range(len(text) - size + 1):
            if seen[text[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        pieces = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[(doc, len(text), sum(gone), pieces, hashlib.sha256(kept).hexdigest())] += 1
    return out


BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("wide", [1 << 20, 0])
def test_repeated_bytes(docs, plain, multiset, monkeypatch, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)  # 0: windows are counted as rows
    assert multiset(suffixes.remove_repeats(docs), *BYTES) == without_byte_repeats(plain, 400)


def test_runs_of_a_text_in_pieces():
    """Every window lies in one run, wherever pieces end, and a run's windows have its smallest hash."""
    rng = random.Random(9)
    text = bytes(rng.choices(b"abc ", k=5000)) * 2 + bytes(rng.choices(b"xyz", k=777))
    whole = suffixes.text_runs(text)
    least = np.repeat(whole[0], whole[3])
    for piece in (1, 399, 400, 1000, 10_000, len(text)):
        hashes, _, starts, lengths, _ = suffixes.text_runs(text, 400, piece)
        assert np.array_equal(np.repeat(hashes, lengths), least)
        assert starts[0] == 0 and np.array_equal(starts[1:], (starts + lengths)[:-1])
    assert all(len(part) == 0 for part in suffixes.text_runs(b"x" * 399))


def test_stretches_are_the_covered_bytes():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        size = int(rng.integers(1, n + 1))
        starts = rng.integers(0, n - size + 1, int(rng.integers(0, 6)))
        lengths = np.array([int(rng.integers(1, n - size - s + 2)) for s in starts], dtype=np.int64)
        gone = np.zeros(n, dtype=bool)
        for a, m in zip(starts, lengths, strict=True):
            gone[a : a + m - 1 + size] = True
        begins, ends = suffixes.stretches(n, starts, lengths, size)
        edges = np.diff(gone.astype(int), prepend=0, append=0)
        assert begins.tolist() == np.flatnonzero(edges == 1).tolist() and ends.tolist() == np.flatnonzero(edges == -1).tolist()


def test_a_very_long_text(spark, docs):
    """Texts longer than a piece, with passages that stand again in a later piece, over a border, and elsewhere."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, border = letters(700), letters(900)
    long = passage + letters(suffixes.PIECE - 1000) + border + letters(300_000) + passage + letters(1000) + border
    rows = [(1, long), (2, letters(500) + passage), (3, letters(2000)), (4, border[:399]), (5, border[100:501])]
    seen = Counter()
    for _, t in rows:
        seen.update(hash(t[i : i + 400]) for i in range(len(t) - 399))
    want = Counter()
    for doc, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(t.encode(), dtype=np.uint8)[~gone].tobytes()
        pieces = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[(doc, len(t), int(gone.sum()), pieces, hashlib.sha256(kept).hexdigest())] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in suffixes.remove_repeats(table).select(*BYTES).collect())
    assert got == want and max(r[2] for r in want) > 3000


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(800):
        symbols = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 40))]
        assert suffixes.suffix_order(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def without_word_repeats(plain, size):
    first = {}
    words = [(LAST if d is None else d, d, WORD.findall(t or "")) for d, t in plain]
    for place, _, w in words:
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, place), place)
    out = Counter()
    for place, doc, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < place:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


WORDS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


@pytest.mark.parametrize("held", [1 << 20, 10])
def test_repeated_words(docs, plain, multiset, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD", held)
    assert multiset(substrings.remove_repeats(docs), *WORDS) == without_word_repeats(plain, 13)


@pytest.mark.parametrize("size", [13, 51])
@pytest.mark.parametrize("held", [1 << 20, 10])
def test_windows_of_two_documents(docs, plain, monkeypatch, held, size):
    monkeypatch.setattr(substrings, "HELD", held)
    words = {(LAST if d is None else d, t or ""): WORD.findall(t or "") for d, t in plain}
    holders = defaultdict(set)
    for key, w in words.items():
        for i in range(len(w) - size + 1):
            holders[tuple(w[i : i + size])].add(key)
    want = Counter()
    for (place, _), w in words.items():
        want.update((place, " ".join(w), i) for i in range(len(w) - size + 1) if len(holders[tuple(w[i : i + size])]) > 1)
    hashes = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("place"), F.xxhash64("text").alias("text_hash"), "text").distinct()
    found = substrings.shared_windows(docs, size).join(hashes, ["place", "text_hash"]).collect()
    got = {(r["place"], " ".join(WORD.findall(r["text"] or "")), i) for r in found for i in range(r["start"], r["start"] + r["length"])}
    assert got == set(want) and len(got) > 1000


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    """The first pass over the bytes of all texts sets how many rows a worker gets, and sets it back."""
    seen, plain_written = {}, suffixes.written

    def watched(df, label, *batch):
        seen[label] = batch
        return plain_written(df, label, *batch)

    monkeypatch.setattr(suffixes, "written", watched)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    suffixes.remove_repeats(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert seen["walks"] and seen["walks"][0] <= 256 and spark.conf.get(key) == before


def test_only_windows_of_two_documents_become_rows(spark, monkeypatch):
    """Texts that share phrases of five words, and few windows of thirteen: the others are never rows of a table."""
    made, plain_written = {}, substrings.written

    def counted(df, label):
        out = plain_written(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(substrings, "written", counted)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    phrases = [[word() for _ in range(5)] for _ in range(4)]
    texts = [[w for _ in range(30) for w in (*rng.choice(phrases), *(word() for _ in range(7)))] for _ in range(60)]
    texts[9][40:60] = texts[3][40:60]
    plain = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(plain, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in substrings.remove_repeats(table).select(*WORDS).collect())
    assert got == without_word_repeats([(i, t) for i, t in plain], 13)
    assert made["spans"] > 500 and made["edges"] < 50


def test_scratch_tables_go(spark, docs):
    """Only a query's own narrow result stays in the shared folder."""
    from pathlib import Path

    from creditloom.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "creditloom"
    for query in (shingle_join.jaccard_components, shingle_join.representatives, suffixes.remove_repeats):
        before = set(folder.iterdir()) if folder.exists() else set()
        rows = query(docs)
        after = set(folder.iterdir()) - before
        assert len(after) == 1 and rows.count() > 0


def test_empty_tables(empty):
    assert shingle_join.jaccard_components(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
