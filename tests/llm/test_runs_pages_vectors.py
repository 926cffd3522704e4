"""Periodic runs, WARC files and centroid clusters against brute force, round trips and plain loops."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from creditloom.llm import centroids, periods, queries, sql, warc
from creditloom.llm.common import importable
from creditloom.session import fresh_path

# periodic runs ------------------------------------------------------------------------------------------


def brute_runs(words):
    """All runs by comparing every word with the one every period further on."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            piece = words[i : j + q]
            if len(piece) >= max(12, 2 * q):
                smaller = any(all(piece[a] == piece[a + r] for a in range(len(piece) - r)) for r in range(1, q))
                if not smaller:
                    out.append((i, len(piece), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_and_periodic_words():
    rng = random.Random(3)
    for _ in range(1500):
        words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
        if words and rng.random() < 0.5:
            a, p = rng.randrange(len(words)), rng.randint(1, 8)
            words = words[:a] + [words[min(a + (i - a) % p, len(words) - 1)] for i in range(a, len(words))]
        assert periods.runs_of(words) == brute_runs(words), words
        assert periods.periodic([int(w) for w in words]) == brute_runs(words), words


def test_a_long_periodic_text_is_read_in_a_moment():
    words = [b"%d" % (i % 7001) for i in range(100_000)]
    assert periods.runs_of(words) == [(0, 100_000, 7001)]
    assert periods.collapsed(words, [(0, 100_000, 7001)]) == words[:7001]


def made(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [w.decode() for w in queries.made_periodic(doc_id, [w.encode() for w in words])]


def test_periodic_query_equals_brute_force(docs, plain):
    from collections import defaultdict

    got = periods.digests(periods.periodic_runs(docs, queries.made_periodic))
    found = defaultdict(list)
    for row in got.collect():
        found[row["doc_id"]].append(row.asDict())
    assert got.count() == len(plain)
    for doc_id, text in plain:
        words = made(doc_id, text)
        if len(words) > 1500:
            continue  # the long text has a test of its own below
        runs = brute_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = {
            "doc_id": doc_id,
            "n_runs": len(runs),
            "start": best and best[0],
            "length": best and best[1],
            "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(kept).encode()).hexdigest(),
        }
        assert want in found[doc_id]


def test_made_words_follow_the_rule():
    assert queries.made_periodic(None, [b"a"]) == [b"a"] and queries.made_periodic(10, []) == []
    chosen = [d for d in range(400) if queries.zlib.crc32(str(d).encode()) % 10 == 0]
    assert chosen
    for d in chosen:
        words = [b"%d" % i for i in range(50)]
        g = queries.zlib.crc32(str(d).encode()) // 10
        a = g % 50
        p = 1 + (50 - a) // (3 + g % 8)
        assert queries.made_periodic(d, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]


def test_no_texts_no_runs(empty, spark):
    assert periods.digests(periods.periodic_runs(empty)).count() == 0
    one = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    rows = periods.digests(periods.periodic_runs(one)).collect()
    assert [r["n_runs"] for r in rows] == [0, 0, 0] and all(r["start"] is None for r in rows)


# WARC ---------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, digest string, copies int, key string, n long"


@pytest.fixture(scope="module")
def pages(spark):
    """Short, empty, null, long and shared payloads, version lines in texts and addresses, repeated rows, null ids."""
    importable(spark)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abc é日\r\n<>", k=n))
    shared, nasty = text(3000), "WARC/1.1\r\nContent-Length: 0\r\n\r\n" * 900 + "WARC/1.1"
    bodies = [None, "", "x", text(999), text(1000), shared, shared, shared, text(400), nasty, nasty + "\r\n", "é" * 40_000]
    bodies += [shared[:500]] * 3 + [text(rng.randint(0, 90_000)) for _ in range(12)]
    rows = [(7 * i, f"http://a/{i}", b) for i, b in enumerate(bodies)]
    rows += [rows[5], rows[7], rows[7], rows[2], (None, None, shared), (None, None, shared), (None, None, None)]
    rows += [(900, "http://a/WARC/1.1", "y" * 5000), (900, "http://b/\r\n x", "y" * 5000), (901, None, "z" * 70_000)]
    return spark.createDataFrame([(*r, "p", "d", 1, "k", 2) for r in rows], PAGES).repartition(5).persist()


def wanted(rows):
    """page_id, size, digest, type and refers_to by a loop over all rows."""
    groups = {}
    for page, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = Counter()
    for payload, members in groups.items():
        digest = hashlib.sha1(payload).hexdigest()
        members.sort(key=lambda p: -1 if p is None else p, reverse=True)
        for place, page in enumerate(members):
            again = len(payload) >= 1000 and place > 0
            out[(page, len(payload), digest, "revisit" if again else "response", members[0] if again else None)] += 1
    return out


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("sizes", [(32768, 8192), (100, 7), (5000, 100_000)])
def test_pages_come_back(spark, pages, multiset, sizes):
    some = pages if sizes[0] > 1000 else pages.where("length(html) < 5000 or html is null or page_id = 63")
    folder = fresh_path(spark, "warc")
    warc.write(some, folder, *sizes, compression="none" if sizes[0] == 5000 else "gzip")
    records = warc.read(spark, folder)
    assert records.where("problem is not null").count() == 0
    rows = [(r["page_id"], r["html"]) for r in some.collect()]
    assert multiset(warc.described(records), *COLUMNS) == wanted(rows)
    payloads = Counter(bytes(r["payload"]) for r in records.where("type = 'response'").collect())
    assert set(payloads) == {(h or "").encode() for _, h in rows}


def test_files_are_warc(spark, pages):
    """Read by a plain loop over the bytes: every Content-Length leads to the next record."""
    folder = fresh_path(spark, "warc")
    warc.write(pages, folder, 1000, 300)
    kinds = Counter()
    for path in Path(folder).glob("part-*.gz"):
        data, at = gzip.decompress(path.read_bytes()), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            assert lines[0] == b"WARC/1.1"
            fields = dict(line.split(b": ", 1) for line in lines[1:])
            assert {b"WARC-Record-ID", b"WARC-Type", b"WARC-Date", b"Content-Length"} <= set(fields)
            kinds[fields[b"WARC-Type"].decode()] += 1
            at += len(head) + 4 + int(fields[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert kinds["response"] and kinds["revisit"] and kinds["continuation"] > 100


def test_broken_records_are_told(spark, pages):
    folder = fresh_path(spark, "warc")
    warc.write(pages.where("page_id = 77").coalesce(1), folder, 20_000, 8192, compression="none")
    (path,) = [p for p in Path(folder).glob("part-*") if p.stat().st_size]
    parts = [b"WARC/1.1\r\n" + p for p in path.read_bytes().split(b"WARC/1.1\r\n")[1:]]
    assert len(parts) == 5

    def problem(records):
        changed = Path(fresh_path(spark, "warc"))
        changed.mkdir(parents=True)
        (changed / "a.warc").write_bytes(b"".join(records))
        (row,) = warc.read(spark, str(changed)).collect()
        assert (row["payload"] is None) == (row["problem"] is not None)
        return row["problem"]

    assert problem(parts) is None and problem(parts[::-1]) is None and problem([*parts, parts[1]]) is None
    assert problem(parts[:2] + parts[3:]) == "segment missing" and problem(parts[1:]) == "segment missing"
    assert problem(parts[:-1]) == "no last segment"
    longer = parts[2].replace(b"Content-Length: 20000", b"Content-Length: 20001")
    assert problem([*parts[:2], longer, *parts[3:]]) == "content length differs"
    total = re.sub(rb"Total-Length: \d+", b"Total-Length: 5", parts[-1])
    assert problem([*parts[:-1], total]) == "total length differs"
    assert problem([parts[0].replace(b"\r\n2000\r\n", b"\r\n20x0\r\n"), *parts[1:]]) == "broken chunks"
    first, _, digest = parts[0].partition(b"sha1:")
    assert problem([first + b"sha1:" + b"A" * 32 + digest[32:], *parts[1:]]) == "payload digest differs"


def test_no_pages(spark):
    folder = fresh_path(spark, "warc")
    warc.write(spark.createDataFrame([], PAGES), folder)
    assert warc.described(warc.read(spark, folder)).count() == 0


# centroids ----------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, salt):
    """Plain loops over (vec_id, whole numbers)."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(x) for _, x in order[:k]]
    for last in [False] * rounds + [True]:
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centers)) for _, x in rows]
        if last:
            return centers, near
        for i in range(len(centers)):
            mine = [x for (_, x), (_, c) in zip(rows, near, strict=True) if c == i]
            if mine:
                centers[i] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]


@pytest.fixture(scope="module")
def vectors(spark):
    importable(spark)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.02, 6).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)] + [rows[3], rows[3], (None, [0.25] * 6), (None, [0.25] * 6)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [None]), (504, [float("nan")] * 6), (505, [float("inf")] * 6)]
    rows += [(506, [-300.0, 300.0] * 3), (507, [1e30] * 6), (508, [0.0] * 6)]
    schema = "vec_id long, embedding array<float>, label int, cluster int, distance string, n int"
    return spark.createDataFrame([(*r, 1, 2, "d", 3) for r in rows], schema).repartition(4).persist()


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (7, 5), (40, 3), (400, 1)])
def test_clusters_equal_plain_loops(vectors, k, rounds):
    rows = []
    for r in vectors.collect():
        x = r["embedding"]
        if x is not None and len(x) == 6 and all(v is not None and abs(v) < 2**19 for v in x):
            rows.append((r["vec_id"], [int(np.floor(256 * v)) for v in x]))
    centers, near = lloyd(rows, k, rounds, 2)
    found, got = centroids.clusters(vectors, k, rounds, 6)
    assert got.tolist() == centers
    described = centroids.described(found, got).collect()
    want = Counter((r[0], c, d) for r, (d, c) in zip(rows, near, strict=True))
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in described) == want
    for r in described:
        assert r["inertia"] == sum(d for d, _ in near)
        assert r["cluster_inertia"] == sum(d for d, c in near if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_tournament_is_exact_at_the_largest_numbers():
    rng = np.random.default_rng(1)
    far = centroids.LARGEST - 1
    centers = rng.choice([-far - 1, far, 0, 1], size=(9, 64))
    x = np.concatenate([rng.choice([-far - 1, far], size=(50, 64)), centers, rng.integers(-3, 3, (20, 64))])
    planes = centroids.bisectors(centers)
    want = [min(range(9), key=lambda i, v=v: sum((int(a) - int(b)) ** 2 for a, b in zip(v, centers[i], strict=True))) for v in x]
    assert centroids.winners(planes, x).tolist() == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found, centers = centroids.clusters(none)
    assert found.count() == 0 and len(centers) == 0
    assert centroids.described(found, centers).count() == 0
    no_ids = spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert centroids.described(*centroids.clusters(no_ids)).count() == 0


# SQL ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(sql.statements()))
def test_query_equals_sql(spark, multiset, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(sql.statements()[name])
    columns = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert multiset(df, *columns) == Counter(cursor.fetchall())
