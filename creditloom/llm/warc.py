"""WARC files: pages written in segments with chunked transfer framing, read back and put together again.

A page becomes an HTTP response with a chunked body. A block longer than ``segment_bytes`` is cut into a first record with
``WARC-Segment-Number: 1`` and ``continuation`` records that name it as their origin; the last one gives the total length.
Of equal payloads one page is written in full, the others as ``revisit`` records that refer to it.

Files are text files to Spark, so any file system that Spark writes to will do. Compressed ones are read by a task each;
uncompressed ones are split between records. Payloads are cut inside of every version line they hold ("WARC" | "/1.1"), so that only records begin with one.
Pages are shuffled once, by page and digest; which page is the full one is decided on narrow rows, and common digests are
spread over tasks. On reading, only segments are shuffled, by origin; a task holds one page at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import written

# fixed values of the format
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"

SEGMENT_BYTES = 32 << 10  # of a record's block
CHUNK_BYTES = 8 << 10  # of the transfer framing
LEAST_BYTES = 1000  # smaller payloads are always written in full
DATE = "2024-01-01T00:00:00Z"
OUT_BYTES = 8 << 20


# one page to records ------------------------------------------------------------------------------------


def chunked(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunks; a version line in it is cut between two of them."""
    cuts = set(range(0, len(payload), chunk_bytes)) | {len(payload)}
    cuts |= {m.start() + 4 for m in re.finditer(rb"WARC/1\.1", payload)}
    places = sorted(cuts)
    out = []
    for a, b in zip(places, places[1:], strict=False):
        out += [b"%x\r\n" % (b - a), payload[a:b], b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def record_id(key: str, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{key}|{digest}|{copy}'.encode()).digest()[:16], version=5)}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the empty lines that end it."""
    lines = [f"{name}: {value}\r\n".encode() for name, value in [*fields, ("Content-Length", str(len(block)))]]
    return b"".join([VERSION, *lines, b"\r\n", block])


class Page(NamedTuple):
    page_id: int | None
    key: str  # page_id and url
    url: str | None
    payload: bytes
    digest: str  # lower-case hex SHA-1
    copies: int
    full: str | None  # the key of the page that has this payload in full, where pages share it


def target(url: str | None) -> str:
    """A header value: no line ends, no version line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "about:blank").replace("WARC/", "WARC%2F")


def records(page: Page, segment_bytes: int, chunk_bytes: int, least_bytes: int) -> Iterator[bytes]:
    """The records of all copies of a page; of repeated rows with a long payload the first is the full one."""
    base32 = base64.b32encode(bytes.fromhex(page.digest)).decode()
    body = None
    for copy in range(page.copies):
        own = record_id(page.key, page.digest, copy)
        fields = [
            ("WARC-Record-ID", own),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", target(page.url)),
            ("WARC-Payload-Digest", f"sha1:{base32}"),
            *([("X-Page-ID", str(page.page_id))] if page.page_id is not None else []),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        original = page.full or page.key
        if len(page.payload) >= least_bytes and (copy or original != page.key):
            more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, page.digest, 0))]
            yield record([("WARC-Type", "revisit"), *fields, *more], b"HTTP/1.1 200 OK\r\n\r\n")
            continue
        if body is None:
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
            body = head + chunked(page.payload, chunk_bytes)
        if len(body) <= segment_bytes:
            yield record([("WARC-Type", "response"), *fields], body)
            continue
        last = -(-len(body) // segment_bytes)
        for number in range(1, last + 1):
            piece = body[(number - 1) * segment_bytes : number * segment_bytes]
            if number == 1:
                yield record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", "1")], piece)
                continue
            part = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", record_id(own, page.digest, number)),
                ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Number", str(number)),
            ]
            yield record(part + ([("WARC-Segment-Total-Length", str(len(body)))] if number == last else []), piece)


# writing ------------------------------------------------------------------------------------------------


def looked_up(rows: DataFrame, found: DataFrame, key: str, tag: str) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row per ``key``; null where there is none).

    A key that very many rows share is spread by ``tag``: ``found`` is copied to the parts that its rows are in, and
    counting those takes a partial aggregation.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(tag), F.lit(parts)))
    spread = dealt.select(key, "_part").where(F.col(key).isNotNull()).distinct().join(found, key)
    return dealt.join(spread, [key, "_part"], "left").drop("_part")


def keyed_pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    number, address = F.col(page_id).cast("bigint"), F.col(url).cast("string")
    key = F.concat_ws("|", F.coalesce(number.cast("string"), F.lit("none")), address)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        number.alias("page_id"), key.alias("key"), address.alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )


def originals(rows: DataFrame, least_bytes: int) -> DataFrame:
    """key, digest and ``full``, the key of the largest page_id with that digest, of pages that share a long payload."""
    long = rows.where(F.length("payload") >= least_bytes).select("page_id", "key", "digest")
    long = written(long, "digests")
    largest = F.max(F.struct("page_id", "key"))["key"]
    full = long.groupBy("digest").agg(largest.alias("full"), F.min("key").alias("least")).where("full <> least")
    return looked_up(long.select("key", "digest").distinct(), full, "digest", "key").where("full is not null")


def write(
    pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES,
    least_bytes: int = LEAST_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip",
) -> None:
    """A WARC record (or its segments) per row of ``pages``, in files below ``folder``, one per task.

    A null html is an empty payload. Of equal payloads of at least ``least_bytes`` the page with the largest page_id is
    written in full (of several rows with that page_id the one with the largest url); equal rows are copies that revisit the
    first. Rows without a page_id come before all others in that order. An empty table gives no records. Other columns are
    ignored.
    """
    rows = keyed_pages(pages, page_id, url, html)
    once = rows.groupBy("key", "digest").agg(
        F.first("payload").alias("payload"), F.first("url").alias("url"), F.first("page_id").alias("page_id"),
        F.count(F.lit(1)).alias("copies"),
    )
    dealt = once.join(originals(rows, least_bytes).select("key", "digest", "full"), ["key", "digest"], "left")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[bytes] = []
        size = 0
        for batch in batches:
            for row in range(batch.num_rows):
                page = Page(*(c[row].as_py() for c in batch.columns))
                for found in records(page, segment_bytes, chunk_bytes, least_bytes):
                    block.append(found)
                    size += len(found)
                    if size > OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary())], ["value"])
                        block, size = [], 0
        if block:
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.binary())], ["value"])

    out = dealt.select(*Page._fields).mapInArrow(lines, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.options(lineSep=BREAK.decode(), compression=compression).text(folder)


# reading ------------------------------------------------------------------------------------------------

PARSED = (
    "record_id string, origin string, number int, total bigint, type string, refers string, page_id bigint, "
    "uri string, digest string, block binary, problem string"
)
READ = "record_id string, type string, refers string, page_id bigint, uri string, payload binary, problem string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
    )


def in_batches(rows: Iterator[tuple], schema: str, sized: int) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    size = 0
    for row in rows:
        block.append(row)
        size += 200 + len(row[sized] or b"")
        if size > OUT_BYTES:
            yield _batch(block, schema)
            block, size = [], 0
    if block:
        yield _batch(block, schema)


def number_in(fields: dict[str, str], name: str) -> int | None:
    value = fields.get(name, "")
    return int(value) if value.isdigit() else None


def parsed(raw: bytes) -> tuple:
    """A record, from behind its version line to the empty lines that end it, as a row of ``PARSED``."""
    head, _, rest = raw.partition(BREAK)
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    length = number_in(fields, "content-length")
    problem = None
    if length is None or len(rest) not in (length, length + len(BREAK)) or rest[length:] not in (b"", BREAK):
        problem = "content length differs"
    own = fields.get("warc-record-id")
    origin = fields.get("warc-segment-origin-id") or (own if "warc-segment-number" in fields else None)
    return (
        own, origin, number_in(fields, "warc-segment-number"), number_in(fields, "warc-segment-total-length"),
        fields.get("warc-type"), fields.get("warc-refers-to"), number_in(fields, "x-page-id"), fields.get("warc-target-uri"),
        fields.get("warc-payload-digest"), rest[:length], problem,
    )


def dechunked(body: bytes) -> bytes | None:
    """The data of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out) if body.endswith(b"\r\n") else None  # trailer fields may follow
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def opened(block: bytes) -> tuple[bytes | None, str | None]:
    """The payload of an HTTP response and what is wrong with it."""
    head, found, body = block.partition(BREAK)
    if not found:
        return None, "no end of the HTTP header"
    fields = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    if any(name.strip() == b"transfer-encoding" and value.strip() == b"chunked" for name, _, value in fields):
        body = dechunked(body)
        return body, None if body is not None else "broken chunks"
    return body, None


def finished(row: dict, block: bytes | None, problem: str | None) -> tuple:
    payload = None
    if problem is None and row["type"] == "response":
        payload, problem = opened(block or b"")
        if problem is None and (row["digest"] or "").startswith("sha1:"):
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != row["digest"][5:].upper():
                payload, problem = None, "payload digest differs"
    return row["record_id"], row["type"], row["refers"], row["page_id"], row["uri"], payload, problem


def reassembled(pieces: Iterator[dict]) -> Iterator[tuple]:
    """Rows of ``READ`` from segments sorted by origin and number."""
    first: dict | None = None
    origin, blocks, total, problem = None, [], None, None

    def close() -> tuple:
        size = sum(map(len, blocks))
        wrong = problem or ("no last segment" if total is None else "total length differs" if size != total else None)
        head = first or {"record_id": origin, "type": None, "refers": None, "page_id": None, "uri": None, "digest": None}
        return finished(head, b"".join(blocks), wrong)

    expected = 0
    for piece in pieces:
        if piece["origin"] != origin:
            if origin is not None:
                yield close()
            origin, first, blocks, total, problem, expected = piece["origin"], None, [], None, None, 1
        if piece["number"] == expected - 1:
            continue  # a segment that is stored twice
        if piece["number"] != expected or total is not None:
            problem = problem or "segment missing"
        expected = (piece["number"] or 0) + 1
        problem = problem or piece["problem"]
        if piece["number"] == 1:
            first = piece
        blocks.append(piece["block"])
        total = piece["total"] if piece["total"] is not None else total
    if origin is not None:
        yield close()


def dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, type, refers, page_id, uri, payload and problem of every record, segments put together.

    ``payload`` is the decoded body of a response; a revisit has none. A record whose length, segments, framing or digest
    don't fit has a ``problem`` and no payload. Files may be compressed or not; a payload of another writer that holds
    a version line shows as a length that differs.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(folder).where("value <> ''")
    head = F.lower(F.concat(F.lit("\r\n"), F.substring_index("value", BREAK.decode(), 1)))
    segmented = head.contains("\r\nwarc-segment-number:")
    value = F.col("value").cast("binary")

    names = [f.split()[0] for f in PARSED.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((parsed(v.as_py()) for b in batches for v in b.column(0)), PARSED, 9)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (dict(zip(names, parsed(v.as_py()), strict=True)) for b in batches for v in b.column(0))
        yield from in_batches((finished(p, p["block"], p["problem"]) for p in found), READ, 5)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(reassembled(dicts(batches)), READ, 5)

    whole = raw.where(~segmented).select(value).mapInArrow(single, READ)
    segments = raw.where(segmented).select(value).mapInArrow(parse, PARSED)
    sorted_segments = segments.repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(sorted_segments.mapInArrow(joined, READ))


def described(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to per response and revisit; fails on a problem.

    A revisit takes size and digest from the response it refers to, which has to be among the records.
    """
    wrong = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("record_id", F.lit(": "), "problem")).cast("string"))
    kind = wrong.otherwise(F.col("type")).alias("record_type")
    size, digest = F.length("payload").cast("bigint"), F.sha1("payload")
    plain = written(
        found.select("record_id", kind, "refers", "page_id", size.alias("payload_bytes"), digest.alias("payload_digest")), "records"
    )
    responses, revisits = plain.where("record_type = 'response'"), plain.where("record_type = 'revisit'")
    full = responses.select(
        F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    again = looked_up(revisits.select("record_id", "record_type", "refers", "page_id"), full, "refers", "record_id")
    missing = F.raise_error(F.concat("record_id", F.lit(": refers to no record"))).cast("string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(columns).unionByName(
        again.withColumn("payload_digest", F.coalesce("payload_digest", missing)).select(columns)
    )
