"""Tables of a stream as lists of folders, one list per version.

A version (the number of a micro-batch) names for every table the parts that hold its rows; a part is a folder written by
one batch, or several batches merged, split into hash buckets. A batch writes parts beside those in use and then puts its
list in place by renaming it. Until then readers see the version before, so a batch that dies changes nothing, and one that
is repeated starts from the same version again.

As soon as ``fan`` parts of one size class stand side by side they become one part of the next class, so a table
has some ``fan`` parts per class, and the classes grow with the logarithm of the number of batches. Parts and lists that no
kept version names are deleted.

A part can carry a filter on a text key: 512-bit blocks in which each key sets one bit per word. A lookup reads the
blocks of its keys, and keys themselves only from buckets in which a block answers yes.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from creditloom.operators.keyed import last_per_key

BASE = -1  # the version of what was there before the stream
WORDS = 8  # of a filter block
KEYS_PER_BLOCK = 21  # 24 bits a key: about one key in ten thousand is looked up in vain


@dataclass(frozen=True)
class Part:
    folder: str
    first: int  # batches
    last: int
    tier: int
    buckets: tuple[int, ...]
    blocks: int = 0  # of its filter


@dataclass
class Table:
    schema: str
    by: str = "customer_id"
    newest: bool = False  # only the newest row per ``by`` counts
    filtered: bool = False
    parts: list[Part] = field(default_factory=list)


class Files:
    """The few file operations that Spark's readers and writers don't offer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._system.exists(path):
            return []
        return [entry.getPath().getName() for entry in self._system.listStatus(path)]

    def read(self, name: str) -> str:
        stream = self._system.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """``text`` under ``name``: whole or not at all."""
        aside, place = self._path(f"_new/{uuid.uuid4().hex}"), self._path(name)
        stream = self._system.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._system.mkdirs(place.getParent())
        if self._system.exists(place):  # a batch that is repeated; until the next line its readers see the version before
            self._system.delete(place, False)
        if not self._system.rename(aside, place):
            raise OSError(f"could not put {name} in place")

    def remove(self, name: str) -> None:
        self._system.delete(self._path(name), True)


class Versions:
    """``keep`` versions stay readable; a batch can be repeated as long as the version before it is one of them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, fan: int = 8, keep: int = 3) -> None:
        if fan < 2 or keep < 2:
            raise ValueError("fan and keep are at least 2")
        self.spark, self.root, self.buckets, self.fan, self.keep = spark, root.rstrip("/"), buckets, fan, keep
        self.files = Files(spark, self.root)

    def committed(self) -> list[int]:
        names = (n.removesuffix(".json") for n in self.files.names("versions") if n.endswith(".json"))
        return sorted(int(n) - 1 for n in names if n.isdigit())

    def _load(self, version: int) -> dict[str, Table]:
        found = json.loads(self.files.read(f"versions/{version + 1:012d}.json"))
        parts = lambda rows: [Part(**{**p, "buckets": tuple(p["buckets"])}) for p in rows]
        return {name: Table(**{**t, "parts": parts(t["parts"])}) for name, t in found.items()}

    def newest(self) -> Version:
        known = self.committed()
        return Version(self, known[-1] if known else BASE - 1, self._load(known[-1]) if known else {})

    def begin(self, batch: int) -> Version:
        """A version under way, from the newest one before ``batch``."""
        before = [v for v in self.committed() if v < batch]
        if not before and batch > BASE:
            raise ValueError(f"{self.root} has no version before batch {batch} any more")
        return Version(self, batch, self._load(before[-1]) if before else {})

    def read(self, table: str) -> DataFrame:
        return self.newest().read(table)


@dataclass
class Version:
    store: Versions
    number: int
    tables: dict[str, Table]
    added: dict[str, Part | None] = field(default_factory=dict)

    # --- reading ---------------------------------------------------------------------------------

    def paths(self, parts: Iterable[Part], buckets: Sequence[int] | None = None) -> list[str]:
        out = []
        for part in parts:
            wanted = part.buckets if buckets is None else tuple(b for b in part.buckets if b in set(buckets))
            folder = f"{self.store.root}/data/{part.folder}"
            out += [folder] if wanted == part.buckets and wanted else [f"{folder}/bucket={b}" for b in wanted]
        return out

    def _rows(self, table: Table, paths: list[str]) -> DataFrame:
        spark, schema = self.store.spark, StructType.fromJson(json.loads(table.schema))
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows that were there before this version, with ``batch_id``; those of some buckets only."""
        table = self.tables[name]
        return self._rows(table, self.paths([p for p in table.parts if p is not self.added.get(name)], buckets))

    def own(self, name: str) -> DataFrame:
        """The rows that this version added, without ``batch_id``."""
        part = self.added.get(name)
        return self._rows(self.tables[name], self.paths([part] if part else [])).drop("batch_id")

    def current(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest row per key."""
        return last_per_key(self.read(name, buckets), [self.tables[name].by], ["batch_id"]).drop("batch_id")

    def bucket(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.store.buckets)).cast("int")

    # --- writing ---------------------------------------------------------------------------------

    def _put(self, rows: DataFrame, name: str, table: Table, first: int, last: int, tier: int) -> Part | None:
        folder = f"{name}/{last}-{uuid.uuid4().hex}"
        # one hot bucket may be split over several files, small buckets share tasks
        sized = rows.withColumn("bucket", self.bucket(table.by)).hint("rebalance", "bucket")
        sized.write.partitionBy("bucket").parquet(f"{self.store.root}/data/{folder}")
        names = self.store.files.names(f"data/{folder}")
        buckets = tuple(sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")))
        if not buckets:
            return None
        part = Part(folder, first, last, tier, buckets)
        return self._with_filter(part, table) if table.filtered else part

    def write(self, rows: DataFrame, name: str, by: str = "customer_id", newest: bool = False, filtered: bool = False) -> DataFrame:
        """Adds ``rows`` to a table of the version under way; returns them as they were stored."""
        rows = rows.withColumn("batch_id", F.lit(self.number))
        table = self.tables.setdefault(name, Table(rows.schema.json(), by, newest, filtered))
        part = self._put(rows, name, table, self.number, self.number, 0 if self.number > BASE else 99)
        if name in self.added and self.added[name]:
            raise ValueError(f"version {self.number} has written {name} already")
        self.added[name] = part
        if part:
            table.parts.append(part)
        return self.own(name)

    def _merge(self, name: str, table: Table) -> None:
        tier = 0
        while len(same := [p for p in table.parts if p.tier == tier]) >= self.store.fan:
            rows = self._rows(table, self.paths(same))
            if table.newest:
                rows = last_per_key(rows, [table.by], ["batch_id"])
            first, last = min(p.first for p in same), max(p.last for p in same)
            merged = self._put(rows, name, table, first, last, tier + 1)
            table.parts = [p for p in table.parts if p not in same] + [merged]
            tier += 1

    def commit(self, transient: Sequence[str] = ()) -> None:
        """Merges parts, puts the list in place and deletes what no kept version names. ``transient`` tables end here."""
        for name in transient:
            self.tables.pop(name, None)
        for name, table in self.tables.items():
            self._merge(name, table)
        store = self.store
        text = json.dumps({name: asdict(table) for name, table in self.tables.items()})
        store.files.put(f"versions/{self.number + 1:012d}.json", text)
        known = store.committed()
        for version in known[: -store.keep]:
            store.files.remove(f"versions/{version + 1:012d}.json")
        lists = [store._load(v) for v in known[-store.keep :]]
        named = {p.folder for tables in lists for t in tables.values() for p in t.parts}
        for table in store.files.names("data"):
            for folder in store.files.names(f"data/{table}"):
                if f"{table}/{folder.removesuffix('-filter')}" not in named:
                    store.files.remove(f"data/{table}/{folder}")
        self.added = {}

    # --- filters ---------------------------------------------------------------------------------

    def _with_filter(self, part: Part, table: Table) -> Part:
        keys = self._rows(table, self.paths([part])).select(table.by)
        blocks = 1 << max(0, math.ceil(math.log2(max(1, keys.count()) / KEYS_PER_BLOCK)))
        words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _place(table.by, i))).alias(f"w{i}") for i in range(WORDS)]
        rows = keys.groupBy(_block(table.by, F.lit(blocks)).alias("block")).agg(*words)
        rows.sortWithinPartitions("block").write.parquet(f"{self.store.root}/data/{part.folder}-filter")
        return replace(part, blocks=blocks)

    def unseen(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` whose key isn't in the table as it was before this version.

        Keys meet the blocks of every part's filter. Of the answers, one row per part and bucket tells what to read.
        """
        table = self.tables[name]
        parts = [p for p in table.parts if p is not self.added.get(name)]
        if not parts:
            return rows
        key, spark = table.by, self.store.spark
        schema = ", ".join(["block bigint", *(f"w{i} bigint" for i in range(WORDS))])
        read = lambda i, p: spark.read.schema(schema).parquet(f"{self.store.root}/data/{p.folder}-filter").withColumn("part", F.lit(i))
        filters = reduce(DataFrame.unionByName, [read(i, p) for i, p in enumerate(parts)])
        sizes = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(p.blocks).alias("blocks")) for i, p in enumerate(parts)])
        asked = rows.select(key).distinct().select(key, F.inline(sizes)).withColumn("block", _block(key, F.col("blocks")))
        yes = reduce(Column.__and__, [F.bit_get(F.col(f"w{i}"), _place(key, i)) == 1 for i in range(WORDS)])
        perhaps = asked.join(filters, ["part", "block"]).where(yes).select(self.bucket(key).alias("bucket"), "part").distinct()
        found: dict[int, list[int]] = {}
        for row in perhaps.collect():  # at most parts x buckets rows
            found.setdefault(row["part"], []).append(row["bucket"])
        paths = [path for i, buckets in found.items() for path in self.paths([parts[i]], buckets)]
        if not paths:
            return rows
        return rows.join(self._rows(table, paths).select(key), key, "left_anti")


def _block(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(key)), blocks)


def _place(key: str, word: int) -> Column:
    """The bit of a key in a word of its block."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit("bits"), F.col(key)), 6 * word), F.lit(64)).cast("int")
