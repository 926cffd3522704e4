"""Transaction events as a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from creditloom.operators.keyed import first_per_key
from creditloom.schemas import RAW_EVENTS
from creditloom.sources.standin import as_transaction_events
from creditloom.streaming.versions import BASE, Versions


def event_stream(
    spark: SparkSession, folder: str, glob: str = "events.parquet", max_files: int | None = None
) -> DataFrame:
    """Transaction events from parquet files that appear in ``folder``."""
    reader = spark.readStream.schema(RAW_EVENTS).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_transaction_events(reader.parquet(folder))


@dataclass(frozen=True)
class EachOnce:
    """Stores every event of a stream once, however late it comes.

    No id is held in memory or in the state of the stream: ids are looked up in the stored ones, behind filters that keep
    most of them from being read. Of an id that a batch holds several times the smallest row counts. Events without an id
    can't be told apart; they are kept in a table of their own, ``without_id``.
    """

    store: Versions
    key: str = "transaction_id"

    def apply(self, events: DataFrame, batch_id: int) -> None:
        if not self.store.committed():
            self.store.begin(BASE).commit()
        version = self.store.begin(batch_id)
        # the micro-batch is read once
        arrived = version.write(events, "arrived", by=self.key)
        once = first_per_key(arrived.where(f"{self.key} IS NOT NULL"), [self.key])
        fresh = version.unseen(once, "ids") if "ids" in version.tables else once
        stored = version.write(fresh, "events", by=self.key)
        version.write(stored.select(self.key), "ids", by=self.key, filtered=True)
        version.write(arrived.where(f"{self.key} IS NULL"), "without_id", by=self.key)
        version.commit(transient=["arrived"])

    def read(self, table: str = "events") -> DataFrame:
        return self.store.read(table).drop("batch_id")

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
