"""Live refresh: every micro-batch of events updates the touched customers.

All tables belong to one store of versions (``versions.py``): a batch reads the version before it, adds parts of its own and
commits them together, so a batch that dies or is repeated gives the same tables. The row of the newest batch is the
current one. Tables are split into hash buckets, and a batch reads only the buckets it touches; choose their number by the
size of the tables. Parts are merged as they grow in number, so the work of a batch doesn't grow with the batches before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from creditloom.functions.scoring import ScoringConfig
from creditloom.operators import state as states
from creditloom.operators.events import (
    event_raw_json,
    event_transactions,
    known_customers,
    normalize_events,
    rejection,
)
from creditloom.operators.history import history_additions
from creditloom.operators.keyed import first_per_key
from creditloom.operators.scores import score_customers
from creditloom.operators.serving import SCORE_COLUMNS
from creditloom.schemas import FEATURE_COLUMNS
from creditloom.streaming.versions import BASE, Files, Version, Versions

FEATURE_ROW = ["customer_id", "institution_id", "source_system", *FEATURE_COLUMNS]


@dataclass(frozen=True)
class LiveRefresh:
    spark: SparkSession
    root: str
    raw_probability: Column
    config: ScoringConfig
    buckets: int = 16
    fan: int = 8

    # --- tables ----------------------------------------------------------------------------------

    @property
    def store(self) -> Versions:
        return Versions(self.spark, self.root, self.buckets, self.fan)

    def read(self, table: str) -> DataFrame:
        """All rows of the newest version, with ``batch_id``; of customers' current values at least the newest."""
        return self.store.read(table)

    def current(self, table: str) -> DataFrame:
        """The newest row per customer."""
        return self.store.newest().current(table)

    # --- life cycle ------------------------------------------------------------------------------

    def prepare(
        self,
        profiles: DataFrame,
        loans: DataFrame,
        transactions: DataFrame,
        features: DataFrame,
        scores: DataFrame,
        history: DataFrame,
    ) -> LiveRefresh:
        """Write what the stream starts from: the measures of the stored history, scores and history."""
        version = self.store.begin(BASE)
        version.write(known_customers(profiles, scores), "customers")
        stored_ids = transactions.select("transaction_id").where("transaction_id is not null")
        version.write(stored_ids, "ids", by="transaction_id", filtered=True)
        version.write(states.base_state(profiles, loans, transactions), "state", newest=True)
        version.write(states.known_accounts(transactions), "accounts")
        version.write(features.select(*FEATURE_ROW), "features", newest=True)
        version.write(scores.select(*SCORE_COLUMNS), "scores", newest=True)
        version.write(history.select("customer_id").distinct(), "with_history")
        past = history.withColumn("transaction_id", F.lit(None).cast("string"))
        version.write(past.select("customer_id", "credit_score", "default_probability", "risk_level",
                                  "score_generated_at", "source", "transaction_id"), "history")
        version.commit()
        return self

    def apply(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch: store the events, then refresh features, scores and history, all in one version.

        The micro-batch itself is read once. An event counts if its id is neither stored by an earlier batch nor repeated
        in this one; late events are like any other. Without an id, a known type, an amount and a known customer it is
        rejected. Of an id that comes both valid and invalid a valid event counts, in whatever batches they come.
        """
        version = self.store.begin(batch_id)
        known = version.read("customers").drop("batch_id")
        normalized = normalize_events(events, F.to_date("event_time"))
        raw = normalized.withColumn("raw_json", event_raw_json()).drop("raw_attributes")
        reason = rejection(F.col("institution_id").isNotNull())
        flagged = raw.join(known, "customer_id", "left").withColumn("reason", reason)
        # what follows reads the stored events, not the stream
        arrived = version.write(flagged, "arrived", by="transaction_id")
        order = [F.col(c).asc_nulls_first() for c in raw.columns if c != "transaction_id"]
        named = arrived.where("transaction_id IS NOT NULL")
        once = first_per_key(named, ["transaction_id"], [F.col("reason").isNotNull(), *order])
        accepted = version.unseen(once.where("reason is null"), "ids").drop("reason")
        stored = version.write(accepted, "bronze_events")
        version.write(stored.select("transaction_id"), "ids", by="transaction_id", filtered=True)
        added = version.write(
            event_transactions(stored.drop("institution_id", "source_system"), known), "transactions"
        )
        refused = once.where("reason is not null").unionByName(arrived.where("transaction_id IS NULL"))
        version.write(refused.select("transaction_id", "customer_id", "event_time", "reason"), "rejected_events")
        if version.added["transactions"]:
            self._refresh(version, added)
        version.commit(transient=["arrived"])

    def _refresh(self, version: Version, added: DataFrame) -> None:
        customers = added.select("customer_id").distinct()
        buckets = version.added["transactions"].buckets

        def touched(rows: DataFrame) -> DataFrame:
            return rows.join(customers, "customer_id", "left_semi")

        accounts = touched(version.read("accounts", buckets)).drop("batch_id")
        before = touched(version.current("scores", buckets))
        past = touched(version.read("with_history", buckets)).select("customer_id")
        state = touched(version.current("state", buckets))
        trail = version.write(states.trail_measures(added, state, accounts), "trail")

        features = states.trail_features(trail)
        version.write(states.last_of_trail(trail).select(*states.MEASURES), "state", newest=True)
        new_accounts = states.known_accounts(added).join(accounts, ["customer_id", "reference_id"], "left_anti")
        version.write(new_accounts, "accounts")
        version.write(states.last_of_trail(features).select(*FEATURE_ROW), "features", newest=True)

        simulated = self._scored(features)
        last = states.last_of_trail(simulated)
        version.write(last.select(*SCORE_COLUMNS), "scores", newest=True)
        version.write(score_changes(before, last), "score_changes")
        version.write(history_additions(past, before, simulated), "history")
        version.write(customers.join(past, "customer_id", "left_anti"), "with_history")

    def _scored(self, features: DataFrame) -> DataFrame:
        extra = ["transaction_id", "event_time"]
        return score_customers(features, self.raw_probability, self.config, F.col("event_time"), extra)

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run the refresh on a stream; by default until all available events are done.

        The checkpoint has to be the one that wrote the batches under this root: another one would number its
        batches from 0 again and replace stored ones.
        """
        names = Files(self.spark, checkpoint).names("commits")
        committed = max((int(n) for n in names if n.isdigit()), default=BASE)
        stored = self.store.newest().number
        if stored > committed + 1:
            raise ValueError(f"{self.root} holds batch {stored}, but {checkpoint} ends with batch {committed}")
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def score_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Previous and new score of the customers in ``after``."""
    previous = before.select(
        "customer_id",
        F.col("credit_score").alias("previous_credit_score"),
        F.col("default_probability").alias("previous_default_probability"),
    )
    return after.join(previous, "customer_id", "left").select(
        "customer_id",
        "previous_credit_score",
        F.col("credit_score").alias("new_credit_score"),
        (F.col("credit_score") - F.col("previous_credit_score")).alias("score_change"),
        "previous_default_probability",
        F.col("default_probability").alias("new_default_probability"),
        "risk_level",
    )
