"""Queries on events: normalization, what-if, feature trail, and the tables a stream maintains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import events, history, state
from creditloom.operators.keyed import upsert
from creditloom.operators.scores import score_customers
from creditloom.plans.lake import CONFIG, Lake, model_probability
from creditloom.plans.registry import query
from creditloom.session import fresh_path
from creditloom.streaming.source import EachOnce, event_stream
from creditloom.streaming.versions import Versions

LATE_BATCHES = 8

_EVENT_COLUMNS = [
    "transaction_id", "customer_id", "transaction_type", "transaction_date", "amount", "expected_amount",
    "delta_amount", "status", "reference_id", "days_past_due",
]
_EVENT_SQL = """transaction_id, customer_id, transaction_type, transaction_date, amount, expected_amount,
    amount - expected_amount AS delta_amount, status, reference_id, days_past_due"""


def _rounded(df: DataFrame) -> DataFrame:
    for name, digits in (("default_probability", 9), ("account_stability", 4)):
        if name in df.columns:
            df = df.withColumn(name, F.round(name, digits))
    return df


@query("SELECT * FROM online_features")
def customer_credit_features_online(lake: Lake) -> DataFrame:
    return _rounded(lake.online_features().drop("created_at"))


@query(f"SELECT {_EVENT_SQL} FROM known_events")
def normalize_event(lake: Lake) -> DataFrame:
    return lake.normalized_events().select(*_EVENT_COLUMNS)


@query(
    """SELECT transaction_id,
       CASE WHEN transaction_type = 'LOAN_PAYMENT' THEN 'simulated_installments_payments'
            ELSE 'simulated_credit_balance' END AS record_source,
       amount, given_expected AS expected_amount, CAST(given_days AS INTEGER) AS days_past_due,
       CASE WHEN event_id % 17 = 0 THEN 'NOTED' ELSE status END AS status,
       CAST(transaction_date AS VARCHAR) AS transaction_date,
       CASE WHEN event_id % 2 = 0 OR event_id % 17 = 0 THEN event_type END AS channel
       FROM known_events"""
)
def event_raw_json(lake: Lake) -> DataFrame:
    payload = lake.normalized_events().select("transaction_id", events.event_raw_json().alias("raw"))

    def read(*names: str):
        return F.coalesce(*[F.get_json_object("raw", f"$.{name}") for name in names])

    return payload.select(
        "transaction_id",
        read("RECORD_SOURCE").alias("record_source"),
        read("AMT_PAYMENT", "AMT_BALANCE").cast("double").alias("amount"),
        read("AMT_INSTALMENT", "AMT_CREDIT_LIMIT_ACTUAL").cast("double").alias("expected_amount"),
        read("DAYS_PAST_DUE", "SK_DPD").cast("int").alias("days_past_due"),
        read("STATUS").alias("status"),
        read("SIM_TRANSACTION_DATE").alias("transaction_date"),
        read("CHANNEL").alias("channel"),
    )


@query(f"SELECT institution_id, source_system, {_EVENT_SQL} FROM accepted_events")
def event_to_transaction(lake: Lake) -> DataFrame:
    return lake.event_transactions().drop("event_time")


@query(
    """SELECT CASE WHEN event_id % 17 <> 0 THEN transaction_id END AS transaction_id, customer_id,
           CASE WHEN event_id % 17 = 0 THEN 'no id' WHEN event_id % 13 = 0 THEN 'unknown type'
           WHEN event_id % 11 = 0 THEN 'no amount' WHEN event_id % 7 = 0 THEN 'amount out of range'
           ELSE 'unknown customer' END AS reason
       FROM known_events WHERE event_id % 17 = 0 OR event_id % 13 = 0 OR event_id % 11 = 0 OR event_id % 7 = 0
          OR customer_id NOT IN (SELECT customer_id FROM profile)"""
)
def rejected_events(lake: Lake) -> DataFrame:
    number = F.split("transaction_id", "::")[1].cast("long")
    sizes = F.when(number % 2 == 0, float("inf")).otherwise(-1e31)
    odd = lake.normalized_events().withColumns(
        {
            "transaction_type": F.when(number % 13 == 0, "REFUND").otherwise(F.col("transaction_type")),
            "amount": F.when(number % 11 != 0, F.when(number % 7 == 0, sizes).otherwise(F.col("amount"))),
            "transaction_id": F.when(number % 17 != 0, F.col("transaction_id")),
        }
    )
    return events.rejected_events(odd, lake.known()).drop("event_time")


@query(
    """SELECT e.transaction_id AS scenario_id, e.customer_id, e.transaction_type, e.status, e.expected_amount,
       e.transaction_date, c.credit_score AS previous_credit_score, w.credit_score AS projected_credit_score,
       w.credit_score - c.credit_score AS score_change, round(w.p, 9) AS projected_default_probability, w.risk_level
       FROM accepted_events e JOIN what_if_scores w ON w.scenario_id = e.transaction_id
       JOIN current_scores c ON c.customer_id = e.customer_id"""
)
def what_if_scores(lake: Lake) -> DataFrame:
    scenarios = lake.normalized_events().withColumnRenamed("transaction_id", "scenario_id")
    features = state.what_if_features(scenarios, lake.bucketed("state"), lake.bucketed("accounts"), lake.as_of)
    asked = ["scenario_id", "transaction_type", "status", "expected_amount", "transaction_date"]
    projected = score_customers(features, model_probability(), CONFIG, F.col("created_at"), asked)
    previous = lake.table("scores").select("customer_id", F.col("credit_score").alias("previous_credit_score"))
    return projected.join(previous, "customer_id").select(
        *asked,
        "customer_id",
        "previous_credit_score",
        F.col("credit_score").alias("projected_credit_score"),
        (F.col("credit_score") - F.col("previous_credit_score")).alias("score_change"),
        F.round("default_probability", 9).alias("projected_default_probability"),
        "risk_level",
    )


@query("SELECT * EXCLUDE (event_time) FROM trail_features")
def feature_trail(lake: Lake) -> DataFrame:
    return _rounded(state.trail_features(lake.trail()).drop("event_time"))


@query(
    """SELECT o.customer_id, o.total_accounts, o.avg_balance FROM online_features o
       UNION ALL SELECT customer_id, total_accounts, avg_balance FROM gold_features
       WHERE customer_id NOT IN (SELECT customer_id FROM online_features)"""
)
def upsert_by_key(lake: Lake) -> DataFrame:
    columns = ["customer_id", "total_accounts", "avg_balance"]
    new = lake.table("online_features").select(*columns)  # publishes the layers that the other one reads
    return upsert(lake.table("features").select(*columns), new, ["customer_id"])


_NEW_HISTORY = """SELECT customer_id, credit_score, risk_level, round(default_probability, 9) AS default_probability,
       score_generated_at, 'INITIAL' AS source FROM current_scores
       WHERE customer_id IN (SELECT customer_id FROM trail_last)
         AND customer_id NOT IN (SELECT customer_id FROM score_history)
       UNION ALL SELECT customer_id, credit_score, risk_level, round(p, 9), event_time, 'SIMULATION' FROM trail_scores"""


@query(_NEW_HISTORY)
def append_score_history(lake: Lake) -> DataFrame:
    features = state.trail_features(lake.trail())
    simulated = score_customers(
        features, model_probability(), CONFIG, F.col("event_time"), ["transaction_id"]
    )
    known = lake.table("score_history").select("customer_id").distinct()
    return _rounded(history.history_additions(known, lake.table("scores"), simulated)).drop("transaction_id")


# --- streams: run to the end of the available events, then compared with the batch result ----------


@query("SELECT transaction_id, customer_id, amount, event_time FROM raw_events")
def stream_source(lake: Lake) -> DataFrame:
    path, checkpoint = fresh_path(lake.spark, "stream"), fresh_path(lake.spark, "stream-checkpoint")
    stream = event_stream(lake.spark, lake.sf_dir).drop("raw_attributes")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return lake.spark.read.parquet(path).select("transaction_id", "customer_id", "amount", "event_time")


@query("SELECT transaction_id, customer_id FROM raw_events")
def stream_dedup(lake: Lake) -> DataFrame:
    once = EachOnce(Versions(lake.spark, fresh_path(lake.spark, "dedup")))
    stream = event_stream(lake.spark, lake.sf_dir).drop("raw_attributes")
    twice = stream.unionByName(stream)  # every event arrives twice
    once.start(twice, fresh_path(lake.spark, "dedup-checkpoint")).awaitTermination()
    return once.read().select("transaction_id", "customer_id")


@query("SELECT transaction_id, customer_id, amount, event_time FROM raw_events")
def stream_late(lake: Lake) -> DataFrame:
    """Events in four lots by time, newest first, then every third event again, in at most ``LATE_BATCHES`` batches.

    Every batch looks its ids up in those stored before, so their number must not grow with the table.
    """
    folder, source = fresh_path(lake.spark, "late"), lake.spark.read.parquet(f"{lake.sf_dir}/events.parquet")
    time = F.col("ts").cast("timestamp").cast("double")
    cuts = source.agg(F.percentile_approx(time, [0.75, 0.5, 0.25])).first()[0] or [0.0] * 3
    upper = [None, *cuts]
    for above, below in zip([*cuts, None], upper, strict=True):
        rows = source if above is None else source.where(time > above)
        (rows if below is None else rows.where(time <= below)).hint("rebalance").write.mode("append").parquet(folder)
    source.where("event_id % 3 = 0").hint("rebalance").write.mode("append").parquet(folder)
    once = EachOnce(Versions(lake.spark, fresh_path(lake.spark, "late-out")))
    files = len(lake.spark.read.parquet(folder).inputFiles())
    stream = event_stream(lake.spark, folder, "*.parquet", max_files=math.ceil(files / LATE_BATCHES)).drop("raw_attributes")
    once.start(stream, fresh_path(lake.spark, "late-checkpoint")).awaitTermination()
    return once.read().select("transaction_id", "customer_id", "amount", "event_time")


@query(f"SELECT institution_id, source_system, {_EVENT_SQL} FROM accepted_events")
def stream_append(lake: Lake) -> DataFrame:
    return lake.live().read("transactions").drop("batch_id", "event_time")


@query(
    """SELECT * EXCLUDE (event_time, transaction_id) FROM trail_features
       QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, transaction_id DESC) = 1"""
)
def refresh_features(lake: Lake) -> DataFrame:
    live = lake.live()
    return _rounded(live.current("features").join(live.read("trail"), "customer_id", "left_semi"))


@query(
    """SELECT t.customer_id, c.credit_score AS previous_credit_score, t.credit_score AS new_credit_score,
       t.credit_score - c.credit_score AS score_change, t.risk_level
       FROM trail_last t JOIN current_scores c ON c.customer_id = t.customer_id"""
)
def refresh_scores(lake: Lake) -> DataFrame:
    changes = lake.live().current("score_changes")
    return changes.select(
        "customer_id", "previous_credit_score", "new_credit_score", "score_change", "risk_level"
    )


@query(
    f"""SELECT customer_id, credit_score, risk_level, round(default_probability, 9) AS default_probability,
        score_generated_at, source FROM score_history UNION ALL {_NEW_HISTORY}"""
)
def stream_score_history(lake: Lake) -> DataFrame:
    return _rounded(lake.live().read("history").drop("batch_id", "transaction_id"))
