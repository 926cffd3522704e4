"""Growing the score history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = [
    "customer_id", "credit_score", "default_probability", "risk_level", "score_generated_at", "source",
    "transaction_id",
]


def history_additions(known: DataFrame, current: DataFrame, simulated: DataFrame) -> DataFrame:
    """Rows to append for newly simulated scores.

    ``known`` holds the customers that have history already. A customer without any first gets the
    score from before the events as INITIAL; every simulated score follows as SIMULATION.
    """
    touched = simulated.select("customer_id").distinct()
    starting = current.join(touched, "customer_id", "left_semi").join(
        known.select("customer_id"), "customer_id", "left_anti"
    )
    initial = starting.withColumn("source", F.lit("INITIAL")).withColumn("transaction_id", F.lit(None).cast("string"))
    added = simulated.withColumn("source", F.lit("SIMULATION"))
    return initial.select(*COLUMNS).unionByName(added.select(*COLUMNS))
