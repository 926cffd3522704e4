"""Raw sources to the JSON layer: keys, tenant, payload and ingestion time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TENANT = "home_credit"  # fixed value: institution and source system unless given


def _constant(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _prefixed(prefix: str, key: str) -> Column:
    # NULL key gives a NULL id, which the next layer filters out
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def envelope(
    source: DataFrame,
    record_source: str,
    ingested_on: date,
    institution: Column | str = DEFAULT_TENANT,
    source_system: Column | str = DEFAULT_TENANT,
    customer_key: str = "SK_ID_CURR",
    **ids: Column,
) -> DataFrame:
    """Wrap every row of ``source`` as JSON beside its keys, tenant and ingestion time."""
    return source.select(
        _constant(source_system).alias("source_system"),
        _constant(institution).alias("institution_id"),
        F.col(customer_key).cast("long").alias("customer_id"),
        *[column.alias(name) for name, column in ids.items()],
        F.lit(record_source).alias("record_source"),
        F.to_json(F.struct(*source.columns)).alias("raw_json"),
        F.lit(ingested_on).cast("timestamp").alias("ingestion_timestamp"),
    )


def customers(application: DataFrame, ingested_on: date, **tenant) -> DataFrame:
    return envelope(application, "application_train", ingested_on, **tenant)


def loans(
    application: DataFrame, previous: DataFrame, bureau: DataFrame, ingested_on: date, **tenant
) -> DataFrame:
    sources = [
        (application, "application_train", _prefixed("APP_", "SK_ID_CURR")),
        (previous, "previous_application", _prefixed("PREV_", "SK_ID_PREV")),
        (bureau, "bureau", _prefixed("BUR_", "SK_ID_BUREAU")),
    ]
    parts = [envelope(df, name, ingested_on, loan_id=loan_id, **tenant) for df, name, loan_id in sources]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def loan_payments(installments: DataFrame, ingested_on: date, **tenant) -> DataFrame:
    parts = ["SK_ID_PREV", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER"]
    # concat_ws skips NULL parts, so ids without a version may collide; the next layer keeps one row
    payment_id = F.concat_ws("_", F.lit("PAY"), *[F.col(c).cast("string") for c in parts])
    return envelope(
        installments,
        "installments_payments",
        ingested_on,
        payment_id=payment_id,
        loan_id=_prefixed("PREV_", "SK_ID_PREV"),
        **tenant,
    )


def bureau_owners(bureau_balance: DataFrame, bureau: DataFrame) -> DataFrame:
    """Monthly bureau rows with their customer; rows of an unknown bureau record keep NULL."""
    owners = bureau.select(
        F.col("SK_ID_BUREAU").cast("long").alias("SK_ID_BUREAU"),
        F.col("SK_ID_CURR").cast("long").alias("SK_ID_CURR"),
    )
    return bureau_balance.join(owners, "SK_ID_BUREAU", "left")


def account_balances(
    credit_card: DataFrame,
    pos_cash: DataFrame,
    bureau_balance: DataFrame,
    bureau: DataFrame,
    ingested_on: date,
    **tenant,
) -> DataFrame:
    sources = [
        (credit_card, "credit_card_balance", _prefixed("CC_", "SK_ID_PREV")),
        (pos_cash, "POS_CASH_balance", _prefixed("POS_", "SK_ID_PREV")),
        (bureau_owners(bureau_balance, bureau), "bureau_balance", _prefixed("BUR_", "SK_ID_BUREAU")),
    ]
    parts = [envelope(df, name, ingested_on, account_id=key, **tenant) for df, name, key in sources]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
