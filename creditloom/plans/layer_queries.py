"""Queries on files, bronze, silver and gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.functions.numbers import exact_sum, safe_ratio
from creditloom.operators import bronze, features, silver
from creditloom.operators.keyed import duplicate_keys, first_per_key
from creditloom.plans.lake import Lake
from creditloom.plans.registry import query
from creditloom.schemas import FEATURE_COLUMNS, RAW
from creditloom.session import fresh_path
from creditloom.sources import files

def _fields(df: DataFrame, keys: list[str], **fields: str) -> DataFrame:
    """Keys and JSON fields read back, each with its type."""
    read = [
        F.get_json_object("raw_json", f"$.{name}").cast(kind).alias(name.lower()) for name, kind in fields.items()
    ]
    return df.select(*keys, *read)


# --- files ---------------------------------------------------------------------------------------


@query(
    """SELECT SK_ID_CURR, TARGET, CODE_GENDER, NAME_INCOME_TYPE, NAME_EDUCATION_TYPE, NAME_HOUSING_TYPE,
       NAME_CONTRACT_TYPE, DAYS_BIRTH, CAST(DAYS_REGISTRATION AS DOUBLE) AS DAYS_REGISTRATION,
       AMT_INCOME_TOTAL, AMT_CREDIT FROM raw_application"""
)
def scan_csv(lake: Lake) -> DataFrame:
    path = fresh_path(lake.spark, "application_train.csv")
    lake.raw("application_train").drop("TENANT").write.option("header", True).csv(path)
    return files.scan_csv(lake.spark, path, RAW["application_train"])


@query(
    """SELECT count(*) AS row_count, CAST(sum(SK_ID_PREV) AS BIGINT) AS ids,
       CAST(sum(NUM_INSTALMENT_NUMBER) AS BIGINT) AS numbers, CAST(sum(DAYS_INSTALMENT) AS BIGINT) AS days,
       CAST(sum(DAYS_ENTRY_PAYMENT) AS BIGINT) AS entry_days, round(sum(AMT_PAYMENT), 2) AS paid FROM raw_installments"""
)
def scan_csv_mixed(lake: Lake) -> DataFrame:
    """Whole numbers written as 1, 1.0, " 1 " and quoted, by turns."""
    source = lake.raw("installments_payments")
    turn = F.pmod(F.xxhash64("SK_ID_PREV", "NUM_INSTALMENT_NUMBER"), F.lit(3))
    whole = ["SK_ID_PREV", "SK_ID_CURR", "NUM_INSTALMENT_VERSION", "NUM_INSTALMENT_NUMBER", "DAYS_INSTALMENT"]

    def spelled(name: str):
        text = F.col(name).cast("string")
        odd = F.when(turn == 0, F.concat(text, F.lit(".0"))).when(turn == 1, F.concat(F.lit(" "), text, F.lit(" ")))
        return odd.otherwise(text)

    path = fresh_path(lake.spark, "installments.csv")
    mixed = source.select(*[spelled(c).alias(c) if c in whole else F.col(c).cast("string").alias(c) for c in source.columns])
    mixed.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    rows = files.scan_csv(lake.spark, path, RAW["installments_payments"])
    return rows.agg(
        F.count("SK_ID_CURR").alias("row_count"),
        F.sum("SK_ID_PREV").alias("ids"),
        F.sum("NUM_INSTALMENT_NUMBER").alias("numbers"),
        F.sum("DAYS_INSTALMENT").alias("days"),
        F.sum("DAYS_ENTRY_PAYMENT").cast("long").alias("entry_days"),
        F.round(exact_sum(F.col("AMT_PAYMENT")), 2).alias("paid"),
    )


@query("SELECT * FROM silver_loans")
def scan_layer(lake: Lake) -> DataFrame:
    root = fresh_path(lake.spark, "scan_layer")
    files.write_layer(lake.loans().drop("created_at"), root, "silver", "loans")
    return files.scan_layer(lake.spark, root, "silver", "loans")


@query(
    """SELECT transaction_id, customer_id, transaction_date, amount FROM silver_transactions
       WHERE transaction_type = 'BALANCE_SNAPSHOT' AND status = 'PAST_DUE'"""
)
def scan_projected(lake: Lake) -> DataFrame:
    return files.scan_projected(
        lake.table("transactions"),
        ["transaction_id", "customer_id", "transaction_date", "amount"],
        transaction_type="BALANCE_SNAPSHOT",
        status="PAST_DUE",
    )


@query(
    """SELECT customer_id, credit_score, risk_level, default_probability FROM score_history
       QUALIFY row_number() OVER (PARTITION BY customer_id
           ORDER BY score_generated_at DESC NULLS LAST, history_id DESC) = 1"""
)
def scan_last_wins_map(lake: Lake) -> DataFrame:
    columns = ["credit_score", "risk_level", "default_probability"]
    return files.scan_last_wins(
        lake.score_history(), "customer_id", columns, ["score_generated_at", "history_id"]
    )


@query("SELECT * FROM silver_customers")
def write_layer(lake: Lake) -> DataFrame:
    root = fresh_path(lake.spark, "write_layer")
    path = files.write_layer(lake.customers().drop("created_at"), root, "silver", "customers", max_files=8)
    return lake.spark.read.parquet(path)


# --- bronze --------------------------------------------------------------------------------------


@query(
    """SELECT 'home_credit' AS source_system, 't0' AS institution_id, SK_ID_CURR AS customer_id,
       'previous_application' AS record_source, TIMESTAMP '2024-02-01' AS ingestion_timestamp,
       AMT_CREDIT AS amt_credit, AMT_APPLICATION AS amt_application, DAYS_DECISION AS days_decision
       FROM raw_previous"""
)
def bronze_envelope(lake: Lake) -> DataFrame:
    df = bronze.envelope(
        lake.raw("previous_application"), "previous_application", lake.as_of, institution="t0"
    )
    return _fields(
        df,
        ["source_system", "institution_id", "customer_id", "record_source", "ingestion_timestamp"],
        AMT_CREDIT="double",
        AMT_APPLICATION="double",
        DAYS_DECISION="int",
    )


@query(
    """SELECT 'home_credit' AS source_system, TENANT AS institution_id, SK_ID_CURR AS customer_id,
       'application_train' AS record_source, TARGET AS target, CODE_GENDER AS code_gender,
       DAYS_BIRTH AS days_birth, AMT_INCOME_TOTAL AS amt_income_total FROM raw_application"""
)
def bronze_customers(lake: Lake) -> DataFrame:
    return _fields(
        lake.bronze_customers(),
        ["source_system", "institution_id", "customer_id", "record_source"],
        TARGET="int",
        CODE_GENDER="string",
        DAYS_BIRTH="int",
        AMT_INCOME_TOTAL="double",
    )


@query(
    """SELECT SK_ID_CURR AS customer_id, 'APP_' || SK_ID_CURR AS loan_id, 'application_train' AS record_source,
              AMT_CREDIT AS amt_credit, CAST(NULL AS DOUBLE) AS amt_credit_sum FROM raw_application
       UNION ALL SELECT SK_ID_CURR, 'PREV_' || SK_ID_PREV, 'previous_application', AMT_CREDIT, NULL
       FROM raw_previous
       UNION ALL SELECT SK_ID_CURR, 'BUR_' || SK_ID_BUREAU, 'bureau', NULL, AMT_CREDIT_SUM FROM raw_bureau"""
)
def bronze_loans(lake: Lake) -> DataFrame:
    return _fields(
        lake.bronze_loans(),
        ["customer_id", "loan_id", "record_source"],
        AMT_CREDIT="double",
        AMT_CREDIT_SUM="double",
    )


@query(
    """SELECT SK_ID_CURR AS customer_id, 'PREV_' || SK_ID_PREV AS loan_id,
       concat_ws('_', 'PAY', SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER) AS payment_id,
       AMT_PAYMENT AS amt_payment, CAST(DAYS_ENTRY_PAYMENT AS DOUBLE) AS days_entry_payment
       FROM raw_installments"""
)
def bronze_loan_payments(lake: Lake) -> DataFrame:
    return _fields(
        lake.bronze_loan_payments(),
        ["customer_id", "loan_id", "payment_id"],
        AMT_PAYMENT="double",
        DAYS_ENTRY_PAYMENT="double",
    )


@query("SELECT SK_ID_BUREAU, MONTHS_BALANCE, STATUS, SK_ID_CURR FROM raw_bureau_owned")
def bureau_owner_join(lake: Lake) -> DataFrame:
    return bronze.bureau_owners(lake.raw("bureau_balance"), lake.raw("bureau"))


@query(
    """SELECT SK_ID_CURR AS customer_id, 'CC_' || SK_ID_PREV AS account_id,
              'credit_card_balance' AS record_source, MONTHS_BALANCE AS months_balance,
              AMT_BALANCE AS amt_balance, CAST(NULL AS VARCHAR) AS status FROM raw_card
       UNION ALL SELECT SK_ID_CURR, 'POS_' || SK_ID_PREV, 'POS_CASH_balance', MONTHS_BALANCE, NULL, NULL
       FROM raw_pos
       UNION ALL SELECT SK_ID_CURR, 'BUR_' || SK_ID_BUREAU, 'bureau_balance', MONTHS_BALANCE, NULL, STATUS
       FROM raw_bureau_owned"""
)
def bronze_account_balances(lake: Lake) -> DataFrame:
    return _fields(
        lake.bronze_account_balances(),
        ["customer_id", "account_id", "record_source"],
        MONTHS_BALANCE="int",
        AMT_BALANCE="double",
        STATUS="string",
    )


# --- silver --------------------------------------------------------------------------------------


@query(
    """SELECT 'PREV_' || SK_ID_PREV AS loan_id, NAME_CONTRACT_STATUS AS name_contract_status,
       DAYS_LAST_DUE AS days_last_due, coalesce(AMT_CREDIT, AMT_APPLICATION) AS amount FROM raw_previous"""
)
def json_fields_layouts(lake: Lake) -> DataFrame:
    """The same payload compact, spaced and with its numbers quoted."""
    loans = lake.bronze_loans().where("record_source = 'previous_application'")
    turn = F.pmod(F.xxhash64("loan_id"), F.lit(3))
    spaced = F.regexp_replace("raw_json", r'":', '" : ')
    quoted = F.regexp_replace("raw_json", r'":(-?[0-9.E+-]+)', r'": "$1"')
    laid_out = loans.withColumn("raw_json", F.when(turn == 0, spaced).when(turn == 1, quoted).otherwise(F.col("raw_json")))
    parsed = silver.json_fields(laid_out, ("NAME_CONTRACT_STATUS",), ("DAYS_LAST_DUE",), ("AMT_CREDIT", "AMT_APPLICATION"))
    return parsed.select(
        "loan_id",
        F.col("NAME_CONTRACT_STATUS").alias("name_contract_status"),
        F.col("DAYS_LAST_DUE").alias("days_last_due"),
        F.coalesce("AMT_CREDIT", "AMT_APPLICATION").alias("amount"),
    )


@query(
    """SELECT 'PREV_' || SK_ID_PREV AS loan_id, NAME_CONTRACT_STATUS AS name_contract_status,
       DAYS_LAST_DUE AS days_last_due, coalesce(AMT_CREDIT, AMT_APPLICATION) AS amount FROM raw_previous"""
)
def json_fields(lake: Lake) -> DataFrame:
    loans = lake.bronze_loans().where("record_source = 'previous_application'")
    parsed = silver.json_fields(
        loans, ("NAME_CONTRACT_STATUS",), ("DAYS_LAST_DUE",), ("AMT_CREDIT", "AMT_APPLICATION")
    )
    return parsed.select(
        "loan_id",
        F.col("NAME_CONTRACT_STATUS").alias("name_contract_status"),
        F.col("DAYS_LAST_DUE").alias("days_last_due"),
        F.coalesce("AMT_CREDIT", "AMT_APPLICATION").alias("amount"),
    )


@query(
    """SELECT concat_ws('_', 'PAY', SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER) AS payment_id,
       DATE '2024-02-01' AS ingested_on, DATE '2023-06-30' AS configured FROM raw_installments"""
)
def anchor_date(lake: Lake) -> DataFrame:
    return lake.bronze_loan_payments().select(
        "payment_id", silver.anchor_date().alias("ingested_on"), silver.anchor_date("2023-06-30").alias("configured")
    )


@query("SELECT * FROM silver_customers")
def silver_customers(lake: Lake) -> DataFrame:
    return lake.customers().drop("created_at")


@query("SELECT * FROM silver_loans")
def silver_loans(lake: Lake) -> DataFrame:
    return lake.loans().drop("created_at")


@query("SELECT * FROM silver_payments")
def silver_loan_payments(lake: Lake) -> DataFrame:
    return lake.loan_payments().drop("created_at")


@query("SELECT * FROM silver_balances")
def silver_account_balances(lake: Lake) -> DataFrame:
    return lake.account_balances().drop("created_at")


@query("SELECT * FROM silver_transactions")
def silver_transactions(lake: Lake) -> DataFrame:
    return lake.transactions().drop("created_at")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
       WHERE l_orderkey IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST) = 1"""
)
def dedup_keyed(lake: Lake) -> DataFrame:
    lines = files.scan_table(lake.spark, lake.sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return first_per_key(lines.select(*columns), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT payment_id, count(*) AS row_count FROM payment_rows GROUP BY payment_id HAVING count(*) > 1"""
)
def duplicate_payment_ids(lake: Lake) -> DataFrame:
    return duplicate_keys(lake.bronze_loan_payments(), ["payment_id"])


@query(
    """SELECT account_id, customer_id, balance, credit_limit, days_past_due, snapshot_date FROM balance_rows
       WHERE coalesce(abs(balance), 0) > 0 OR coalesce(abs(credit_limit), 0) > 0 OR days_past_due > 0"""
)
def informative_balances(lake: Lake) -> DataFrame:
    snapshots = silver.account_snapshots(lake.bronze_account_balances(), lake.as_of)
    return silver.informative(snapshots).select(
        "account_id", "customer_id", "balance", "credit_limit", "days_past_due", "snapshot_date"
    )


# --- gold ----------------------------------------------------------------------------------------


@query("SELECT customer_id FROM customer_universe")
def customer_universe(lake: Lake) -> DataFrame:
    return features.customer_universe(lake.customers(), lake.loans(), lake.transactions())


@query("SELECT * FROM customer_meta")
def customer_meta(lake: Lake) -> DataFrame:
    return features.customer_meta(lake.customers())


@query("SELECT * FROM loan_agg")
def loan_agg(lake: Lake) -> DataFrame:
    return features.loan_aggregates(lake.loans())


@query("SELECT * FROM payment_agg")
def payment_agg(lake: Lake) -> DataFrame:
    return features.payment_aggregates(lake.transactions())


@query("SELECT * REPLACE (round(account_stability, 4) AS account_stability) FROM balance_agg")
def balance_agg(lake: Lake) -> DataFrame:
    df = features.balance_aggregates(lake.transactions(), lake.as_of)
    return df.withColumn("account_stability", F.round("account_stability", 4))


@query("SELECT * REPLACE (round(account_stability, 4) AS account_stability) FROM gold_features")
def customer_credit_features(lake: Lake) -> DataFrame:
    return lake.features().drop("created_at").withColumn("account_stability", F.round("account_stability", 4))


@query(
    "SELECT loan_id, loan_amount / nullif(days_past_due, 0) AS amount_per_day FROM silver_loans",
    name="safe_ratio",
)
def safe_ratio_query(lake: Lake) -> DataFrame:
    return lake.table("loans").select(
        "loan_id", safe_ratio(F.col("loan_amount"), F.col("days_past_due")).alias("amount_per_day")
    )


@query(
    """SELECT coalesce(l.customer_id, b.customer_id) AS customer_id,
       coalesce(greatest(loan_max_days_past_due, account_max_days_past_due), 0) AS max_days_past_due,
       (coalesce(loan_avg_days_past_due, 0) + coalesce(account_avg_days_past_due, 0))
         / CASE WHEN l.customer_id IS NOT NULL AND b.customer_id IS NOT NULL THEN 2 ELSE 1 END
         AS avg_days_past_due
       FROM loan_agg l FULL JOIN balance_agg b ON l.customer_id = b.customer_id"""
)
def combined_dpd(lake: Lake) -> DataFrame:
    loans = features.loan_aggregates(lake.table("loans"), unique_ids=True)
    balances = features.balance_aggregates(lake.table("transactions"), lake.as_of)
    both = loans.join(balances, "customer_id", "full")
    return both.select(
        "customer_id",
        features.combined_max_days_past_due(
            F.col("loan_max_days_past_due"), F.col("account_max_days_past_due")
        ).alias("max_days_past_due"),
        features.combined_avg_days_past_due(
            F.col("loan_avg_days_past_due"), F.col("account_avg_days_past_due")
        ).alias("avg_days_past_due"),
    )


_VECTOR = ", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURE_COLUMNS)
_NAMES = ", ".join(f"'{c}'" for c in FEATURE_COLUMNS)


@query(
    f"""SELECT customer_id, CAST(i - 1 AS INTEGER) AS position, [{_NAMES}][i] AS feature,
        CASE WHEN i = 17 THEN round(account_stability, 4) ELSE [{_VECTOR}][i] END AS value
        FROM gold_features, unnest(generate_series(1, 17)) AS s(i)"""
)
def feature_vector(lake: Lake) -> DataFrame:
    values = features.feature_values(lake.table("features"))
    spread = F.col("feature") == "account_stability"  # the only value that depends on summation order
    return values.withColumn("value", F.when(spread, F.round("value", 4)).otherwise(F.col("value")))
