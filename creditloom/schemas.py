"""Table schemas of the raw files and of the layers, as DDL text."""

# Raw files: only the columns that later steps read.
RAW = {
    "application_train": (
        "SK_ID_CURR long, TARGET int, CODE_GENDER string, NAME_INCOME_TYPE string,"
        " NAME_EDUCATION_TYPE string, NAME_HOUSING_TYPE string, NAME_CONTRACT_TYPE string,"
        " DAYS_BIRTH int, DAYS_REGISTRATION double, AMT_INCOME_TOTAL double, AMT_CREDIT double"
    ),
    "previous_application": (
        "SK_ID_PREV long, SK_ID_CURR long, NAME_CONTRACT_TYPE string, NAME_CONTRACT_STATUS string,"
        " AMT_CREDIT double, AMT_APPLICATION double, DAYS_DECISION int, DAYS_LAST_DUE double"
    ),
    "bureau": (
        "SK_ID_BUREAU long, SK_ID_CURR long, CREDIT_TYPE string, CREDIT_ACTIVE string,"
        " AMT_CREDIT_SUM double, DAYS_CREDIT int, DAYS_CREDIT_ENDDATE double, CREDIT_DAY_OVERDUE int"
    ),
    "bureau_balance": ("SK_ID_BUREAU long, MONTHS_BALANCE int, STATUS string"),
    "installments_payments": (
        "SK_ID_PREV long, SK_ID_CURR long, NUM_INSTALMENT_VERSION int, NUM_INSTALMENT_NUMBER int,"
        " AMT_INSTALMENT double, AMT_PAYMENT double, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT double"
    ),
    "credit_card_balance": (
        "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double,"
        " AMT_CREDIT_LIMIT_ACTUAL double, SK_DPD int, SK_DPD_DEF int"
    ),
    "POS_CASH_balance": (
        "SK_ID_PREV long, SK_ID_CURR long, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int"
    ),
}

# One transaction table for payments, balance snapshots and live events.
TRANSACTIONS = (
    "transaction_id string, customer_id long, institution_id string, source_system string,"
    " transaction_type string, transaction_date date, amount double, expected_amount double,"
    " delta_amount double, status string, reference_id string, days_past_due int, created_at timestamp"
)

SCORES = (
    "customer_id long, institution_id string, source_system string, credit_score int,"
    " default_probability double, risk_level string, score_generated_at timestamp"
)

SCORE_HISTORY = (
    "history_id long, customer_id long, credit_score int, default_probability double,"
    " risk_level string, score_generated_at timestamp, source string"
)

# Events as they arrive on the test stream.
RAW_EVENTS = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)

# The model's feature names, in the model's order.
FEATURE_COLUMNS = [
    "total_accounts",
    "account_age_days",
    "avg_balance",
    "max_balance",
    "min_balance",
    "total_loans",
    "active_loans",
    "closed_loans",
    "total_payments",
    "late_payments",
    "late_payment_ratio",
    "max_days_past_due",
    "avg_days_past_due",
    "total_debt",
    "debt_to_income_ratio",
    "credit_utilization",
    "account_stability",
]
