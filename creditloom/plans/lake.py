"""The layers over one folder of test tables.

Layer methods compose lazily from the raw sources. ``table`` gives the same table after it was written
once for the session, the way serving reads published layers instead of parsing raw JSON again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.functions import scoring
from creditloom.operators import bronze, features, serving, silver, views
from creditloom.operators import state as states
from creditloom.operators.events import event_transactions, known_customers, normalize_events
from creditloom.operators.keyed import first_per_key
from creditloom.operators.scores import score_customers
from creditloom.operators.training import TrainedModel, fit_scoring
from creditloom.session import fresh_path
from creditloom.sources import standin
from creditloom.sources.files import write_bucketed, write_layer
from creditloom.streaming.live import LiveRefresh
from creditloom.streaming.source import event_stream

# A fixed logistic model for queries that SQL checks; trained models replace it in real runs.
MODEL_INTERCEPT = -0.5
MODEL_WEIGHTS = {
    "total_accounts": -0.05,
    "account_age_days": -0.0002,
    "active_loans": 0.04,
    "late_payment_ratio": 3.0,
    "max_days_past_due": 0.02,
    "debt_to_income_ratio": 0.01,
    "credit_utilization": 0.4,
}

CONFIG = scoring.PUBLISHED

_published: dict[tuple[str, str, str, str], str] = {}
_bucketed: dict[tuple[str, str, str, str], DataFrame] = {}
_trained: dict[tuple[str, str, str], TrainedModel] = {}
_live: dict[tuple[str, str, str], LiveRefresh] = {}


# Tables kept in buckets, and their keys.
BUCKETED = {
    "state": ["customer_id"],
    "accounts": ["customer_id", "reference_id"],
    "search_rows": ["customer_id"],
}


def model_probability() -> Column:
    return scoring.linear_probability(MODEL_WEIGHTS, MODEL_INTERCEPT)


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: date = standin.AS_OF) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self.as_of = as_of

    def raw(self, name: str) -> DataFrame:
        return standin.SOURCES[name](self.spark, self.sf_dir)

    def events(self) -> DataFrame:
        return standin.transaction_events(self.spark, self.sf_dir)

    # bronze -------------------------------------------------------------------------------------

    def bronze_customers(self) -> DataFrame:
        return bronze.customers(self.raw("application_train"), self.as_of, institution=F.col("TENANT"))

    def bronze_loans(self) -> DataFrame:
        sources = [self.raw(name) for name in ("application_train", "previous_application", "bureau")]
        return bronze.loans(*sources, self.as_of, institution="t0")

    def bronze_loan_payments(self) -> DataFrame:
        return bronze.loan_payments(self.raw("installments_payments"), self.as_of, institution="t0")

    def bronze_account_balances(self) -> DataFrame:
        names = ("credit_card_balance", "POS_CASH_balance", "bureau_balance", "bureau")
        return bronze.account_balances(*[self.raw(name) for name in names], self.as_of, institution="t0")

    # silver -------------------------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return silver.customers(self.bronze_customers(), self.as_of)

    def loans(self) -> DataFrame:
        return silver.loans(self.bronze_loans(), self.as_of)

    def loan_payments(self) -> DataFrame:
        return silver.loan_payments(self.bronze_loan_payments(), self.as_of)

    def account_balances(self) -> DataFrame:
        return silver.account_balances(self.bronze_account_balances(), self.as_of)

    def transactions(self) -> DataFrame:
        return silver.transactions(self.loan_payments(), self.account_balances())

    # gold ---------------------------------------------------------------------------------------

    def features(self) -> DataFrame:
        names = ("customers", "loans", "transactions")
        return features.customer_credit_features(*[self.held(name) for name in names], self.as_of, unique_ids=True)

    def online_features(self) -> DataFrame:
        return features.customer_credit_features(
            self.table("profile"),
            self.table("loans"),
            self.table("transactions"),
            self.as_of,
            mode="online",
            unique_ids=True,
        )

    def scores(self) -> DataFrame:
        return score_customers(
            self.table("features"), model_probability(), CONFIG, F.lit(self.as_of).cast("timestamp")
        )

    def score_history(self) -> DataFrame:
        return standin.score_history(
            self.spark,
            self.sf_dir,
            lambda p: scoring.credit_score(p, CONFIG),
            lambda p: scoring.risk_level(p, CONFIG),
        )

    def profile(self) -> DataFrame:
        return first_per_key(self.table("customers"), ["customer_id"])

    # models and live tables ---------------------------------------------------------------------

    def trained(self) -> TrainedModel:
        """A model fitted on this lake's features with the defaults of training, once per session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, str(self.as_of))
        if key not in _trained:
            _trained[key] = fit_scoring(self.table("features"))
        return _trained[key]

    def known(self) -> DataFrame:
        return known_customers(self.table("profile"), self.table("scores"))

    def normalized_events(self) -> DataFrame:
        return normalize_events(self.events(), F.lit(self.as_of))

    def event_transactions(self) -> DataFrame:
        return event_transactions(self.normalized_events(), self.known())

    def state(self) -> DataFrame:
        return states.base_state(self.table("profile"), self.table("loans"), self.table("transactions"))

    def accounts(self) -> DataFrame:
        return states.known_accounts(self.table("transactions"))

    def trail(self) -> DataFrame:
        # first what publishes the layers, so that the scores of known customers read them
        state, accounts = self.bucketed("state"), self.bucketed("accounts")
        return states.trail_measures(self.event_transactions(), state, accounts)

    def live(self) -> LiveRefresh:
        """The live tables after all events of this lake went through the stream, once per session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, str(self.as_of))
        if key not in _live:
            refresh = LiveRefresh(self.spark, fresh_path(self.spark, "live"), model_probability(), CONFIG)
            refresh.prepare(
                profiles=self.table("profile"),
                loans=self.table("loans"),
                transactions=self.table("transactions"),
                features=self.table("features"),
                scores=self.table("scores"),
                history=self.table("score_history"),
            )
            stream = event_stream(self.spark, self.sf_dir)
            refresh.start(stream, fresh_path(self.spark, "live-checkpoint")).awaitTermination()
            _live[key] = refresh
        return _live[key]

    # indexes ------------------------------------------------------------------------------------

    def recent(self) -> DataFrame:
        return serving.recent_transactions(self.table("transactions"))

    def pages_by_amount(self) -> DataFrame:
        return views.page_index(self.table("recent"), "amount", descending=False)

    def search_rows(self) -> DataFrame:
        return serving.search_rows(self.table("profile"), self.table("scores"), self.table("features"))

    def search_grams(self) -> DataFrame:
        return serving.search_grams(self.bucketed("search_rows"))

    # published ----------------------------------------------------------------------------------

    def _key(self, name: str) -> tuple[str, str, str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir, str(self.as_of), name

    def held(self, name: str) -> DataFrame:
        """The published table where there is one already; otherwise it is composed, as one use does not pay for writing it."""
        return self.table(name) if self._key(name) in _published else getattr(self, name)()

    def table(self, name: str) -> DataFrame:
        """A table of this lake, written on first use and read back as parquet."""
        key = self._key(name)
        if key not in _published:
            build: Callable[[], DataFrame] = getattr(self, name)
            root = fresh_path(self.spark, "lake")
            _published[key] = write_layer(build(), root, "published", name)
        return self.spark.read.parquet(_published[key])

    def bucketed(self, name: str) -> DataFrame:
        """A table of this lake in buckets by its key, for joins that leave it where it is."""
        key = self._key(name)
        if key not in _bucketed:
            build: Callable[[], DataFrame] = getattr(self, name)
            _bucketed[key] = write_bucketed(build(), fresh_path(self.spark, "lake"), name, BUCKETED[name])
        return _bucketed[key]
