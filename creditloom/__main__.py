"""Run one stage: raw files to bronze, silver, gold, a trained model, scores and serving tables.

    python -m creditloom ingest --raw-dir DIR --root DIR
    python -m creditloom silver --root DIR [--as-of YYYY-MM-DD]
    python -m creditloom transactions --root DIR
    python -m creditloom features --root DIR --as-of YYYY-MM-DD
    python -m creditloom train --root DIR --artifacts DIR
    python -m creditloom score --root DIR --artifacts DIR
    python -m creditloom publish --root DIR [--lookback-days N]

Folders are any URL that Spark can read; ``spark-submit`` sets the cluster's size.
"""

from __future__ import annotations

import argparse
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators import bronze, features, silver
from creditloom.operators.boosting import BoostedTrees, Growth
from creditloom.operators.scores import score_customers
from creditloom.operators.training import fit_scoring, predict
from creditloom.schemas import RAW
from creditloom.session import build_session
from creditloom.sources import files


def ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    tenant = {"institution": args.institution, "source_system": args.source_system}

    def raw(name: str) -> DataFrame:
        return files.scan_csv(spark, f"{args.raw_dir}/{name}.csv", RAW[name])

    today = args.as_of or date.today()
    application, bureau = raw("application_train"), raw("bureau")
    tables = {
        "customers_raw": bronze.customers(application, today, **tenant),
        "loans_raw": bronze.loans(application, raw("previous_application"), bureau, today, **tenant),
        "loan_payments_raw": bronze.loan_payments(raw("installments_payments"), today, **tenant),
        "account_balances_raw": bronze.account_balances(
            raw("credit_card_balance"), raw("POS_CASH_balance"), raw("bureau_balance"), bureau, today, **tenant
        ),
    }
    for name, df in tables.items():
        files.write_layer(df, args.root, "bronze", name, args.max_files)


def to_silver(spark: SparkSession, args: argparse.Namespace) -> None:
    builders = {
        "customers": silver.customers,
        "loans": silver.loans,
        "loan_payments": silver.loan_payments,
        "account_balances": silver.account_balances,
    }
    for name, build in builders.items():
        source = files.scan_layer(spark, args.root, "bronze", f"{name}_raw")
        files.write_layer(build(source, args.as_of), args.root, "silver", name, args.max_files)
    transactions(spark, args)


def transactions(spark: SparkSession, args: argparse.Namespace) -> None:
    # from the written tables: payments and balances are not worked out a second time
    payments = files.scan_layer(spark, args.root, "silver", "loan_payments")
    balances = files.scan_layer(spark, args.root, "silver", "account_balances")
    files.write_layer(silver.transactions(payments, balances), args.root, "silver", "transactions", args.max_files)


def to_features(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = [files.scan_layer(spark, args.root, "silver", name) for name in ("customers", "loans", "transactions")]
    df = features.customer_credit_features(*tables, args.as_of or date.today(), unique_ids=True)
    files.write_layer(df, args.root, "gold", "customer_credit_features", args.max_files)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    trained = fit_scoring(files.scan_layer(spark, args.root, "gold", "customer_credit_features"), Growth(trees=args.trees))
    trained.model.save(spark, f"{args.artifacts}/model")
    files.save_scoring_config(spark, trained.config, f"{args.artifacts}/metadata", **trained.metrics)
    print(trained.metrics)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    model = BoostedTrees.load(spark, f"{args.artifacts}/model")
    config = files.load_scoring_config(spark, f"{args.artifacts}/metadata")
    rows = predict(model, files.scan_layer(spark, args.root, "gold", "customer_credit_features"))
    now = F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
    scores = score_customers(rows, F.col("raw_probability"), config, now)
    files.write_layer(scores, args.root, "gold", "customer_credit_scores", args.max_files)


def publish(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = files.publish_serving(
        args.root,
        customers=files.scan_layer(spark, args.root, "silver", "customers"),
        loans=files.scan_layer(spark, args.root, "silver", "loans"),
        scores=files.scan_layer(spark, args.root, "gold", "customer_credit_scores"),
        features=files.scan_layer(spark, args.root, "gold", "customer_credit_features"),
        transactions=files.scan_layer(spark, args.root, "silver", "transactions"),
        lookback_days=args.lookback_days,
    )
    print(paths)


STAGES = {
    "ingest": ingest,
    "silver": to_silver,
    "transactions": transactions,
    "features": to_features,
    "train": train,
    "score": score,
    "publish": publish,
}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="creditloom", description=__doc__.splitlines()[0])
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--raw-dir")
    parser.add_argument("--root", required=True)
    parser.add_argument("--artifacts")
    parser.add_argument("--as-of", type=date.fromisoformat)
    parser.add_argument("--institution", default=bronze.DEFAULT_TENANT)
    parser.add_argument("--source-system", default=bronze.DEFAULT_TENANT)
    parser.add_argument("--max-files", type=int)
    parser.add_argument("--trees", type=int, default=500)
    parser.add_argument("--lookback-days", type=int, default=1095)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parse(argv)
    STAGES[args.stage](spark or build_session(f"creditloom-{args.stage}"), args)


if __name__ == "__main__":
    main()
