"""All stages of the command line over CSV files, from raw rows to serving tables."""

from __future__ import annotations

import shutil

import pytest

from creditloom.__main__ import main
from creditloom.sources.files import load_scoring_config
from creditloom.sources.standin import SOURCES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    raw, root = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("root")
    for name, build in SOURCES.items():
        parts = tmp_path_factory.mktemp(name) / "csv"
        build(spark, SMALL).coalesce(1).write.option("header", True).csv(str(parts))
        shutil.copy(next(parts.glob("*.csv")), raw / f"{name}.csv")
    return str(raw), str(root)


def test_stages(spark, folders, lake):
    raw, root = folders
    common = ["--root", root, "--artifacts", f"{root}/artifacts"]
    main(["ingest", "--raw-dir", raw, "--institution", "t0", "--as-of", "2024-02-01", *common], spark)
    main(["silver", "--as-of", "2024-02-01", *common], spark)
    main(["features", "--as-of", "2024-02-01", *common], spark)
    features = spark.read.parquet(f"{root}/gold/customer_credit_features")
    compared = [c for c in features.columns if c not in ("institution_id", "created_at", "account_stability")]
    assert features.select(compared).exceptAll(lake.table("features").select(compared)).count() == 0
    assert features.count() == lake.table("features").count()

    main(["train", "--trees", "5", *common], spark)
    config = load_scoring_config(spark, f"{root}/artifacts/metadata")
    assert config.calibration == "platt_logit" and config.low_max == 0.05
    main(["score", *common], spark)
    scores = spark.read.parquet(f"{root}/gold/customer_credit_scores")
    assert scores.where("credit_score BETWEEN 300 AND 850").count() == features.count()

    main(["publish", *common], spark)
    assert spark.read.parquet(f"{root}/serving/customer_credit_scores").count() == features.count()
    profiles = spark.read.parquet(f"{root}/serving/customer_profile")
    assert profiles.count() == profiles.select("customer_id").distinct().count() > 0


def test_backfilled_transactions_equal_the_first_build(spark, folders):
    _, root = folders
    before = spark.read.parquet(f"{root}/silver/transactions").checkpoint()
    main(["transactions", "--root", root], spark)
    assert spark.read.parquet(f"{root}/silver/transactions").exceptAll(before).count() == 0


def test_tables_of_two_days_are_kept_apart(lake):
    from datetime import date

    from creditloom.plans.lake import Lake

    other = Lake(lake.spark, lake.sf_dir, date(2025, 2, 1))
    total = lambda one: one.table("features").agg({"account_age_days": "sum"}).first()[0]
    assert total(other) > total(lake)
