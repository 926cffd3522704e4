"""Label checks, split, weights, model, calibration and quality, all on Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions import scoring
from creditloom.functions.scoring import ScoringConfig
from creditloom.operators import boosting
from creditloom.operators.boosting import BoostedTrees, Growth
from creditloom.operators.running import running
from creditloom.operators.scores import model_probabilities
from creditloom.schemas import FEATURE_COLUMNS
from creditloom.session import fresh_path, remove, shared_dir

LABEL = "default_flag"


def label_counts(features: DataFrame) -> DataFrame:
    return features.groupBy(LABEL).agg(F.count(F.lit(1)).alias("row_count"))


def require_two_classes(features: DataFrame) -> None:
    classes = label_counts(features).limit(2).count()
    if classes == 0:
        raise ValueError("there are no feature rows to train on")
    if classes == 1:
        raise ValueError("the label has a single class")


def _quotas(counts: DataFrame, test_fraction: float) -> DataFrame:
    """Rows per class that go to training: proportional, the remainder to the largest fractions."""
    everything = Window.partitionBy()  # one row per class
    total = F.sum("row_count").over(everything)
    train = total - F.ceil(total * F.lit(test_fraction))
    share = counts.select(LABEL, "row_count", train.alias("train"), (train * F.col("row_count") / total).alias("share"))
    floors = share.withColumn("quota", F.floor("share"))
    left_over = F.col("train") - F.sum("quota").over(everything)
    by_fraction = F.row_number().over(Window.orderBy(F.desc(F.col("share") - F.col("quota")), F.asc(LABEL)))
    return floors.select(LABEL, (F.col("quota") + F.when(by_fraction <= left_over, 1).otherwise(0)).alias("quota"))


def stratified_split(
    features: DataFrame, key: str = "customer_id", test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_train``: exact class quotas, chosen by a hash of the key, which is unique.

    Ranking a whole class would sort it in one task. Instead rows are counted by the first hash digits, which shows the
    digits where the quota is reached; only rows with just these digits are ranked, and the one that fills the quota marks the
    cut. Key and label are read twice for that, the table itself once.
    """
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    narrow = features.select(key, LABEL, text.alias("_hash")).withColumn("_digits", F.substring("_hash", 1, 4))

    per_digits = narrow.groupBy(LABEL, "_digits").agg(F.count(F.lit(1)).alias("n"))  # 65536 per class at most
    path = fresh_path(features.sparkSession, "split")
    per_digits.write.parquet(path)  # for the quotas and for the cut
    per_digits = features.sparkSession.read.schema(per_digits.schema).parquet(path)
    counts = per_digits.groupBy(LABEL).agg(F.sum("n").alias("row_count"))
    before = Window.partitionBy(LABEL).orderBy("_digits").rowsBetween(Window.unboundedPreceding, -1)
    counted = per_digits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = (
        counted.join(F.broadcast(_quotas(counts, test_fraction)), LABEL)
        .where("before < quota AND quota <= before + n")
        .select(F.col(LABEL).alias("_label"), F.col("_digits").alias("_cut"), (F.col("quota") - F.col("before")).alias("_open"))
    )
    edge = narrow.join(F.broadcast(cut), (F.col(LABEL) == F.col("_label")) & (F.col("_digits") == F.col("_cut")))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", key))
    last = edge.withColumn("_rank", rank).where("_rank = _open").select("_label", F.col("_hash").alias("_last"))
    placed = features.join(F.broadcast(last), F.col(LABEL) == F.col("_label"), "left")  # one row per class
    return placed.withColumn("is_train", F.coalesce(text <= F.col("_last"), F.lit(False))).drop("_label", "_last")


def class_weights(features: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = label_counts(features)
    everything = Window.partitionBy()  # one row per class
    rows, classes = F.sum("row_count").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(LABEL, "row_count", (rows / (classes * F.col("row_count"))).alias("weight"))


def with_class_weights(features: DataFrame) -> DataFrame:
    weights = class_weights(features).select(LABEL, "weight")
    return features.join(F.broadcast(weights), LABEL)  # one row per class


def train_default_model(train: DataFrame, growth: Growth = Growth()) -> BoostedTrees:
    """Leaf-wise boosted trees on the 17 features with balanced classes."""
    return boosting.fit(with_class_weights(train), FEATURE_COLUMNS, LABEL, "weight", growth)


def train_level_wise(
    train: DataFrame,
    trees: int = 500,
    learning_rate: float = 0.03,
    depth: int = 5,
    column_share: float = 0.8,
    seed: int = 42,
) -> PipelineModel:
    """Trees of one depth by ``pyspark.ml``, to compare with."""
    shared_dir(train.sparkSession)  # boosting cuts its lineage in the checkpoint folder
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS]
    rows = with_class_weights(train).select(*columns, F.col(LABEL).cast("double").alias(LABEL), "weight")
    assembler = VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features")
    booster = GBTClassifier(
        labelCol=LABEL,
        weightCol="weight",
        maxIter=trees,
        stepSize=learning_rate,
        maxDepth=depth,
        featureSubsetStrategy=str(column_share),
        seed=seed,
        checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, booster]).fit(rows)


def predict(model: BoostedTrees | PipelineModel, features: DataFrame) -> DataFrame:
    """``features`` with ``raw_probability``."""
    if isinstance(model, BoostedTrees):
        return model.transform(features)
    return model_probabilities(model, features.fillna(0, FEATURE_COLUMNS))


@dataclass(frozen=True)
class PlattFit:
    """The fitted line and, per step, the intercept, slope and loss that it started from."""

    intercept: float
    slope: float
    steps: list[tuple[float, float, float]]


def platt_steps(
    scored: DataFrame, raw: str = "raw_probability", penalty: float = 1.0, tolerance: float = 1e-12, most: int = 100
) -> PlattFit:
    """Logistic regression of the label on the logit of ``raw`` by Newton's method.

    The loss is the sum over rows plus ``penalty / 2 * slope^2``; the intercept is free. A step is one aggregation of six sums
    over rows that are counted per distinct logit and label first. A step that doesn't lessen the loss is halved. Both classes
    have to occur, or there is no finite intercept.
    """
    label = (F.col(LABEL) == 1).cast("double").alias("y")
    rows = scored.select(label, scoring.logit(F.col(raw)).alias("z")).groupBy("y", "z").agg(F.count(F.lit(1)).alias("n"))
    path = fresh_path(scored.sparkSession, "platt")
    rows.write.parquet(path)  # read by every step
    rows = scored.sparkSession.read.schema(rows.schema).parquet(path)

    def sums(a: float, b: float) -> tuple[float, ...]:
        n, y, z = F.col("n"), F.col("y"), F.col("z")
        t = F.lit(a) + F.lit(b) * z
        p = scoring.sigmoid(t)
        loss = F.greatest(t, F.lit(0.0)) - y * t + F.log1p(F.exp(-F.abs(t)))
        off, curve = p - y, p * (1.0 - p)
        found = rows.agg(*[F.sum(n * x) for x in (loss, off, off * z, curve, curve * z, curve * z * z)]).first()
        total, ga, gb, haa, hab, hbb = (float(v or 0.0) for v in found)
        return total + penalty / 2 * b * b, ga, gb + penalty * b, haa, hab, hbb + penalty

    a = b = 0.0
    now = sums(a, b)
    steps = [(a, b, now[0])]
    for _ in range(most):
        loss, ga, gb, haa, hab, hbb = now
        determinant = haa * hbb - hab * hab
        if determinant <= 0:
            break
        da, db = (hbb * ga - hab * gb) / determinant, (haa * gb - hab * ga) / determinant
        size = 1.0
        if max(abs(da), abs(db)) <= tolerance * max(1.0, abs(a), abs(b)):
            break
        while True:
            after = sums(a - size * da, b - size * db)
            if after[0] <= loss + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        a, b, now = a - size * da, b - size * db, after
        steps.append((a, b, now[0]))
        if max(abs(da), abs(db)) * size <= 1e-9 * max(1.0, abs(a), abs(b)):
            break  # the next step would be below the last digits
    remove(scored.sparkSession, path)
    return PlattFit(a, b, steps)


def platt_fit(scored: DataFrame, raw: str = "raw_probability") -> tuple[float, float]:
    """Intercept and slope of the label's logistic regression on the logit, penalty 1."""
    fitted = platt_steps(scored, raw)
    return fitted.intercept, fitted.slope


def area_under_curve(scored: DataFrame, score: str = "raw_probability") -> DataFrame:
    """Exact area under the ROC curve, ties counted half, in one row.

    Rows are first counted per distinct score; negatives below a score come from a running total that
    no single task computes alone.
    """
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(LABEL) == 1, 1).otherwise(0)).alias("positives"),
        F.sum(F.when(F.col(LABEL) == 1, 0).otherwise(1)).alias("negatives"),
    )
    counted = per_score.withColumn("up_to", F.col("negatives"))
    ordered = running(counted, [], ["score"], sums=["up_to"])
    below = F.col("up_to") - F.col("negatives") / 2  # below, and half of the ties
    pairs = F.sum(F.col("positives") * below)
    return ordered.agg(
        F.try_divide(pairs, F.sum("positives").cast("double") * F.sum("negatives").cast("double")).alias("auc")
    )


def _brier(probability: Column) -> Column:
    return F.avg((probability - F.col(LABEL)) * (probability - F.col(LABEL)))


def model_metrics(scored: DataFrame, config: ScoringConfig, raw: str = "raw_probability") -> DataFrame:
    """Area under the curve, Brier scores before and after calibration, base rate and rows."""
    probability = F.col(raw)
    quality = scored.agg(
        _brier(scoring.clamp_probability(probability)).alias("brier_raw"),
        _brier(scoring.calibrate(probability, config)).alias("brier_calibrated"),
        F.avg(F.col(LABEL).cast("double")).alias("base_rate"),
        F.count(F.lit(1)).alias("row_count"),
    )
    # both sides are a single row
    return quality.withColumn("auc", area_under_curve(scored, raw).scalar())


def scorecard_parameters(features: DataFrame) -> DataFrame:
    """Base odds from the overall default rate, and the fixed rest of the scorecard."""
    rate = F.avg(F.col(LABEL).cast("double"))
    return features.agg(rate.alias("base_default_rate")).select(
        "base_default_rate",
        ((1.0 - F.col("base_default_rate")) / F.greatest("base_default_rate", F.lit(1e-6))).alias("base_odds"),
        F.lit(600.0).alias("base_score"),
        F.lit(20.0).alias("points_to_double_odds"),
        F.lit(300).alias("min_score"),
        F.lit(850).alias("max_score"),
        F.lit(0.05).cast("double").alias("low_max"),
        F.lit(0.15).cast("double").alias("medium_max"),
    )


@dataclass(frozen=True)
class TrainedModel:
    model: BoostedTrees
    config: ScoringConfig
    metrics: dict[str, float]


def fit_scoring(features: DataFrame, growth: Growth = Growth()) -> TrainedModel:
    """Split, train, calibrate on the held-out part and derive the scorecard."""
    require_two_classes(features)
    # used by every boosting round: written once, not recomputed
    shared_dir(features.sparkSession)
    split = stratified_split(features.select("customer_id", *FEATURE_COLUMNS, LABEL)).checkpoint()
    train, valid = split.where("is_train"), split.where("NOT is_train")
    model = train_default_model(train, growth)
    scored = predict(model, valid).select("customer_id", LABEL, "raw_probability").checkpoint()
    intercept, slope = platt_fit(scored)
    card = scorecard_parameters(split).first()
    config = ScoringConfig(
        calibration="platt_logit",
        intercept=intercept,
        slope=slope,
        scorecard="log_odds",
        base_score=card["base_score"],
        base_odds=card["base_odds"],
        points_to_double_odds=card["points_to_double_odds"],
        min_score=card["min_score"],
        max_score=card["max_score"],
        low_max=card["low_max"],
        medium_max=card["medium_max"],
    )
    metrics = model_metrics(scored, config).first().asDict()
    metrics["train_rows"] = train.count()
    metrics["valid_rows"] = metrics.pop("row_count")
    metrics["base_rate"] = card["base_default_rate"]
    return TrainedModel(model, config, metrics)
