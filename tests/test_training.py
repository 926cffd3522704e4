"""Leaf-wise boosting against a plain loop, and what follows from it: scores, calibration, model files."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.functions.scoring import PUBLISHED
from creditloom.operators import boosting, training
from creditloom.operators.boosting import BoostedTrees, Growth
from creditloom.operators.scores import score_customers
from creditloom.plans import lake as lakes
from creditloom.session import fresh_path
from tests.conftest import SMALL

COLUMNS = ["a", "b", "c", "d"]


def table(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(6)), None if rng.random() < 0.2 else round(rng.uniform(0, 3), 1)
        score = a * (1 if b < 3 else -1) + 0.3 * (c or 0.0)
        out.append((i, a, b, c, 1.0, int(rng.random() < 1 / (1 + math.exp(-score)))))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    schema = "customer_id long, a double, b double, c double, d double, default_flag int"
    return training.with_class_weights(spark.createDataFrame(table(700), schema)).persist()


def plain_fit(data, columns, weights, labels, growth):
    """Every split by going over all rows of a leaf for every value; margins as a list."""
    names, n = columns, len(data)
    edges = []
    for c in range(len(names)):
        values = sorted(r[c] for r in data)
        distinct = sorted(set(values))
        if len(distinct) <= growth.bins:
            edges.append(distinct[:-1])
        else:
            ranks = {values[math.ceil(Fraction(j * n, growth.bins)) - 1] for j in range(1, growth.bins)}
            edges.append(sorted(v for v in ranks if v < distinct[-1]))
    margin, trees = np.zeros(n), []
    scale = boosting.scale_for(sum(weights))
    unit = math.ldexp(1.0, -scale)
    for t in range(growth.trees):
        p = boosting.sigmoid(margin)
        w, y = np.array(weights), np.array(labels, dtype=float)
        g = [int(v) for v in np.rint(w * (p - y) / unit)]
        h = [int(v) for v in np.rint(w * p * (1 - p) / unit)]
        leaf_of, chosen, steps = [0] * n, growth.columns(t, names), []
        for step in range(1, growth.leaves):
            best = None
            for leaf in range(step):
                members = [i for i in range(n) if leaf_of[i] == leaf]
                if not members:
                    continue
                gt, ht = sum(g[i] for i in members), sum(h[i] for i in members)
                for c in chosen:
                    for e, edge in enumerate(edges[c]):
                        left = [i for i in members if data[i][c] <= edge]
                        if min(len(left), len(members) - len(left)) < growth.least_rows:
                            continue
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        parts = [(gl * unit, hl * unit), ((gt - gl) * unit, (ht - hl) * unit), (gt * unit, ht * unit)]
                        if min(parts[0][1], parts[1][1]) < growth.least_hessian:
                            continue
                        gain = parts[0][0] ** 2 / parts[0][1] + parts[1][0] ** 2 / parts[1][1] - parts[2][0] ** 2 / parts[2][1]
                        if gain > 1e-9 and (best is None or (-gain, leaf, c, e) < best[0]):
                            best = ((-gain, leaf, c, e), edge)
            if best is None:
                break
            (minus, leaf, c, e), edge = best
            for i in range(n):
                if leaf_of[i] == leaf and data[i][c] > edge:
                    leaf_of[i] = step
            steps.append((step, leaf, names[c], edge, -minus))
        for leaf in set(leaf_of):
            members = [i for i in range(n) if leaf_of[i] == leaf]
            value = -growth.learning_rate * sum(g[i] for i in members) / sum(h[i] for i in members)
            for i in members:
                margin[i] += value
        trees.append(steps)
    return edges, trees, boosting.sigmoid(margin)


@pytest.mark.parametrize("bins", [12, 255])
def test_trees_equal_a_plain_loop(spark, rows, bins):
    some = training.with_class_weights(rows.where("customer_id < 160").drop("weight")).checkpoint()
    found = some.collect()
    data = [[float(r[c] or 0.0) for c in COLUMNS] for r in found]
    growth = Growth(trees=3, leaves=6, bins=bins, least_rows=8, learning_rate=0.3)
    edges, trees, want = plain_fit(data, COLUMNS, [r["weight"] for r in found], [r["default_flag"] for r in found], growth)
    got = boosting.collected_edges(boosting.bin_edges(some, COLUMNS, bins), COLUMNS)
    assert [list(e) for e in got] == edges
    first = boosting.first_tree(some, COLUMNS, "default_flag", "weight", growth).orderBy("step").collect()
    assert [(r["step"], r["leaf"], r["feature"], r["edge"]) for r in first] == [s[:4] for s in trees[0]]
    assert np.allclose([r["gain"] for r in first], [s[4] for s in trees[0]])
    model = boosting.fit(some, COLUMNS, "default_flag", "weight", growth)
    by_id = {r["customer_id"]: r["raw_probability"] for r in model.transform(some).collect()}
    assert np.allclose([by_id[r["customer_id"]] for r in found], want, atol=1e-12)


def same(left: BoostedTrees, right: BoostedTrees) -> bool:
    return left.trees == right.trees and all(np.array_equal(a, b) for a, b in zip(left.edges, right.edges, strict=True))


def test_the_model_does_not_depend_on_partitions_or_on_where_leaves_grow(spark, rows):
    """Leaves counted by aggregation all the way, some of the way, or not at all; 1 to 13 partitions; margins written."""
    fit = lambda df, step_rows: boosting.fit(
        df, COLUMNS, "default_flag", "weight", Growth(trees=12, leaves=15, least_rows=5, step_rows=step_rows)
    )
    model = fit(rows.repartition(1), 10**6)
    assert any(f >= 0 for f in model.trees[11].feature)
    for parts, step_rows in ((13, 0), (4, 60), (7, 300)):
        assert same(fit(rows.repartition(parts), step_rows), model)
    path = fresh_path(spark, "model")
    model.save(spark, path)
    again = BoostedTrees.load(spark, path)
    assert same(again, model) and again.columns == COLUMNS and again.base == model.base
    both = [m.transform(rows).select("customer_id", "raw_probability") for m in (model, again)]
    assert both[0].exceptAll(both[1]).count() == 0


def test_nothing_to_gain(spark):
    flat = spark.createDataFrame([(i, 1.0, i % 2, 1.0) for i in range(100)], "id long, a double, y int, w double")
    model = boosting.fit(flat, ["a"], "y", "w", Growth(trees=5))
    assert model.trees == [] and model.transform(flat).where("raw_probability <> 0.5").count() == 0
    skewed = spark.createDataFrame([(i, 1.0, int(i < 25), 1.0) for i in range(100)], "id long, a double, y int, w double")
    assert math.isclose(boosting.fit(skewed, ["a"], "y", "w", Growth(trees=5)).transform(skewed).first()["raw_probability"], 0.25)


def test_queries_train_with_the_defaults(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def stopped(rows, columns, label, weight, growth):
        raise Fitted(growth)

    monkeypatch.setattr(boosting, "fit", stopped)
    monkeypatch.setattr(lakes, "_trained", {})
    with pytest.raises(Fitted) as found:
        lakes.Lake(spark, SMALL).trained()
    assert found.value.args[0] == Growth(trees=500, learning_rate=0.03, leaves=31, column_share=0.8, bins=255, seed=42)


def test_quality_is_that_of_level_wise_trees(spark):
    """Held-out area under the curve of 60 trees each on 1500 customers."""
    features = lakes.Lake(spark, "/root/testdata/sf0.01").table("features")
    split = training.stratified_split(features).checkpoint()
    train, valid = split.where("is_train"), split.where("NOT is_train")
    area = lambda model: training.area_under_curve(training.predict(model, valid).checkpoint()).first()["auc"]
    leaf_wise = area(training.train_default_model(train, Growth(trees=60)))
    assert leaf_wise > 0.9 and leaf_wise > area(training.train_level_wise(train, trees=60)) - 0.02


def test_trained_scores_follow_the_calibration(spark, lake):
    """Scores of the trained model, recomputed from its raw probability by the formulas of the scorecard."""
    features = lake.table("features")
    trained = training.fit_scoring(features, Growth(trees=15))
    config = trained.config
    predicted = training.predict(trained.model, features)
    scores = score_customers(predicted, F.col("raw_probability"), config, F.current_timestamp(), keep=["raw_probability"])
    factor = 20 / math.log(2)
    for r in scores.collect():
        raw = min(max(r["raw_probability"], 1e-6), 1 - 1e-6)
        p = 1 / (1 + math.exp(-(config.intercept + config.slope * math.log(raw / (1 - raw)))))
        p = min(max(p, 1e-6), 1 - 1e-6)
        assert math.isclose(r["default_probability"], p, rel_tol=1e-9)
        score = 600 - factor * math.log(config.base_odds) + factor * math.log((1 - p) / p)
        assert abs(r["credit_score"] - min(max(score, 300), 850)) <= 0.5 + 1e-9
        assert r["risk_level"] == ("LOW" if p <= 0.05 else "MEDIUM" if p <= 0.15 else "HIGH")
    rate = features.agg(F.avg("default_flag")).first()[0]
    assert math.isclose(config.base_odds, (1 - rate) / rate)
    half = score_customers(predicted.limit(1), F.lit(0.5), PUBLISHED, F.current_timestamp()).first()
    assert half["credit_score"] == 598 and half["risk_level"] == "MEDIUM"


def test_calibration_is_the_minimum(spark):
    rng = random.Random(2)
    values = [(int(rng.random() < 0.3), rng.choice([0.0, 1e-9, 0.2, 0.5, 0.9, 1.0, rng.random()])) for _ in range(500)]
    df = spark.createDataFrame(values, "default_flag int, raw_probability double").repartition(4)
    fitted = training.platt_steps(df)

    def loss(a, b):
        total = b * b / 2
        for y, p in values:
            q = min(max(p, 1e-6), 1 - 1e-6)
            t = a + b * math.log(q / (1 - q))
            total += max(t, 0) - y * t + math.log1p(math.exp(-abs(t)))
        return total

    least = loss(fitted.intercept, fitted.slope)
    assert math.isclose(least, fitted.steps[-1][2], rel_tol=1e-12)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3), (1e-3, 1e-3)):
        assert loss(fitted.intercept + da, fitted.slope + db) > least
    losses = [s[2] for s in fitted.steps]
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:], strict=False)) and len(losses) < 20


def test_calibration_of_separated_classes(spark):
    """The penalty holds the slope where a perfect model would let it grow."""
    values = [(0, 1e-6)] * 50 + [(1, 1 - 1e-6)] * 50
    fitted = training.platt_steps(spark.createDataFrame(values, "default_flag int, raw_probability double"))
    assert abs(fitted.intercept) < 1e-6 and 0.1 < fitted.slope < 1


def test_the_split_reads_the_table_once(spark, rows):
    """Key and label are counted and ranked on their own; the wide rows meet the cut in a broadcast join."""
    split = training.stratified_split(rows)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 1
    assert split.count() == rows.count() and split.columns == [*rows.columns, "is_train"]


def test_a_step_of_a_tree_is_one_job_over_blocks(spark, rows, monkeypatch):
    """Rows lie in blocks, and rows of small leaves are brought together only once no large leaf is left."""
    looked = []

    def noted(kind):
        job = getattr(boosting.Round, kind)

        def call(self, leaves, *rest):
            looked.append((kind, self.state.count()))
            return job(self, leaves, *rest)

        monkeypatch.setattr(boosting.Round, kind, call)

    noted("histograms")
    noted("subtrees")
    growth = Growth(trees=1, leaves=15, least_rows=5, step_rows=200)
    boosting.first_tree(rows.repartition(3), COLUMNS, "default_flag", "weight", growth)
    kinds = [kind for kind, _ in looked]
    assert "histograms" in kinds and "subtrees" in kinds and "histograms" not in kinds[kinds.index("subtrees") :]
    assert all(blocks <= 3 for _, blocks in looked)


def test_histograms_of_large_gradients_are_exact():
    rng = random.Random(3)
    codes = np.array([[rng.randrange(4), rng.randrange(7)] for _ in range(500)], dtype=np.int16)
    for size in (1 << 20, 1 << 52):  # below 2^53 in sum, and above
        g, h = (np.array([rng.randrange(-size, size) for _ in range(500)], dtype=np.int64) for _ in "gh")
        got = boosting.histogram(codes, g, h, 8)
        for f in range(2):
            for b in range(8):
                some = [i for i in range(500) if codes[i, f] == b]
                assert got[f, b].tolist() == [sum(int(v[i]) for i in some) for v in (g, h)] + [len(some)]


def test_trees_of_a_small_table_take_no_job_each(spark, rows):
    """One task grows them after one another."""
    ran = lambda: max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)

    def jobs(trees):
        before = ran()
        model = boosting.fit(rows, COLUMNS, "default_flag", "weight", Growth(trees=trees, leaves=8, least_rows=5))
        assert len(model.trees) == trees
        return ran() - before

    jobs(1)
    assert jobs(30) <= jobs(2) + 2


def test_one_task_goes_on_from_the_margins_written(spark, rows, monkeypatch):
    growth = dict(trees=7, leaves=8, least_rows=5)
    whole = boosting.fit(rows, COLUMNS, "default_flag", "weight", Growth(**growth))
    monkeypatch.setattr(boosting, "TASK_TREES", 3)
    for step_rows in (10**6, 0):
        model = boosting.fit(rows.repartition(5), COLUMNS, "default_flag", "weight", Growth(**growth, step_rows=step_rows))
        assert same(model, whole) and len(model.trees) == 7


def test_rows_held_are_split_by_the_best_of_all_cuts():
    """Each split against ``best_split`` over a histogram of the leaf's rows; sums of gradients below and above 2^53."""
    rng = random.Random(4)
    n, chosen = 20_000, (0, 2, 3)  # more rows than are counted at once
    codes = np.array([[rng.randrange(b) for b in (1, 9, 40, 7)] for _ in range(n)], dtype=np.int16)
    for size in (1 << 20, 1 << 46):
        g = np.array([rng.randrange(-size, size) + size // 4 * int(c[2] % 3) for c in codes], dtype=np.int64)
        h = np.array([rng.randrange(1, size) for _ in codes], dtype=np.int64)
        rules = boosting.Rules(chosen, 4, 40, 5, 1e-9, 1 / size)
        found, ends = boosting.Held(np.asfortranarray(codes)).grown(g, h, 12, rules)
        assert len(found) == 12 and sorted(np.concatenate(list(ends.values())).tolist()) == list(range(n))
        leaves = {(-1, 0): np.arange(n)}
        for i, (parent, side, split) in enumerate(found):
            best = {k: boosting.best_split(boosting.histogram(codes[r], g[r], h[r], 40), rules) for k, r in leaves.items()}
            assert best[parent, side] == split and split.gain == max(b.gain for b in best.values() if b)
            rows_of = leaves.pop((parent, side))
            over = codes[rows_of, split.feature] > split.bin
            leaves |= {(i, 0): rows_of[~over], (i, 1): rows_of[over]}
        assert all(np.array_equal(leaves[k], r) for k, r in ends.items()) and leaves.keys() == ends.keys()
