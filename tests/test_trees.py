"""Trees as a table: equal to the fitted model, stored and read back, cut short by validation."""

import random
from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from relpoint.operators.fit import TrainingRows, bin_edges, fit_classifier, fit_regressor, score_probability, score_regression
from relpoint.operators.trees import Ensemble, Node, stage_losses, stop_early

GRID = ({"maxDepth": 3, "maxIter": 4},)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for _ in range(400):
        a, b = rng.random(), rng.choice([None, float("nan"), 0.25, 0.75])
        data.append((a, b, int((a > 0.4) != (b == 0.25)), 7 * a))
    return spark.createDataFrame(data, "a double, b double, y int, v double").cache()


@pytest.mark.parametrize("classify", [True, False])
def test_equal_to_the_model(rows, classify):
    fit, apply, target = (
        (fit_classifier, score_probability, "y") if classify else (fit_regressor, score_regression, "v")
    )
    known = rows.where("b > 0 and not isnan(b)")
    model = fit(known, known, ["a", "b"], target, grid=GRID).model
    trees = Ensemble.of(model, ["a", "b"])
    assert trees.classify is classify and trees.trees() == [0, 1, 2, 3]
    worst = apply(model, rows.withColumn("own", trees.score())).agg(F.max(F.abs(F.col("own") - F.col("score")))).first()[0]
    assert worst < 1e-9


def test_table_round_trip_and_plan(spark, rows, tmp_path):
    known = rows.where("b > 0 and not isnan(b)")
    trees = Ensemble.of(fit_classifier(known, known, ["a", "b"], "y", grid=GRID).model, ["a", "b"])
    trees.table(spark).write.parquet(str(tmp_path / "nodes"))
    again = Ensemble.read(spark.read.parquet(str(tmp_path / "nodes")), True)
    assert sorted(again.nodes, key=str) == sorted(trees.nodes, key=str)
    plan = rows.select(again.score().alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "UDF" not in plan
    first = next(n for n in trees.nodes if n.feature is None)
    wrong = replace(trees, nodes=tuple(replace(n, value=n.value + 1) if n == first else n for n in trees.nodes))
    assert rows.where(F.abs(wrong.score() - trees.score()) > 1e-6).count() > 0


def test_stages(spark):
    leaf = [Node(0, 1.0, 1, None, None, 2.0), Node(1, 0.5, 1, None, None, 2.0), Node(2, 1.0, 1, None, None, 4.0)]
    trees = Ensemble(tuple(leaf), False)
    rows = spark.createDataFrame([(3.0,), (3.0,), (None,)], "y double")
    assert stage_losses(trees, rows, "y") == [1.0, 0.0, 4.0]
    assert stop_early(trees, rows, "y").trees() == [0, 1]
    assert trees.first(2).trees() == [0, 1]
    # Equal losses: the fewest trees. No targets: all of them.
    assert stop_early(trees, spark.createDataFrame([(2.5,)], "y double"), "y").trees() == [0]
    assert stage_losses(trees, rows.limit(0), "y") == [None, None, None]
    assert stop_early(trees, rows.where("y is null"), "y") == trees


def test_missing_goes_right(spark):
    nodes = (Node(0, 1.0, 1, "a.b", 1.0, None), Node(0, 1.0, 2, None, None, -1.0), Node(0, 1.0, 3, None, None, 1.0))
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "`a.b` double")
    assert [r[0] for r in rows.select(Ensemble(nodes, False).score()).collect()] == [-1.0, -1.0, 1.0, 1.0, 1.0]


def test_copies_are_one_row_with_their_weight(spark, rows):
    copies = rows.crossJoin(spark.range(25).select(F.lit(2.0).alias("w")))
    once, many = (TrainingRows.of(r, ["a", "b"], "y", w) for r, w in ((rows, None), (copies, "w")))
    assert many.rows.count() == once.rows.count() <= 32 * 3 * 2
    assert many.rows.agg(F.sum("__rows")).first()[0] == 400 * 50.0
    models = [fit_classifier(r, r, ["a", "b"], "y", w, GRID).model for r, w in ((rows, None), (copies, "w"))]
    scores = [r[0] - r[1] for r in score_probability(models[0], rows).withColumnRenamed("score", "one").transform(
        lambda df: score_probability(models[1], df)).select("one", "score").collect()]
    assert len(scores) == 400 and max(map(abs, scores)) < 1e-9


def test_few_values_have_an_edge_between_each(spark):
    values = [(float(i % 30), None, 7.0, float(i)) for i in range(1500)] + [(float("nan"), None, 7.0, float("inf"))]
    found = bin_edges(spark.createDataFrame(values, "a double, b double, c double, d double"), list("abcd"))
    assert found[0] == [i + 0.5 for i in range(29)] and found[1:3] == [[], []]
    assert len(found[3]) == 31 and all(abs(e - 1500 * k / 32) <= 2 for k, e in enumerate(found[3], 1))


def test_missing_values_go_the_same_way_in_both(rows):
    model = fit_classifier(rows, rows, ["a", "b"], "y", grid=GRID).model
    trees = Ensemble.of(model, ["a", "b"])
    scored = score_probability(model, rows.withColumn("own", trees.score()))
    assert scored.where(F.abs(F.col("own") - F.col("score")) > 1e-9).isEmpty()
    assert scored.where("b is null or isnan(b)").count() > 100
