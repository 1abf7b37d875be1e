import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from relpoint.operators.fit import fit_classifier, fit_fractional, fit_regressor
from relpoint.operators.metrics import (
    apply_candidate,
    candidate_scores,
    candidates,
    choose_candidate,
    error_scores,
    ranking_scores,
    threshold_scores,
)
from relpoint.sources.predictions import (
    is_test_split,
    key_cover,
    prediction_name,
    value_violations,
    write_predictions,
)

T = datetime(2020, 2, 1)


def test_ranking_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    got = ranking_scores(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["auroc"] == pytest.approx(won / len(pos) / len(neg))
    ap = sum(
        sum(p == s for p in pos) / len(pos) * sum(p >= s for p in pos) / sum(x >= s for _, x in rows)
        for s in {s for _, s in rows}
    )
    assert got["average_precision"] == pytest.approx(ap)
    one_class = spark.createDataFrame([(1, 0.5)], "y int, s double")
    assert ranking_scores(one_class, "y", "s").first()["auroc"] is None


def test_threshold_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.5), (0, 0.1)], "y int, s double")
    got = threshold_scores(df, "y", "s").first()
    assert got["accuracy"] == 0.5 and got["f1"] == 0.5


def test_normalized_error(spark):
    test = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "y double, p double")
    assert error_scores(test, "y", "p", test, "y").first()["nmae"] == 1.0
    flat = spark.createDataFrame([(1.0,), (1.0,)], "y double")
    with pytest.raises(Exception, match="deviation"):
        error_scores(test, "y", "p", flat, "y").collect()


def test_candidates(spark):
    df = spark.createDataFrame([(-0.2, 0.1), (0.4, 0.6), (1.2, 0.9)], "reg double, prob double")
    long = candidates(df, "reg", "prob").collect()
    blend = [r["prediction"] for r in long if r["candidate"] == "mean_of_both"]
    assert blend == pytest.approx([0.05, 0.5, 0.95])
    assert [r["prediction"] for r in long if r["candidate"] == "clipped_value"] == [0.0, 0.4, 1.0]


def test_candidate_choice(spark):
    df = spark.createDataFrame(
        [(0.0, 0.4, 0.1), (1.0, 0.6, 0.9), (0.5, 0.5, 0.5)], "y double, reg double, prob double"
    )
    scores = candidate_scores(df, "y", "reg", "prob")
    mae = {r["candidate"]: r["mae"] for r in scores.collect()}
    assert mae["probability"] < mae["mean_of_both"] < mae["clipped_value"]
    chosen = choose_candidate(scores)
    assert chosen.first()["candidate"] == "probability"
    assert sorted(r["prediction"] for r in apply_candidate(df, chosen, "reg", "prob").collect()) == [0.1, 0.5, 0.9]
    tie = spark.createDataFrame([(0.5, 0.5, 0.5)], "y double, reg double, prob double")
    assert choose_candidate(candidate_scores(tie, "y", "reg", "prob")).first()["candidate"] == "clipped_value"


def test_key_cover_and_sink(spark, tmp_path):
    expected = spark.createDataFrame([(T, 1), (T, 2)], "cutoff timestamp_ntz, e bigint")
    made = spark.createDataFrame([(T, 2, 0.2), (T, 1, 0.1)], "cutoff timestamp_ntz, e bigint, p double")
    keys = ["cutoff", "e"]
    assert tuple(key_cover(made, expected, keys).first()) == (0, 0, 0, 0)
    assert tuple(key_cover(made.where("e = 1").union(made.where("e = 1")), expected, keys).first()) == (1, 0, 1, 0)
    path = str(tmp_path / prediction_name("data", "task"))
    write_predictions(made, expected, keys, "p", "target", path, classification=True)
    rows = spark.read.option("header", True).csv(path).collect()
    assert {(r["e"], r["target"]) for r in rows} == {("1", "0.1"), ("2", "0.2")}
    with pytest.raises(ValueError, match="coverage"):
        write_predictions(made.where("e = 1"), expected, keys, "p", "target", path, True)
    with pytest.raises(ValueError, match="invalid"):
        write_predictions(made.withColumn("p", F.col("p") * 9), expected, keys, "p", "target", path, True)
    with pytest.raises(ValueError):
        prediction_name("a/b", "task")


def test_value_checks(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (float("nan"),), (float("inf"),), (None,)], "p double")
    got = value_violations(df, "p", True).first()
    assert (got["n_rows"], got["non_finite"]) == (5, 3)
    assert value_violations(df, "p", False).first()["out_of_range"] == 0


def test_split_detection(spark):
    def check(*times):
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        return is_test_split(df, "t", T).first()["is_test"]

    assert check(T, datetime(2021, 1, 1)) == 1
    assert check(T, datetime(2020, 1, 1)) == 0
    assert check(T, None) == 0
    assert check() == 0


def test_fits(spark):
    rng = random.Random(8)
    rows = [(x, float(rng.random()), int(x > 0.5), 10 * x, x) for x in (rng.random() for _ in range(200))]
    df = spark.createDataFrame(rows, "a double, b double, y int, v double, share double")
    grid = ({"maxDepth": 2, "maxIter": 2}, {"maxDepth": 2, "maxIter": 3})
    train, val = df.where("b < 0.7"), df.where("b >= 0.7")
    assert fit_classifier(train, val, ["a", "b"], "y", grid=grid).score > 0.95
    assert fit_regressor(train, val, ["a", "b"], "v", grid=grid).score < 2.0
    assert fit_fractional(train, val, ["a", "b"], "share", grid=grid).score < 0.3
