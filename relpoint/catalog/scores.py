"""Metrics, candidate choice, prediction checks, model fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import DELTA, TEST, VALIDATION, davg, dsum, rounded, stamp, table
from relpoint.catalog.inputs import churn_labels, order_graph
from relpoint.operators.fit import GRID, fit_classifier, fit_regressor, score_probability, score_regression
from relpoint.operators.labels import Measure, entity_cutoffs, label_table, window_measures
from relpoint.operators.metrics import (
    apply_candidate,
    candidate_scores,
    choose_candidate,
    error_scores,
    ranking_scores,
    threshold_scores,
)
from relpoint.operators.model_inputs import InputLayout, coerce_keys, select_features, with_class_weights
from relpoint.plans.compiler import frame
from relpoint.plans.cutoffs import split_cutoffs
from relpoint.session import reliable, shared_folder
from relpoint.sources.predictions import is_test_split, key_cover, value_violations, write_predictions


def _judged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels scored by text length in steps of 100 characters (many ties)."""
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    score = F.least(F.floor(F.col("n_chars") / 100), F.lit(100)) / F.lit(100.0)
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return labels.join(documents, "doc_id").select("doc_id", "quality", score.alias("score"))


_JUDGED = """SELECT doc_id, quality, least(n_chars // 100, 100) / 100.0::DOUBLE AS score
  FROM labels JOIN documents USING (doc_id)"""


def metrics_classification(spark: SparkSession, folder: str) -> DataFrame:
    judged = _judged_documents(spark, folder)
    scores = threshold_scores(judged, "quality", "score")
    ranks = ranking_scores(judged, "quality", "score")
    both = scores.withColumns(
        {c: ranks.select(c).scalar() for c in ("auroc", "average_precision")}
    )
    return rounded(both, both.columns, 9)


_CLASSIFICATION_SQL = f"""
WITH j AS ({_JUDGED}),
t AS (SELECT count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM j),
d AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg
  FROM j GROUP BY score),
a AS (SELECT sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS won
  FROM (SELECT score FROM j WHERE quality = 1) x, (SELECT score FROM j WHERE quality = 0) y),
o AS (SELECT pos, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS k FROM d
  WINDOW w AS (ORDER BY score DESC)),
c AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND quality = 1) AS tp,
  count(*) FILTER (WHERE score >= 0.5 AND quality = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND quality = 1) AS fn,
  count(*) FILTER (WHERE score < 0.5 AND quality = 0) AS tn FROM j)
SELECT round(CAST(won AS DOUBLE) / (p * n), 9) AS auroc,
  round((SELECT sum(pos * (CAST(tp AS DOUBLE) / k)) FROM o) / p, 9) AS average_precision,
  round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 9) AS accuracy,
  round(COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0), 9) AS f1
FROM t, a, c
"""


def _spend(spark: SparkSession, folder: str, moments) -> DataFrame:
    """Future spend per customer with two guesses: past window spend, past mean order."""
    orders = table(spark, folder, "orders")
    value = F.col("o_totalprice")
    keys = entity_cutoffs(table(spark, folder, "customer"), "c_custkey", moments)
    future = window_measures(
        orders, "o_custkey", "o_orderdate", moments, DELTA, [Measure("truth", "sum", value)]
    )
    past = window_measures(
        orders, "o_custkey", "o_orderdate", moments, DELTA,
        [Measure("guess", "sum", value), Measure("mean", "avg", value)], past=True,
    )
    labels = label_table(keys, "c_custkey", future, "o_custkey", ["truth"])
    joined = label_table(labels, "c_custkey", past, "o_custkey", ["guess", "mean"])
    return joined.withColumns({c: F.col(c).cast("double") for c in ("truth", "guess")})


def _spend_sql(moment) -> str:
    return f"""SELECT {stamp(moment)} AS cutoff, c_custkey, COALESCE(t, 0.0::DOUBLE) AS truth,
    COALESCE(g, 0.0::DOUBLE) AS guess, COALESCE(m, 0.0::DOUBLE) AS mean
  FROM customer
  LEFT JOIN (SELECT o_custkey, {dsum("o_totalprice")} AS t FROM orders WHERE o_orderdate > {stamp(moment)}
    AND o_orderdate <= {stamp(moment)} + INTERVAL 90 DAY GROUP BY o_custkey) a ON a.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, {dsum("o_totalprice")} AS g, {davg("o_totalprice")} AS m FROM orders
    WHERE o_orderdate > {stamp(moment)} - INTERVAL 90 DAY AND o_orderdate <= {stamp(moment)}
    GROUP BY o_custkey) b ON b.o_custkey = c_custkey"""


def metrics_regression(spark: SparkSession, folder: str) -> DataFrame:
    """MAE and normalized MAE; the deviation comes from the train target only."""
    test, train = _spend(spark, folder, [TEST]), _spend(spark, folder, [VALIDATION])
    scores = error_scores(test, "truth", "guess", train, "truth")
    return scores.select(F.round("mae", 4).alias("mae"), F.round("nmae", 9).alias("nmae"))


_REGRESSION_SQL = f"""
WITH test AS ({_spend_sql(TEST)}), train AS ({_spend_sql(VALIDATION)})
SELECT round(avg(abs(truth - guess)), 4) AS mae,
  round(avg(abs(truth - guess)) / (SELECT stddev_pop(truth) FROM train), 9) AS nmae FROM test
"""


def _bounded(spark: SparkSession, folder: str, moment) -> DataFrame:
    """Target in [0, 1] with an unbounded and a bounded prediction."""
    scale = F.lit(500000.0)
    return _spend(spark, folder, [moment]).select(
        "cutoff",
        "c_custkey",
        F.least(F.col("truth") / scale, F.lit(1.0)).alias("y"),
        (F.col("guess") / scale * 1.5 - 0.1).alias("reg"),
        (F.col("mean") / scale).alias("prob"),
    )


def _bounded_sql(moment) -> str:
    return f"""SELECT cutoff, c_custkey, least(truth / 500000.0::DOUBLE, 1.0::DOUBLE) AS y,
  least(greatest(guess / 500000.0::DOUBLE * 1.5::DOUBLE - 0.1::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS r,
  least(greatest(mean / 500000.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS p FROM ({_spend_sql(moment)})"""


def candidate_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Validation MAE of regression, probability and their blend."""
    scores = candidate_scores(_bounded(spark, folder, VALIDATION), "y", "reg", "prob")
    return rounded(scores, ["mae"], 9)


_ERRORS = f"""SELECT 'clipped_value' AS candidate, avg(abs(y - r)) AS mae FROM ({_bounded_sql(VALIDATION)})
UNION ALL SELECT 'probability', avg(abs(y - p)) FROM ({_bounded_sql(VALIDATION)})
UNION ALL SELECT 'mean_of_both', avg(abs(y - 0.5::DOUBLE * (r + p))) FROM ({_bounded_sql(VALIDATION)})"""


def candidate_select(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate chosen on validation, applied to every test row."""
    chosen = choose_candidate(candidate_scores(_bounded(spark, folder, VALIDATION), "y", "reg", "prob"))
    return apply_candidate(_bounded(spark, folder, TEST), chosen, "reg", "prob").select(
        "cutoff", "c_custkey", "candidate", "prediction"
    )


_SELECT_SQL = f"""
WITH b AS (SELECT candidate FROM ({_ERRORS}) ORDER BY mae LIMIT 1)
SELECT cutoff, c_custkey, candidate, CASE candidate WHEN 'clipped_value' THEN r
  WHEN 'probability' THEN p ELSE 0.5::DOUBLE * (r + p) END AS prediction
FROM ({_bounded_sql(TEST)}), b
"""


def prediction_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, value and split checks of a deliberately faulty prediction table."""
    expected = entity_cutoffs(table(spark, folder, "customer"), "c_custkey", [TEST])
    orders = table(spark, folder, "orders")
    buyers = orders.select(F.lit(None).cast("timestamp_ntz").alias("cutoff"), F.col("o_custkey").alias("c_custkey"))
    made = orders.select(
        F.expr(stamp(TEST).replace("TIMESTAMP ", "TIMESTAMP_NTZ ")).alias("cutoff"),
        (F.col("o_custkey") * 2).alias("c_custkey"),
        (F.col("o_totalprice").cast("double") / 400000.0).alias("prediction"),
    )
    cover = key_cover(made, expected, ["cutoff", "c_custkey"])
    values = value_violations(made, "prediction", classification=True)
    checks = cover.withColumns({c: values.select(c).scalar() for c in values.columns})
    on_test = is_test_split(made, "cutoff", TEST).scalar()
    unknown = is_test_split(buyers, "cutoff", TEST).scalar()
    return checks.withColumns({"is_test": on_test, "is_test_unknown": unknown})


_CHECKS_SQL = """
WITH e AS (SELECT c_custkey AS k FROM customer), m AS (SELECT o_custkey * 2 AS k, o_totalprice FROM orders),
d AS (SELECT k, count(*) AS n FROM m GROUP BY k)
SELECT (SELECT count(*) FROM e WHERE k NOT IN (SELECT k FROM d)) AS missing,
  (SELECT count(*) FROM d WHERE k NOT IN (SELECT k FROM e)) AS extra,
  (SELECT count(*) FROM d WHERE n > 1) AS duplicates, 0::BIGINT AS expected_duplicates,
  count(*) AS n_rows, 0::BIGINT AS non_finite,
  count(*) FILTER (WHERE CAST(o_totalprice AS DECIMAL(12,2)) / 400000.0::DOUBLE > 1) AS out_of_range,
  1 AS is_test, 0 AS is_test_unknown
FROM m
"""


def prediction_table(spark: SparkSession, folder: str) -> DataFrame:
    """Checked predictions written as CSV and read back."""
    keys = ["cutoff", "c_custkey"]
    expected = entity_cutoffs(table(spark, folder, "customer"), "c_custkey", [TEST])
    made = _bounded(spark, folder, TEST).select(*keys, F.col("prob").alias("prediction"))
    path = shared_folder(spark, "predictions")
    write_predictions(made, expected, keys, "prediction", "target", path, classification=False)
    schema = "cutoff timestamp_ntz, c_custkey bigint, target double"
    return spark.read.schema(schema).option("header", True).csv(path)


_TABLE_SQL = f"SELECT cutoff, c_custkey, mean / 500000.0::DOUBLE AS target FROM ({_spend_sql(TEST)})"


def _splits(spark: SparkSession, folder: str) -> dict[str, list]:
    low, high = table(spark, folder, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    names = ("train", "val", "test")
    return {s: split_cutoffs(s, VALIDATION, TEST, DELTA, low, high) for s in names}


def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Churn classifier and spend regressor fitted on the engine's grid: one row per test customer.

    A row tells how often the customer was scored, whether the probability lies in the unit interval and
    the value is a number, and whether the chosen configurations have the best validation scores.
    """
    splits = _splits(spark, folder)
    every = sorted({c for s in splits.values() for c in s})
    labels = coerce_keys(churn_labels(spark, folder, every), "customer")
    spend = _spend(spark, folder, every).select("cutoff", F.col("c_custkey").alias("customer"), F.col("truth").alias("amount"))
    labels = labels.join(spend, ["cutoff", "customer"])
    rows = frame(order_graph(spark, folder, every), keys=labels, how="left")
    columns = select_features([rows.schema], "target", ["amount", "cus_c_custkey"])
    layout = InputLayout.fit(rows.schema, columns)
    data = reliable(layout.apply(rows, keep=["cutoff", "cus_c_custkey", "target", "amount"]))
    train, val, test = (
        data.where(F.col("cutoff").isin(*(F.expr(stamp(c).replace("TIMESTAMP ", "TIMESTAMP_NTZ ")) for c in splits[s])))
        for s in ("train", "val", "test")
    )
    churn = fit_classifier(with_class_weights(train, "target"), val, columns, "target", "weight")
    value = fit_regressor(train, val, columns, "amount")
    best = [
        GRID.index(churn.config) == max(range(len(GRID)), key=lambda i: churn.scores[i]),
        GRID.index(value.config) == min(range(len(GRID)), key=lambda i: value.scores[i]),
    ]
    keys = ["cutoff", "cus_c_custkey"]
    ranks = score_probability(churn.model, test).groupBy(*keys).agg(
        F.count("score").alias("n_scores"), F.min(F.col("score").between(0, 1).cast("int")).alias("in_range")
    )
    amounts = score_regression(value.model, test).groupBy(*keys).agg(
        F.count("score").alias("n_amounts"), F.min((~F.isnan("score")).cast("int")).alias("is_number")
    )
    return ranks.join(amounts, keys).withColumn("best_of_grid", F.lit(int(all(best))))


_GBT_SQL = f"""
SELECT {stamp(TEST)} AS cutoff, c_custkey AS cus_c_custkey, CAST(1 AS BIGINT) AS n_scores, 1 AS in_range,
  CAST(1 AS BIGINT) AS n_amounts, 1 AS is_number, 1 AS best_of_grid
FROM customer
"""

QUERIES = {
    "metrics_classification": metrics_classification,
    "metrics_regression": metrics_regression,
    "candidate_errors": candidate_errors,
    "candidate_select": candidate_select,
    "prediction_checks": prediction_checks,
    "prediction_table": prediction_table,
    "gbt_scores": gbt_scores,
}

SQL = {
    "metrics_classification": _CLASSIFICATION_SQL,
    "metrics_regression": _REGRESSION_SQL,
    "candidate_errors": f"SELECT candidate, round(mae, 9) AS mae FROM ({_ERRORS})",
    "candidate_select": _SELECT_SQL,
    "prediction_checks": _CHECKS_SQL,
    "prediction_table": _TABLE_SQL,
    "gbt_scores": _GBT_SQL,
}
