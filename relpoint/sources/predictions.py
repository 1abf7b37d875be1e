"""Prediction tables: key coverage, value checks and the CSV sink."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.functions.timegrid import timestamp_literal
from relpoint.session import reliable


def prediction_name(dataset: str, task: str) -> str:
    if not dataset or not task or any(s in dataset + task for s in "/\\"):
        raise ValueError("dataset and task must be plain, non-empty names")
    return f"{dataset}__{task}"


def key_cover(predictions: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing, extra and duplicated keys as one row of counts."""
    # Presence per key from one shuffle of both sides together.
    sides = predictions.select(*keys, F.lit(1).alias("__made"), F.lit(0).alias("__due")).unionByName(
        expected.select(*keys, F.lit(0).alias("__made"), F.lit(1).alias("__due"))
    )
    seen = sides.groupBy(*keys).agg(F.sum("__made").alias("__made"), F.sum("__due").alias("__due"))
    p, e = F.col("__made"), F.col("__due")
    return seen.agg(
        F.count_if((p == 0) & (e > 0)).alias("missing"),
        F.count_if((p > 0) & (e == 0)).alias("extra"),
        F.count_if(p > 1).alias("duplicates"),
        F.count_if(e > 1).alias("expected_duplicates"),
    )


def value_violations(predictions: DataFrame, column: str, classification: bool) -> DataFrame:
    """Missing, non-finite and out-of-range predictions as one row of counts."""
    x = F.col(column).cast("double")
    infinite = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    outside = ((x < 0) | (x > 1)) if classification else F.lit(False)
    return predictions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(x.isNull() | infinite).alias("non_finite"),
        F.count_if(outside).alias("out_of_range"),
    )


def is_test_split(task: DataFrame, time_col: str, test_time: datetime) -> DataFrame:
    """One row, ``is_test``: no missing time, and none before the test timestamp."""
    t = F.col(time_col)
    bound = timestamp_literal(test_time, task.schema[time_col].dataType)
    known = (F.count(F.lit(1)) > 0) & (F.count_if(t.isNull()) == 0)
    return task.agg((known & F.coalesce(F.min(t) >= bound, F.lit(False))).cast("int").alias("is_test"))


def write_predictions(
    predictions: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    prediction: str,
    target: str,
    path: str,
    classification: bool,
) -> None:
    """Check keys and values, then write keys + target as CSV.

    Predictions are stored once before they are checked. The folder is written beside the old one and
    takes its place when it is complete; a failed write leaves the old one.
    """
    predictions = reliable(predictions)
    cover = key_cover(predictions, expected, keys).first()
    if any(cover):
        raise ValueError(f"incomplete key coverage: {cover.asDict()}")
    bad = value_violations(predictions, prediction, classification).first()
    if bad["non_finite"] or bad["out_of_range"]:
        raise ValueError(f"invalid predictions: {bad.asDict()}")
    out = predictions.select(*keys, F.col(prediction).cast("double").alias(target))
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    out.write.option("header", True).csv(new)
    _take_place(out.sparkSession, new, path)


def _take_place(spark: SparkSession, new: str, path: str) -> None:
    """Rename ``new`` to ``path``; an old folder goes once the new one stands."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    target, old = named(path), named(f"{new}.old")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = files.exists(target)
    if replaced and not files.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not files.rename(named(new), target):
        if replaced:
            files.rename(old, target)
        raise OSError(f"cannot move {new} to {path}")
    if replaced:
        files.delete(old, True)
