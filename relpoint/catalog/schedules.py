"""Schedules derived from the data, samplers, surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import DELTA, TEST, VALIDATION, stamp, table
from relpoint.plans.cutoffs import (
    observed_cutoffs,
    outside_schedule,
    sampled_schedule,
    schedule_frame,
    single_cutoff_rows,
    time_bounds,
)
from relpoint.sources.tables import register_views


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    return time_bounds(
        [(table(spark, folder, "orders"), "o_orderdate"), (table(spark, folder, "lineitem"), "l_shipdate")]
    )


def schedule_train(spark: SparkSession, folder: str) -> DataFrame:
    days = DELTA.days
    return schedule_frame(_bounds(spark, folder), VALIDATION, TEST, days, 3).where("split = 'train'")


def schedule_eval(spark: SparkSession, folder: str) -> DataFrame:
    days = DELTA.days
    return schedule_frame(_bounds(spark, folder), VALIDATION, TEST, days, 3).where("split <> 'train'")


_BOUNDS = """SELECT min(lo) AS lo, max(hi) AS hi FROM (
  SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders
  UNION ALL SELECT min(l_shipdate), max(l_shipdate) FROM lineitem)"""

_TRAIN_SQL = f"""
SELECT 'train' AS split, unnest(generate_series({stamp(VALIDATION - DELTA)}, lo, INTERVAL '-90 days')) AS cutoff
FROM ({_BOUNDS})
"""

_EVAL_SQL = f"""
SELECT 'val' AS split, unnest(generate_series({stamp(VALIDATION)},
  least({stamp(VALIDATION)} + INTERVAL 180 DAY, {stamp(TEST)} - INTERVAL 90 DAY), INTERVAL 90 DAY)) AS cutoff
FROM ({_BOUNDS})
UNION ALL
SELECT 'test', unnest(generate_series({stamp(TEST)},
  least({stamp(TEST)} + INTERVAL 180 DAY, hi - INTERVAL 90 DAY), INTERVAL 90 DAY)) FROM ({_BOUNDS})
"""


def source_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Time range over several tables."""
    return _bounds(spark, folder)


def schedule_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samplers over the distinct order months."""
    orders = table(spark, folder, "orders")
    months = orders.select(F.to_date(F.date_format("o_orderdate", "yyyy-MM-01")).alias("d"))
    schedule = observed_cutoffs(months.select(F.col("d").cast("timestamp_ntz").alias("t")), "t")
    return sampled_schedule(schedule, 15, 10)


_SAMPLES_SQL = """
WITH s AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS cutoff FROM orders),
r AS (SELECT cutoff, row_number() OVER (ORDER BY cutoff) - 1 AS i, count(*) OVER () AS n FROM s),
b AS (SELECT *, CASE WHEN i < n - 1 THEN ((i + 1) * 14 - 1) // (n - 1) END AS stratum,
  md5(strftime(cutoff, '%Y-%m-%d %H:%M:%S')) AS h FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS pick FROM b)
SELECT cutoff,
  CASE WHEN n <= 15 OR i = n - 1 OR pick = 1 THEN 1 ELSE 0 END AS stratified,
  CASE WHEN n <= 15 OR i IN (SELECT CAST(round_even(g * (n0 - 1) / 14.0::DOUBLE, 0) AS BIGINT)
    FROM (SELECT count(*) AS n0 FROM s), generate_series(0, 14) t(g)) THEN 1 ELSE 0 END AS even,
  CASE WHEN i % 10 = 0 OR i = n - 1 THEN 1 ELSE 0 END AS strided
FROM p
"""


def observed_outside_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates that are no training cutoff: the containment check on real data."""
    dates = observed_cutoffs(table(spark, folder, "orders"), "o_orderdate")
    return outside_schedule(dates, schedule_frame(_bounds(spark, folder), VALIDATION, TEST, DELTA.days, 3))


_OUTSIDE_SQL = f"""
SELECT DISTINCT o_orderdate AS cutoff FROM orders WHERE o_orderdate NOT IN (
  SELECT cutoff FROM ({_TRAIN_SQL} UNION ALL {_EVAL_SQL}))
"""


def single_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one order date, with the fallback to the latest date."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    hit = single_cutoff_rows(orders, "o_orderdate", "train", VALIDATION - DELTA)
    missed = single_cutoff_rows(orders, "o_orderdate", "train", VALIDATION.replace(year=2030))
    return hit.withColumn("kind", F.lit("wanted")).unionByName(missed.withColumn("kind", F.lit("latest")))


_SINGLE_SQL = f"""
SELECT o_orderkey, o_orderdate, 'wanted' AS kind FROM orders WHERE o_orderdate = COALESCE(
  (SELECT max(o_orderdate) FROM orders WHERE o_orderdate = {stamp(VALIDATION - DELTA)}),
  (SELECT max(o_orderdate) FROM orders))
UNION ALL
SELECT o_orderkey, o_orderdate, 'latest' FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)
"""

_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def surrogate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Dense line ids over a total order, after dropping a column."""
    views = register_views(
        {"lineitem": spark.read.parquet(f"{folder}/lineitem.parquet").select(*_LINE_ORDER, "l_tax")},
        {"lineitem": "lineitem_src"},
        {"lineitem": ("line_id", _LINE_ORDER)},
        {"lineitem": ("l_tax",)},
    )
    return views["lineitem_src"]


_IDS_SQL = """
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS line_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
"""

QUERIES = {
    "schedule_train": schedule_train,
    "schedule_eval": schedule_eval,
    "source_bounds": source_bounds,
    "schedule_samples": schedule_samples,
    "observed_outside_schedule": observed_outside_schedule,
    "single_cutoff": single_cutoff,
    "surrogate_ids": surrogate_ids,
}

SQL = {
    "schedule_train": _TRAIN_SQL,
    "schedule_eval": _EVAL_SQL,
    "source_bounds": f"SELECT lo AS min_time, hi AS max_time FROM ({_BOUNDS})",
    "schedule_samples": _SAMPLES_SQL,
    "observed_outside_schedule": _OUTSIDE_SQL,
    "single_cutoff": _SINGLE_SQL,
    "surrogate_ids": _IDS_SQL,
}
