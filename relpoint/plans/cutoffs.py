"""Cutoff schedules and samplers. Schedules are plan-time lists; the DataFrame forms
derive them from the data."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relpoint.functions.timegrid import timestamp_literal

Item = TypeVar("Item")


def time_bounds(tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Smallest and largest timestamp over several tables, one row."""
    parts = [df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")) for df, t in tables]
    every = reduce(DataFrame.unionByName, parts)
    return every.agg(F.min("lo").alias("min_time"), F.max("hi").alias("max_time"))


def _steps(start: datetime, stop: datetime, step: timedelta) -> list[datetime]:
    count = (stop - start) // step if step > timedelta(0) else (start - stop) // -step
    return [start + i * step for i in range(count + 1)]


def split_cutoffs(
    split: str,
    validation: datetime,
    test: datetime,
    delta: timedelta,
    first: datetime,
    last: datetime,
    eval_count: int = 1,
) -> list[datetime]:
    """Ascending cutoffs of a split.

    Train walks back from one label window before validation; validation and test
    walk forward, never into the next split or past the data.
    """
    if split == "train":
        return sorted(_steps(validation - delta, first, -delta))
    if split == "val":
        return _steps(validation, min(validation + delta * (eval_count - 1), test - delta), delta)
    if split == "test":
        return _steps(test, min(test + delta * (eval_count - 1), last - delta), delta)
    raise ValueError(f"unknown split {split!r}")


def latest_train_cutoff(validation: datetime, delta: timedelta) -> datetime:
    return validation - delta


def schedule_frame(
    bounds: DataFrame, validation: datetime, test: datetime, delta_days: int, eval_count: int = 1
) -> DataFrame:
    """(split, cutoff) for all splits, derived from ``time_bounds`` without a driver trip."""
    step = F.expr(f"INTERVAL '{delta_days}' DAY")
    back = F.expr(f"INTERVAL '-{delta_days}' DAY")
    ahead = F.expr(f"INTERVAL '{delta_days * (eval_count - 1)}' DAY")
    v, t = timestamp_literal(validation), timestamp_literal(test)

    def walk(split: str, start: Column, stop: Column, by: Column) -> DataFrame:
        reachable = (start >= stop) if by is back else (start <= stop)
        times = F.when(reachable, F.sequence(start, stop, by))
        return bounds.select(F.lit(split).alias("split"), F.explode(times).alias("cutoff"))

    parts = [
        walk("train", v - step, F.col("min_time"), back),
        walk("val", v, F.least(v + ahead, t - step), step),
        walk("test", t, F.least(t + ahead, F.col("max_time") - step), step),
    ]
    return reduce(DataFrame.unionByName, parts)


def observed_cutoffs(task: DataFrame, time_col: str) -> DataFrame:
    """Distinct non-null timestamps of a task table."""
    return task.select(F.col(time_col).alias("cutoff")).where(F.col("cutoff").isNotNull()).distinct()


def outside_schedule(observed: DataFrame, schedule: DataFrame) -> DataFrame:
    """Observed cutoffs that the formal schedule does not contain (should be empty)."""
    return observed.join(schedule.select("cutoff"), "cutoff", "left_anti")


def single_cutoff_rows(task: DataFrame, time_col: str, split: str, wanted: datetime) -> DataFrame:
    """Rows at one cutoff; if it has none, the latest (train) or earliest one."""
    t = F.col(time_col)
    hit = timestamp_literal(wanted, task.schema[time_col].dataType)
    fallback = F.max(t) if split == "train" else F.min(t)
    chosen = task.agg(F.coalesce(F.max(F.when(t == hit, t)), fallback)).scalar()
    return task.where(t == chosen)


def stratified_sample(values: Sequence[datetime], limit: int) -> list[datetime]:
    """One cutoff per chronological stratum, that of the smallest hash; the newest is always kept.

    The same pick as ``sampled_schedule`` makes on a table.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    values, last, strata = sorted(values), len(values) - 1, limit - 1
    if len(values) <= limit:
        return values
    chosen: dict[int, tuple[str, datetime]] = {}
    for i, value in enumerate(values[:-1]):
        if strata:
            own = (hashlib.md5(f"{value:%Y-%m-%d %H:%M:%S}".encode()).hexdigest(), value)
            stratum = ((i + 1) * strata - 1) // last
            chosen[stratum] = min(own, chosen.get(stratum, own))
    return [value for _, (_, value) in sorted(chosen.items())] + [values[-1]]


def even_sample(values: Sequence[Item], limit: int | None) -> list[Item]:
    """Evenly spaced pick that keeps both ends (halves round to even)."""
    if limit is None or len(values) <= limit:
        return list(values)
    if limit < 2:
        raise ValueError("an even sample needs room for both ends")
    gap = (len(values) - 1) / (limit - 1)
    return [values[round(i * gap)] for i in range(limit)]


def stride_sample(values: Sequence[Item], stride: int, keep_last: bool = True) -> list[Item]:
    picked = list(values[::stride])
    if keep_last and values and (len(values) - 1) % stride:
        picked.append(values[-1])
    return picked


def sampled_schedule(schedule: DataFrame, limit: int, stride: int) -> DataFrame:
    """Marks which cutoffs each sampler keeps: ``stratified``, ``even``, ``strided``.

    A schedule has one row per cutoff, so its ordering is a small, bounded window.
    The stratified pick takes the smallest hash per stratum.
    """
    order = Window.orderBy("cutoff")
    ranked = schedule.select(
        "cutoff",
        (F.row_number().over(order) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    i, last, strata = F.col("i"), F.col("n") - 1, limit - 1
    stratum = F.when(i < last, F.floor(((i + 1) * strata - 1) / last))
    ranked = ranked.withColumn("stratum", stratum).withColumn(
        "h", F.md5(F.date_format("cutoff", "yyyy-MM-dd HH:mm:ss"))
    )
    pick = F.row_number().over(Window.partitionBy("stratum").orderBy("h"))
    short = F.col("n") <= limit
    spot = F.bround(F.bround(i * strata / last) * last / strata)
    return ranked.withColumn("pick", pick).select(
        "cutoff",
        (short | (i == last) | (F.col("pick") == 1)).cast("int").alias("stratified"),
        (short | (spot == i)).cast("int").alias("even"),
        ((i % stride == 0) | (i == last)).cast("int").alias("strided"),
    )
