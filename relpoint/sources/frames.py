"""Feature frames at rest: one Parquet partition per cutoff."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.functions.scalars import amount_target
from relpoint.functions.timegrid import timestamp_literal


def write_frame(frame: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write partitioned by cutoff; an overwrite replaces only the cutoffs written.

    Rows are rebalanced by cutoff first: tasks then write few cutoffs each, and a
    cutoff too big for one task is split by AQE.
    """
    writer = frame.hint("rebalance", F.col("cutoff")).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("cutoff").parquet(path)


def read_frame(
    spark: SparkSession,
    path: str,
    cutoffs: Sequence[datetime] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read back with partition and column pruning."""
    df = spark.read.parquet(path)
    if cutoffs is not None:
        dtype = df.schema["cutoff"].dataType
        df = df.where(F.col("cutoff").isin(*(timestamp_literal(c, dtype) for c in cutoffs)))
    return df if columns is None else df.select(*columns)


def concat_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def frame_statistics(frame: DataFrame, target: str) -> DataFrame:
    """Rows, distinct targets and population deviation of the target (NULL counts as 0)."""
    return frame.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(target).alias("target_nunique"),
        F.stddev_pop(amount_target(F.col(target))).alias("target_std"),
    )
