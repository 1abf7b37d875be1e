"""Order-dependent results without a single-task sort.

A running total needs an order over all rows. Values are first aggregated to
distinct order values, then cut into slices by approximate quantiles. Any monotone
slicing gives the exact result; the quantiles only decide how even the slices are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relpoint.session import reliable

#: Slices at least; more where the session shuffles into more partitions.
SLICES = 64


def slices_of(df: DataFrame) -> int:
    return max(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sliced_by(df: DataFrame, order: str, slices: int | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Add a monotone ``__slice`` of a numeric column, balanced over its values.

    ``seen`` may name a cheaper table with the same column to take quantiles from.
    """
    slices = slices or slices_of(df)
    steps = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    source = df if seen is None else seen
    bounds = source.select(F.percentile_approx(F.col(order).cast("double"), steps, F.lit(10_000))).scalar()
    x = F.col("__x")

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        above = F.get(F.col("__bounds"), F.lit(mid)) < x
        return F.when(above, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    ready = df.withColumns({"__bounds": bounds, "__x": F.col(order).cast("double")})
    return ready.withColumn("__slice", tree(0, slices - 1)).drop("__bounds", "__x")


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    values: Sequence[str],
    slices: int | None = None,
    seen: DataFrame | None = None,
) -> DataFrame:
    """Add ``<value>_before``, the sum over smaller orders of the group, and ``<value>_total``.

    ``order`` must be numeric and unique within a group. A group is never sorted in
    one task; only its slice totals are.
    """
    sliced = sliced_by(df, order, slices, seen)
    keys = list(groups)
    totals = sliced.groupBy(*keys, "__slice").agg(*(F.sum(v).alias(v) for v in values))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    lower = whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "__slice",
        *(F.coalesce(F.sum(v).over(lower), F.lit(0)).alias(f"__off_{v}") for v in values),
        *(F.sum(v).over(whole).alias(f"{v}_total") for v in values),
    )
    inner = (
        Window.partitionBy(*keys, "__slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.withColumns(
        {f"__loc_{v}": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values}
    )
    joined = local.join(offsets, [*keys, "__slice"])
    return joined.select(
        *df.columns,
        *((F.col(f"__loc_{v}") + F.col(f"__off_{v}")).alias(f"{v}_before") for v in values),
        *(f"{v}_total" for v in values),
    )


def running_share(
    df: DataFrame, groups: Sequence[str], order: str, weight: str, name: str, seen: DataFrame | None = None
) -> DataFrame:
    """Share of the group's weight at or below each order value (cumulative distribution)."""
    before = running_totals(df, groups, order, [weight], seen=seen)
    reached = (F.col(f"{weight}_before") + F.col(weight)).cast("double")
    return before.select(*groups, order, (reached / F.col(f"{weight}_total").cast("double")).alias(name))


def with_row_id(df: DataFrame, order_by: Sequence[str], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Dense 1-based ids over a total order.

    The rows are range partitioned on the full order, so even one heavy leading
    value spreads over partitions. The layout is stored before it is counted: a
    lost executor must not be able to move a row between partitions afterwards.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order_by).withColumn("__part", F.spark_partition_id())
    ranged = reliable(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range partition, so this side is bounded by ``parts``.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    local = Window.partitionBy("__part").orderBy(*order_by)
    numbered = ranged.withColumn("__local", F.row_number().over(local))
    return numbered.join(F.broadcast(offsets), "__part").select(
        (F.col("__offset") + F.col("__local")).alias(name), *df.columns
    )
