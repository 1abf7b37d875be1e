"""Entity histories: latest record, bridge collapse, bounded star."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relpoint.functions.timegrid import CUT, FROM, PANE, TO, CutoffGrid


def latest_value(value: Column, *order: Column) -> Column:
    """Non-null value at the greatest order (time, then tie breakers)."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def latest_record(
    df: DataFrame, key: str, time_col: str, tie: str, columns: Sequence[str]
) -> DataFrame:
    """One row per key: the record with the greatest (time, tie). No window sort."""
    record = F.max(F.struct(F.col(time_col), F.col(tie), *(F.col(c) for c in columns if c not in (time_col, tie))))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(record.alias("__r")).select(key, "__r.*")


def latest_record_at(
    df: DataFrame, key: str, time_col: str, tie: str, columns: Sequence[str], grid: CutoffGrid
) -> DataFrame:
    """The latest visible record per key at every cutoff, folded per pane first."""
    record = F.struct(F.col(time_col), F.col(tie), *(F.col(c) for c in columns if c not in (time_col, tie)))
    dtype = df.schema[time_col].dataType
    located = grid.locate(df.where(F.col(key).isNotNull()), time_col)
    if grid.folds_first:
        located = located.groupBy(key, PANE, FROM, TO).agg(F.max(record).alias("__r"))
        record = F.col("__r")
    merged = grid.spread(located).groupBy(CUT, key).agg(F.max(record).alias("__r"))
    return merged.select(grid.stamp(dtype).alias("cutoff"), key, "__r.*")


def value_summary(
    df: DataFrame, key: str, modes: dict[str, Column], distinct: dict[str, Column] | None = None
) -> DataFrame:
    """Most frequent value (ties to the smallest) and number of distinct values per key and column.

    Values are counted per (key, column, value) first, so nothing holds the values of a key and several
    distinct counts don't multiply the rows. Keys without any value in these columns have no row.
    """
    columns = {**modes, **(distinct or {})}
    pairs = F.array(
        *(F.struct(F.lit(i).alias("__i"), v.cast("string").alias("__v")) for i, v in enumerate(columns.values()))
    )
    counts = (
        df.select(key, F.inline(pairs))
        .where(F.col("__v").isNotNull())
        .groupBy(key, "__i", "__v")
        .agg(F.count(F.lit(1)).alias("__m"))
    )
    best, sizes = [], []
    for i, name in enumerate(columns):
        mine = F.col("__i") == i
        if name in modes:
            best.append(F.min(F.when(mine, F.struct((-F.col("__m")).alias("__m"), F.col("__v")))).alias(name))
        else:
            sizes.append(F.count(F.when(mine, 1)).alias(name))
    found = counts.groupBy(key).agg(*best, *sizes)
    return found.select(key, *(F.col(f"{n}.__v").alias(n) for n in modes), *(distinct or {}))


def modes(df: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Most frequent value per key and column, ties to the smallest value."""
    return value_summary(df, key, columns)


def collapse_bridge(
    bridge: DataFrame,
    dimension: DataFrame,
    owner: str,
    link: str,
    link_pk: str,
    distinct: dict[str, Column],
    mode_columns: dict[str, Column] | None = None,
) -> DataFrame:
    """Many-to-many relation reduced to the owner's grain before anything fans out, in one pass.

    The owner counts as a value of its own, so that each one has a row.
    """
    joined = bridge.join(dimension, bridge[link] == dimension[link_pk], "left")
    summary = value_summary(joined, owner, mode_columns or {}, {**distinct, "__any": F.col(owner)})
    return summary.drop("__any")


def star(
    fact: DataFrame, base: DataFrame, key: str, summaries: Sequence[DataFrame]
) -> DataFrame:
    """Fact INNER base LEFT summaries, all one row per key.

    The key-grain sides are joined to each other first and only then to the fact,
    so the wide fact is shuffled once at most.
    """
    wide = base
    for summary in summaries:
        wide = wide.join(summary, key, "left")
    return fact.join(wide, key, "inner")
