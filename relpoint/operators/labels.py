"""Labels from future windows, eligibility and existence filters.

All of them use the cutoff grid: events are folded per (key, pane) before any copy
per cutoff is made, so there is no range join between cutoffs and facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relpoint.functions.scalars import ratio
from relpoint.functions.timegrid import (
    FROM,
    PANE,
    TO,
    CutoffGrid,
    timestamp_literal,
)


SKETCH_BITS = 14


@dataclass(frozen=True)
class Measure:
    """count | sum | avg | nunique | sketch of a column inside the label window.

    ``sketch`` is a distinct count by a HyperLogLog sketch of 2^SKETCH_BITS registers, whose relative standard
    error is 1.04 / sqrt(2^SKETCH_BITS), 0.8 %. Sketches are merged per pane like sums.
    """

    name: str
    kind: str
    value: Column | None = None
    where: Column | None = None


def window_measures(
    events: DataFrame,
    key: str,
    time_col: str,
    cutoffs: Sequence[datetime],
    horizon: timedelta,
    measures: Sequence[Measure],
    past: bool = False,
) -> DataFrame:
    """(cutoff, key, measures) over events in ``(c, c + horizon]``, or ``(c - horizon, c]``.

    Only keys with at least one event in the window appear.
    """
    cutoffs = sorted(set(cutoffs))
    if past:
        grid = CutoffGrid(tuple(cutoffs), True, horizon.total_seconds() / 86_400)
    else:
        grid = CutoffGrid.future(cutoffs, horizon)
    dtype = events.schema[time_col].dataType
    located = grid.locate(events.where(F.col(key).isNotNull()), time_col)
    # Grouping by the timestamp itself keeps the partitioning usable for later joins.
    keys = ["cutoff", key]

    def spread(df: DataFrame) -> DataFrame:
        return grid.spread(df).withColumn("cutoff", grid.stamp(dtype, cutoffs))

    row_sums: dict[str, Column] = {"__n": F.lit(1).cast("bigint")}
    sketches: dict[str, Column] = {}
    for m in measures:
        if m.kind == "nunique":
            continue
        seen = F.lit(True) if m.where is None else F.coalesce(m.where, F.lit(False))
        if m.kind == "sketch":
            sketches[m.name] = F.hll_sketch_agg(F.when(seen, m.value), F.lit(SKETCH_BITS))
            continue
        value = F.lit(1).cast("bigint") if m.value is None else m.value
        row_sums[f"{m.name}__n"] = F.when(seen & value.isNotNull(), 1).otherwise(0).cast("bigint")
        if m.kind in ("sum", "avg"):
            row_sums[f"{m.name}__s"] = F.when(seen, value)
    cells = located
    if grid.folds_first:
        parts = [*(F.sum(c).alias(n) for n, c in row_sums.items()), *(c.alias(n) for n, c in sketches.items())]
        cells = located.groupBy(key, PANE, FROM, TO).agg(*parts)
        row_sums = {n: F.col(n) for n in row_sums}
        sketches = {n: F.hll_union_agg(n) for n in sketches}
    merged = spread(cells).groupBy(*keys).agg(
        *(F.sum(c).alias(n) for n, c in row_sums.items()),
        *(F.hll_sketch_estimate(c).alias(n) for n, c in sketches.items()),
    )

    for m in measures:
        if m.kind != "nunique":
            continue
        rows = located if m.where is None else located.where(m.where)
        named = rows.withColumn("__value", m.value).where(F.col("__value").isNotNull())
        # A value counts from its occurrence to its next one: no row per value and cutoff.
        once = named.select(key, PANE, FROM, TO, "__value").distinct()
        runs = grid.runs(once, [key, "__value"]).groupBy(key, FROM, TO).agg(F.count(F.lit(1)).alias("__m"))
        counted = spread(runs).groupBy(*keys).agg(F.sum("__m").alias(m.name))
        merged = merged.join(counted, keys, "left")

    out = []
    for m in measures:
        if m.kind in ("nunique", "sketch"):
            out.append(F.coalesce(F.col(m.name), F.lit(0)).cast("bigint").alias(m.name))
        elif m.kind == "count":
            out.append(F.col(f"{m.name}__n").alias(m.name))
        elif m.kind == "sum":
            out.append(F.col(f"{m.name}__s").alias(m.name))
        elif m.kind == "avg":
            out.append(ratio(F.col(f"{m.name}__s"), F.col(f"{m.name}__n")).alias(m.name))
        else:
            raise ValueError(f"unknown measure kind {m.kind!r}")
    return merged.select(*keys, *out)


def entity_cutoffs(
    entities: DataFrame, pk: str, cutoffs: Sequence[datetime], time_col: str | None = None
) -> DataFrame:
    """(cutoff, entity) for every entity that exists at the cutoff."""
    grid = CutoffGrid(tuple(sorted(set(cutoffs))), True)
    rows = entities.where(F.col(pk).isNotNull())
    if time_col is None:
        dtype = None
        rows = rows.select(pk).withColumns({FROM: F.lit(0), TO: F.lit(len(grid) - 1)})
    else:
        dtype = rows.schema[time_col].dataType
        rows = grid.locate(rows.select(pk, time_col), time_col)
    return grid.spread(rows).select(grid.stamp(dtype).alias("cutoff"), pk)


def label_table(
    keys: DataFrame, entity: str, measured: DataFrame, measured_key: str, zero: Sequence[str]
) -> DataFrame:
    """Left join measures to the wanted (cutoff, entity) keys; no event means 0."""
    right = measured.withColumnsRenamed({measured_key: "__entity", "cutoff": "__cutoff"})
    joined = keys.join(
        right, (keys["cutoff"] == right["__cutoff"]) & (keys[entity] == right["__entity"]), "left"
    ).drop("__entity", "__cutoff")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def eligible(
    events: DataFrame, key: str, time_col: str, cutoffs: Sequence[datetime], delta: timedelta
) -> DataFrame:
    """(cutoff, key) with at least one event in ``(c - delta, c]``."""
    return window_measures(events, key, time_col, cutoffs, delta, [], past=True)


Sources = Sequence[tuple[DataFrame, str, str]]


def first_seen(sources: Sources, name: str = "key") -> DataFrame:
    """(key, __first): first timestamp of a key in any source.

    Existence up to a cutoff needs nothing else, so each source shrinks to one row
    per key before the sources are combined.
    """
    firsts = [
        df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(name)).agg(F.min(t).alias("__first"))
        for df, k, t in sources
    ]
    if len(firsts) == 1:
        return firsts[0]
    return reduce(DataFrame.unionByName, firsts).groupBy(name).agg(F.min("__first").alias("__first"))


def active_by(
    sources: Sources, cutoffs: Sequence[datetime], inclusive: bool = True, name: str = "key"
) -> DataFrame:
    """(cutoff, key) with any earlier row in any source."""
    first = first_seen(sources, name)
    grid = CutoffGrid(tuple(sorted(set(cutoffs))), inclusive)
    dtype = first.schema["__first"].dataType
    return grid.spread(grid.locate(first, "__first")).select(grid.stamp(dtype).alias("cutoff"), name)


def keep_active(frame: DataFrame, entity: str, sources: Sources, inclusive: bool = True) -> DataFrame:
    """Existence filter: the entity has an earlier row in any source. One join on the key."""
    first = first_seen(sources, "__entity")
    seen, at = first["__first"], frame["cutoff"]
    earlier = (seen <= at) if inclusive else (seen < at)
    return frame.join(first, (frame[entity] == first["__entity"]) & earlier, "left_semi")


def drop_dangling(labels: DataFrame, entity: str, entities: DataFrame, pk: str) -> DataFrame:
    """Keep labels whose entity exists."""
    right = entities.select(F.col(pk).alias("__pk"))
    return labels.join(right, labels[entity] == right["__pk"], "left_semi")


def asof_flag(
    rows: DataFrame,
    row_time: str,
    signals: DataFrame,
    signal_time: str,
    keys: Sequence[tuple[str, str]],
    name: str,
) -> DataFrame:
    """1 if a signal with equal keys exists at or before the row's time, else 0.

    Existence only needs the earliest signal per key: an equality join on one row
    per key replaces the range join.
    """
    named = [f"__k{i}" for i in range(len(keys))]
    first = signals.groupBy(*(F.col(s).alias(n) for (_, s), n in zip(keys, named))).agg(
        F.min(signal_time).alias("__seen")
    )
    condition = reduce(
        lambda a, b: a & b, [rows[r] == first[n] for (r, _), n in zip(keys, named)]
    )
    joined = rows.join(first, condition, "left").drop(*named)
    flag = F.when(F.col("__seen") <= F.col(row_time), 1).otherwise(0)
    return joined.withColumn(name, flag).drop("__seen")


def outside_unit(labels: DataFrame, target: str) -> DataFrame:
    """Number of fractional targets that are missing, not finite or outside [0, 1]."""
    x = F.col(target).cast("double")
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return labels.agg(F.count_if(bad).alias("violations"))


def before(df: DataFrame, time_col: str, moment: datetime, inclusive: bool = False) -> DataFrame:
    """Visibility filter with a literal of the column's own type (pushed to the scan)."""
    bound = timestamp_literal(moment, df.schema[time_col].dataType)
    return df.where(F.col(time_col) <= bound if inclusive else F.col(time_col) < bound)
