"""Source profiling: samples, column statistics, manifests, frozen categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.functions.timegrid import timestamp_literal
from relpoint.spec import CompressionGraph

HASH_DIGITS = 4


def stacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) pairs of the non-null values of several columns."""
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)
    )
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def ranked_values(df: DataFrame, columns: Sequence[str], k: int, threshold: int | None = None) -> DataFrame:
    """Top-k values per column by count, ties by value: (column, value, n, rank).

    With a threshold, columns with more distinct values are left out.
    """
    counts = stacked(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if threshold is not None:
        small = counts.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= threshold)
        counts = counts.join(F.broadcast(small.select("column")), "column", "left_semi")
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def columns_above(df: DataFrame, columns: Sequence[str], threshold: int) -> list[str]:
    """Columns with more distinct values than the threshold; exact.

    Where an approximate count is far above it, only values whose hash lies in a part of the range are
    counted: more than the threshold there prove more than the threshold in all. That part is chosen to hold some
    four times as many; should it not prove anything, all values are counted. So what is
    shuffled follows the threshold, not the values of free text.
    """
    if not columns:
        return []
    sizes = df.agg(*(F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(c) for c in columns)).first()
    steps = 1 << 20
    parts = {c: min(steps, max(1, steps * 4 * (threshold + 1) // max(sizes[c], 1))) for c in columns}
    above: list[str] = []
    open_ = list(columns)
    while open_:
        limit = F.create_map(*(F.lit(x) for c in open_ for x in (c, parts[c])))
        rows = stacked(df, open_).where(F.pmod(F.xxhash64("value"), F.lit(steps)) < limit[F.col("column")])
        counts = rows.groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        seen = {r["column"]: r["n"] for r in counts.collect()}  # one row a column
        found = [c for c in open_ if seen.get(c, 0) > threshold]
        above += found
        open_ = [c for c in open_ if c not in found and parts[c] < steps]
        parts = {c: steps for c in open_}
    return [c for c in columns if c in above]


def top_values(
    df: DataFrame, columns: Sequence[str], k: int, threshold: int | None
) -> tuple[dict[str, tuple[str, ...]], tuple[str, ...]]:
    """Frozen category values per column, and the columns left out for having too many.

    ``columns_above`` first rules out columns above the threshold, so that the values of free text are never
    shuffled. At most k values per column reach the driver.
    """
    out = () if threshold is None else tuple(columns_above(df, columns, threshold))
    left = [c for c in columns if c not in out]
    found: dict[str, list[str]] = {}
    rows = ranked_values(df, left, k).orderBy("column", "rank").collect() if left else []
    for row in rows:
        found.setdefault(row["column"], []).append(row["value"])
    return {c: tuple(v) for c, v in found.items()}, out


def visible_before(df: DataFrame, time_col: str | None, before: datetime) -> DataFrame:
    if time_col is None:
        return df
    return df.where(F.col(time_col) < timestamp_literal(before, df.schema[time_col].dataType))


def profile_sample(
    df: DataFrame, pk: str, time_col: str | None, before: datetime, rows: int
) -> DataFrame:
    """Reproducible sample of rows strictly before a cutoff: the smallest key hashes.

    A histogram over hash prefixes first finds how far the sample reaches. Only rows
    up to that prefix are sorted, so the final merge sees about the sample and not
    one sample per input partition.
    """
    if rows < 1:
        raise ValueError("sample size must be positive")
    df = visible_before(df, time_col, before)
    digest = F.md5(F.col(pk).cast("string"))
    prefix = F.substring(digest, 1, HASH_DIGITS)
    counts = df.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # At most 16 ** HASH_DIGITS rows enter this window.
    lower = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0)))
    last = reached.where(F.col("lower") < rows).agg(F.max("p")).scalar()
    return df.where(prefix <= last).orderBy(digest, F.col(pk)).limit(rows)


def column_statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """One aggregation over all columns, unpivoted to one row per column.

    Approximate distinct counts are exact about none, one and more than one value.
    """
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    if exact:
        # Counts per (column, value): one shuffle for all columns, unlike several
        # exact distinct counts in one aggregation.
        values = stacked(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        filled = values.groupBy("column").agg(
            F.sum("n").alias("filled"), F.count(F.lit(1)).alias("n_distinct")
        )
        total = df.agg(F.count(F.lit(1))).scalar()
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
        return every.join(filled, "column", "left").select(
            "column",
            total.alias("n_rows"),
            (total - F.coalesce(F.col("filled"), F.lit(0))).alias("n_null"),
            F.coalesce(F.col("n_distinct"), F.lit(0)).alias("n_distinct"),
        )
    for c in columns:
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"{c}__filled"))
        values = F.col(f"`{c}`")
        several = (F.min(values) != F.max(values)).cast("int")
        size = F.greatest(F.approx_count_distinct(values), F.lit(2))
        aggs.append(F.when(several == 1, size).when(F.count(values) > 0, 1).otherwise(0).alias(f"{c}__distinct"))
    flat = df.agg(*aggs)
    pairs = F.array(
        *(
            F.struct(
                F.lit(c).alias("column"),
                F.col("__rows").alias("n_rows"),
                (F.col("__rows") - F.col(f"{c}__filled")).alias("n_null"),
                F.col(f"{c}__distinct").alias("n_distinct"),
            )
            for c in columns
        )
    )
    return flat.select(F.inline(pairs))


@dataclass(frozen=True)
class ManifestSource:
    """What has to be known about a source before it is profiled."""

    pk: str
    time_col: str | None = None
    foreign_keys: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    cardinality_threshold: int = 1_000


def manifest(rows: DataFrame, source: ManifestSource, exact: bool = True) -> DataFrame:
    """Role of each column: key, time, numeric, categorical, flag or dropped.

    Keys and time stay in the graph whatever they hold. Constants, excluded columns
    and string columns above the cardinality threshold are dropped. ``exact`` concerns the distinct counts
    that are shown; roles are exact in both ways.
    """
    keys = {source.pk, *source.foreign_keys}
    types = {}
    for f in rows.schema:
        if isinstance(f.dataType, T.BooleanType):
            types[f.name] = "flag"
        elif isinstance(f.dataType, T.NumericType):
            types[f.name] = "numeric"
        elif isinstance(f.dataType, T.StringType):
            types[f.name] = "categorical"
        else:
            types[f.name] = "other"
    kind = F.create_map(*(F.lit(x) for pair in types.items() for x in pair))
    column = F.col("column")
    above = F.col("n_distinct") > source.cardinality_threshold
    if not exact:
        wanted = [c for c, kind_of in types.items() if kind_of == "categorical" and c not in keys | {source.time_col, *source.excluded}]
        above = column.isin(columns_above(rows, wanted, source.cardinality_threshold))
    role = (
        F.when(column.isin(*keys), "key")
        .when(column == F.lit(source.time_col or ""), "time")
        .when(column.isin(*source.excluded) if source.excluded else F.lit(False), "dropped")
        .when(F.col("n_distinct") <= 1, "dropped")
        .when((kind[column] == "categorical") & above, "dropped")
        .when(kind[column] == "other", "dropped")
        .otherwise(kind[column])
    )
    return column_statistics(rows, exact).withColumn("role", role)


def manifest_summary(manifest_df: DataFrame) -> DataFrame:
    """Counts of source, graph and feature columns."""
    role = F.col("role")
    return manifest_df.agg(
        F.count(F.lit(1)).alias("source"),
        F.count_if(role != "dropped").alias("graph"),
        F.count_if(~role.isin("dropped", "key", "time")).alias("features"),
    )


def manifest_columns(manifest_df: DataFrame) -> tuple[str, ...]:
    """Graph columns of a manifest. One row per source column reaches the driver."""
    return tuple(r["column"] for r in manifest_df.where(F.col("role") != "dropped").collect())


def with_manifests(
    graph: CompressionGraph,
    sources: Mapping[str, ManifestSource],
    before: datetime,
    role_sources: Mapping[str, str] | None = None,
) -> CompressionGraph:
    """Narrow relations to the columns their source profile keeps.

    Each source is profiled once, on all its rows before ``before``; roles that share a source
    (``role_sources``) share the profile. What is above the cardinality threshold is decided exactly. Relations without one stay as they are.
    """
    kept: dict[str, tuple[str, ...]] = {}
    relations = []
    for relation in graph.relations:
        name = (role_sources or {}).get(relation.name, relation.name)
        if name not in sources:
            relations.append(relation)
            continue
        source = sources[name]
        if name not in kept:
            rows = visible_before(relation.df, source.time_col, before)
            kept[name] = manifest_columns(manifest(rows, source, exact=False))
        relations.append(replace(relation, columns=tuple(c for c in relation.df.columns if c in kept[name])))
    return replace(graph, relations=tuple(relations))
