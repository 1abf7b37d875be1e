"""Shared by the registered queries: tables, cutoffs and SQL building blocks.

Money columns are read as decimals: sums are then exact and do not depend on the
order in which partial results are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.sources.tables import load_tables

ORDER_CUTOFFS = (datetime(1999, 1, 1), datetime(2000, 1, 1), datetime(2001, 1, 1))
EVENT_CUTOFFS = (datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 22))
VALIDATION, TEST = datetime(2000, 1, 1), datetime(2001, 1, 1)
DELTA = timedelta(days=90)
WEEK = timedelta(days=7)

# Money columns of the driver tables.
MONEY = {
    "customer": ("c_acctbal",),
    "supplier": ("s_acctbal",),
    "part": ("p_retailprice",),
    "orders": ("o_totalprice",),
    "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "events": ("value",),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = load_tables(spark, folder, [name])[name]
    exact = {c: F.col(c).cast("decimal(12,2)") for c in MONEY.get(name, ())}
    return df.withColumns(exact) if exact else df


def rounded(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    """Round columns whose last bits depend on summation order. Adding 0 drops -0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def stamp(moment: datetime) -> str:
    return f"TIMESTAMP '{moment:%Y-%m-%d %H:%M:%S}'"


def cuts(cutoffs: Sequence[datetime]) -> str:
    rows = ", ".join(f"({stamp(c)})" for c in cutoffs)
    return f"cuts(cutoff) AS (VALUES {rows})"


def dec(column: str) -> str:
    return f"CAST({column} AS DECIMAL(12,2))"


def dsum(column: str, where: str | None = None) -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    return f"CAST(sum({dec(column)}){tail} AS DOUBLE)"


def davg(column: str, where: str | None = None) -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    return f"{dsum(column, where)} / NULLIF(count({column}){tail}, 0)"


def numeric_sql(column: str, prefix: str, stats: Sequence[str] = ("sum", "avg", "min", "max", "std")) -> str:
    """Base statistics of one numeric column as SQL select items."""
    name = f"{prefix}_{column}"
    parts = {
        "sum": f"{dsum(column)} AS {name}_sum",
        "avg": f"{davg(column)} AS {name}_avg",
        "min": f"CAST(min({dec(column)}) AS DOUBLE) AS {name}_min",
        "max": f"CAST(max({dec(column)}) AS DOUBLE) AS {name}_max",
        "std": f"round(stddev_pop({column}), 4) AS {name}_std",
    }
    return ", ".join(parts[s] for s in stats)


def recency_sql(time: str, prefix: str) -> str:
    return (
        f"date_diff('day', max({time}), cutoff) AS {prefix}_days_since_last, "
        f"date_diff('day', min({time}), cutoff) AS {prefix}_days_since_first, "
        f"date_diff('day', min({time}), max({time})) AS {prefix}_span_days"
    )


def zero(*columns: str, alias: str = "") -> str:
    """COALESCE(column, 0) items for count-like features."""
    return ", ".join(f"COALESCE({alias}{c}, 0) AS {c}" for c in columns)
