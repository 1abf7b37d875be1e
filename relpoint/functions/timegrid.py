"""Cutoff grids: which cutoffs see a row, without copying the row per cutoff.

All window edges of all cutoffs are sorted once. They split time into panes, and
every row falls into exactly one pane. A cutoff (and every lookback window of it)
is a run of whole panes, so a fact can be aggregated per (key, pane) first and
only those small partial results are handed to the cutoffs that see them.

The grid is plan-time data (one entry per cutoff and window) and becomes constant
arrays in the plan; no join against a cutoff table is needed.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANE, FROM, TO, CUT, UNTIL = "__pane", "__from", "__to", "__cut", "__until"

# Up to this many copies per row, copying before the (map-side combined) aggregation
# is cheaper than a separate aggregation per pane and its extra shuffle.
FEW_COPIES = 4
# Edges on day boundaries are found by a day-indexed array up to this span; beyond
# it (or for finer edges) a binary decision tree over the edges is used instead.
MAX_DAY_TABLE = 65_536
# Up to this many cutoffs the changes of a key are the bits of one long (its sign is left alone).
MASK_BITS = 62


def int_array(values: Sequence[int]) -> Column:
    """Constant array column, built from one string so that planning stays cheap."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def timestamp_literal(value: datetime, dtype: T.DataType | None = None) -> Column:
    """Literal of the same timestamp type as the column, so that filters push down."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(dtype, T.TimestampType):
        return F.expr(f"TIMESTAMP_LTZ '{text}'")
    if isinstance(dtype, T.DateType):
        return F.expr(f"DATE '{value:%Y-%m-%d}'")
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def timestamp_array(values: Sequence[datetime], dtype: T.DataType | None = None) -> Column:
    kind = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
    text = ",".join(v.strftime("%Y-%m-%d %H:%M:%S.%f") for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def epoch_micros(t: Column) -> Column:
    """Microseconds since 1970 of the wall-clock value, free of the session time zone."""
    days = F.datediff(t.cast("date"), F.lit(date(1970, 1, 1))).cast("bigint")
    seconds = (F.extract(F.lit("SECOND"), t) * F.lit(1_000_000)).cast("bigint")
    minutes = F.hour(t).cast("bigint") * 60 + F.minute(t)
    return (days * 1440 + minutes) * F.lit(60_000_000) + seconds


@dataclass(frozen=True)
class CutoffGrid:
    """Sorted cutoffs plus the lookback windows (days) that are asked for at each.

    ``inclusive`` decides the boundary: visible rows satisfy ``t <= cutoff`` or
    ``t < cutoff``. A window of w days is ``(c-w, c]`` or ``[c-w, c)`` accordingly.
    """

    cutoffs: tuple[datetime, ...]
    inclusive: bool = False
    lookback_days: float | None = None
    windows: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not self.cutoffs:
            raise ValueError("at least one cutoff is required")
        if any(b <= a for a, b in zip(self.cutoffs, self.cutoffs[1:])):
            raise ValueError("cutoffs must be distinct and sorted")

    @classmethod
    def future(cls, cutoffs: Sequence[datetime], horizon: timedelta) -> CutoffGrid:
        """Grid of the label windows ``(c, c + horizon]``."""
        return cls(
            tuple(c + horizon for c in cutoffs), True, horizon.total_seconds() / 86_400
        )

    def __len__(self) -> int:
        return len(self.cutoffs)

    def _floor(self, cutoff: datetime, days: float) -> datetime:
        return cutoff - timedelta(days=days)

    @property
    def edges(self) -> list[datetime]:
        found = set(self.cutoffs)
        spans = list(self.windows) + ([] if self.lookback_days is None else [self.lookback_days])
        for days in spans:
            found.update(self._floor(c, days) for c in self.cutoffs)
        return sorted(found)

    def _window_floor(self, days: float) -> list[int]:
        edges = self.edges
        floors = [self._floor(c, days) for c in self.cutoffs]
        if not set(floors) <= set(edges):
            raise ValueError(f"the grid was not built with a window of {days} days")
        return [bisect.bisect_left(edges, f) for f in floors]

    def ranges(self) -> tuple[list[int], list[int]]:
        """First and last cutoff ordinal that sees each pane."""
        edges = self.edges
        high = [bisect.bisect_left(edges, c) for c in self.cutoffs]
        low = [-1] * len(high) if self.lookback_days is None else self._window_floor(self.lookback_days)
        first = [bisect.bisect_left(high, p) for p in range(len(edges) + 1)]
        last = [bisect.bisect_left(low, p) - 1 for p in range(len(edges) + 1)]
        return first, last

    @property
    def copies(self) -> int:
        """Largest number of cutoffs that see one row."""
        return max(b - a + 1 for a, b in zip(*self.ranges()))

    @property
    def folds_first(self) -> bool:
        """Whether partial results per pane pay off before they are copied."""
        return self.copies > FEW_COPIES

    def pane(self, t: Column, dtype: T.DataType | None = None) -> Column:
        """Number of edges the row lies behind."""
        edges = self.edges
        span = (edges[-1] - edges[0]).days
        if span <= MAX_DAY_TABLE and all(e.time() == datetime.min.time() for e in edges):
            offsets = [(e - edges[0]).days for e in edges]
            table = [0] + [bisect.bisect_right(offsets, d) for d in range(span + 1)]
            day = F.datediff(t.cast("date"), F.lit(edges[0].date()))
            if self.inclusive:
                kind = "timestamp" if isinstance(dtype, T.TimestampType) else "timestamp_ntz"
                day = day - (t == t.cast("date").cast(kind)).cast("int")
            slot = F.least(F.greatest(day + 1, F.lit(0)), F.lit(span + 1))
            return F.element_at(int_array(table), slot + 1)
        return self._tree(t, edges, 0, len(edges), dtype)

    def _tree(self, t: Column, edges: list[datetime], lo: int, hi: int, dtype) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = timestamp_literal(edges[mid], dtype)
        behind = (t > bound) if self.inclusive else (t >= bound)
        return F.when(behind, self._tree(t, edges, mid + 1, hi, dtype)).otherwise(
            self._tree(t, edges, lo, mid, dtype)
        )

    def bounds(self, t: Column, dtype: T.DataType | None = None) -> Column:
        """Literal time range of all cutoffs together; reaches the Parquet scan."""
        top = timestamp_literal(self.cutoffs[-1], dtype)
        keep = (t <= top) if self.inclusive else (t < top)
        if self.lookback_days is not None:
            floor = timestamp_literal(self._floor(self.cutoffs[0], self.lookback_days), dtype)
            keep = keep & ((t > floor) if self.inclusive else (t >= floor))
        return keep

    def locate(self, df: DataFrame, time_col: str, entered: str | None = None) -> DataFrame:
        """Add pane and cutoff range; drop rows that no cutoff sees.

        ``entered`` names an earlier timestamp that must lie inside the lookback
        too (used for gaps, whose two end points must both be visible).
        """
        t, dtype = F.col(time_col), df.schema[time_col].dataType
        first, last = self.ranges()
        df = df.where(self.bounds(t, dtype)).withColumn(PANE, self.pane(t, dtype))
        if len(self) == 1 and entered is None:
            return df.withColumn(FROM, F.lit(0)).withColumn(TO, F.lit(0))
        floor_pane = F.col(PANE) if entered is None else self.pane(F.col(entered), dtype)
        located = df.withColumns(
            {
                FROM: F.element_at(int_array(first), F.col(PANE) + 1),
                TO: F.element_at(int_array(last), floor_pane + 1),
            }
        )
        # Without holes between windows the literal bounds above already decide.
        holes = any(first[p] > last[p] for p in range(self.lookback_days is not None, len(first)) if first[p] < len(self))
        if entered is None and not holes:
            return located
        return located.where(F.col(FROM) <= F.col(TO))

    def entry(self, t: Column, dtype: T.DataType | None = None) -> Column:
        """Ordinal of the first cutoff that sees ``t``, whatever the lookback; the number of cutoffs if none does."""
        first = F.element_at(int_array(self.ranges()[0]), self.pane(t, dtype) + 1)
        return F.when(t.isNull(), F.lit(len(self))).otherwise(first)

    def spread(self, located: DataFrame) -> DataFrame:
        """One copy per cutoff that sees the row or partial result."""
        if len(self) == 1:
            return located.withColumn(CUT, F.lit(0))
        if self.copies == 1:
            return located.withColumn(CUT, F.col(FROM))
        return located.withColumn(CUT, F.explode(F.sequence(F.col(FROM), F.col(TO))))

    def spread_steps(self, cells: DataFrame, key: str, entries: Sequence[str] = ()) -> DataFrame:
        """One copy per cutoff at which something of the key changes, valid up to ``UNTIL``.

        Changes are where a cell begins or ends and the cutoffs ``entries`` name. Cells are partial results,
        so the window holds at most one row per pane, or pair of panes, of the key.
        """
        last = len(self) - 1
        changes = [F.col(c) for c in (FROM, *entries)] + [F.col(TO) + 1]
        if last < MASK_BITS:
            return self._spread_bits(cells, key, changes)
        found = F.flatten(F.collect_set(F.array(*changes)).over(Window.partitionBy(key)))
        steps = F.array_sort(F.filter(F.array_distinct(found), lambda c: c <= last))
        cells = cells.withColumn("__found", steps)
        at = F.col("__found")
        runs = F.transform(
            at, lambda c, i: F.struct(c.alias(CUT), F.coalesce(F.get(at, i + 1) - 1, F.lit(last)).alias(UNTIL))
        )
        mine = F.filter(runs, lambda r: (r[CUT] >= F.col(FROM)) & (r[CUT] <= F.col(TO)))
        return cells.select(*(c for c in cells.columns if c != "__found"), F.inline(mine))

    def _spread_bits(self, cells: DataFrame, key: str, changes: Sequence[Column]) -> DataFrame:
        """The same with a key's changes as the bits of one long: no set or array is built per key."""
        last, one = len(self) - 1, F.lit(1).cast("bigint")
        # The changes past the last cutoff share a bit that isn't looked at.
        bits = [F.call_function("shiftleft", one, F.least(c, F.lit(last + 1))) for c in changes]
        found = F.bit_or(fold(lambda a, b: a.bitwiseOR(b), bits)).over(Window.partitionBy(key))
        cells = cells.withColumn("__found", found.bitwiseAND(F.lit((1 << last + 1) - 1)))
        copies = cells.select("*", F.explode(F.sequence(F.col(FROM), F.col(TO))).alias(CUT))
        copies = copies.where(F.call_function("shiftright", F.col("__found"), F.col(CUT)).bitwiseAND(one) == 1)
        later = F.call_function("shiftright", F.col("__found"), F.col(CUT) + 1)
        # Cutoffs between this change and the next: zeros below the lowest bit that is set.
        ahead = F.bit_count(later.bitwiseAND(-later) - 1)
        until = F.when(later == 0, F.lit(last)).otherwise(F.col(CUT) + ahead.cast("int"))
        return copies.withColumn(UNTIL, until).drop("__found")

    def runs(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Located rows as runs of cutoffs that don't overlap within ``keys``: (keys, from, to).

        Ranges of cutoffs grow with the pane, so each of a key's rows ends where the next one begins. What
        counts once per key and cutoff, like a distinct value, is then a plain sum over runs. The rows have
        to be distinct in keys and pane; a window holds at most one row per pane.
        """
        later = F.lead(FROM).over(Window.partitionBy(*keys).orderBy(PANE))
        until = F.least(F.col(TO), F.coalesce(later - 1, F.col(TO)))
        return rows.select(*keys, FROM, until.alias(TO)).where(F.col(FROM) <= F.col(TO))

    def in_window(self, days: int) -> Column:
        """Condition on (pane, cutoff ordinal): inside the last ``days`` days."""
        floor = self._window_floor(days)
        if len(floor) == 1:
            return F.col(PANE) > floor[0]
        return F.col(PANE) > F.element_at(int_array(floor), F.col(CUT) + 1)

    def sees(self, t: Column, dtype: T.DataType | None = None) -> Column:
        """Condition on a spread row: ``t`` is visible at the row's cutoff."""
        stamp = self.stamp(dtype)
        return (t <= stamp) if self.inclusive else (t < stamp)

    def stamp(self, dtype: T.DataType | None = None, labels: Sequence[datetime] | None = None) -> Column:
        """Timestamp of the row's cutoff ordinal."""
        values = self.cutoffs if labels is None else labels
        return F.element_at(timestamp_array(values, dtype), F.col(CUT) + 1)
