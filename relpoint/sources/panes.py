"""Pane store: facts folded per key and pane on disk, so that a new cutoff reads partial results only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.functions.scalars import ratio
from relpoint.functions.timegrid import CUT, CutoffGrid
from relpoint.operators.reduce import KEY, Atoms, Scope

ORIGIN = datetime(1970, 1, 1)


@dataclass(frozen=True)
class PaneStore:
    """Table of partial results per (key, pane), bucketed and sorted by key.

    A pane is ``days`` long. New facts are folded and appended; those that arrive late are one more partial
    result of an old pane, so nothing is rewritten and no fact is read again. Cutoffs and windows have
    to lie on pane edges, rows before the cutoff are visible. With a ``path`` the table outlives the session; columns,
    pane length and buckets must then stay.
    """

    spark: SparkSession
    name: str
    key: str
    time: str
    columns: tuple[str, ...]
    days: int = 1
    buckets: int = 8
    path: str | None = None

    def fold(self, facts: DataFrame) -> DataFrame:
        """One row per key and pane; rows without key or time belong to none."""
        pane = F.floor(F.datediff(F.col(self.time).cast("date"), F.lit(ORIGIN.date())) / self.days).cast("int")
        aggs = [F.count(F.lit(1)).alias("n"), F.min(self.time).alias("first"), F.max(self.time).alias("last")]
        for x in self.columns:
            value = F.col(x)
            aggs += [
                F.count(value).alias(f"{x}__n"),
                F.sum(value).alias(f"{x}__s"),
                F.min(value).alias(f"{x}__lo"),
                F.max(value).alias(f"{x}__hi"),
                F.var_pop(value.cast("double")).alias(f"{x}__v"),
            ]
        rows = facts.where(F.col(self.key).isNotNull() & F.col(self.time).isNotNull())
        return rows.groupBy(self.key, pane.alias("pane")).agg(*aggs)

    def _append(self, partials: DataFrame, name: str, path: str | None) -> None:
        writer = partials.repartition(self.buckets, self.key).write.format("parquet").mode("append")
        writer = writer.bucketBy(self.buckets, self.key).sortBy(self.key, "pane")
        writer.saveAsTable(name, **({"path": path} if path else {}))

    def add(self, facts: DataFrame) -> None:
        """Fold new facts and append them. An append commits as a whole or not at all."""
        self._append(self.fold(facts), self.name, self.path)

    def partials(self) -> DataFrame:
        return self.spark.table(self.name)

    def compact(self, name: str, path: str | None = None) -> PaneStore:
        """A store with one row per key and pane, as if all facts had come at once."""
        atoms, same = self._atoms(()), [self.key, "pane"]
        merged = atoms.merge(self.partials(), same, ["first", "last"])
        new = PaneStore(self.spark, name, self.key, self.time, self.columns, self.days, self.buckets, path)
        new._append(merged, name, path)
        return new

    def _atoms(self, windows: Sequence[int]) -> Atoms:
        atoms = Atoms()
        atoms.need("n", F.col("n"))
        for x in self.columns:
            for part, merge in (("n", "sum"), ("s", "sum"), ("lo", "min"), ("hi", "max")):
                atoms.need(f"{x}__{part}", F.col(f"{x}__{part}"), merge)
                for w in windows if part in ("n", "s") else ():
                    atoms.need(f"{x}__{part}", F.col(f"{x}__{part}"), merge, w)
            atoms.deviation(x)
        for w in windows:
            atoms.need("n", F.col("n"), "sum", w)
        return atoms

    def _check(self, cutoffs: Sequence[datetime], windows: Sequence[int]) -> None:
        for c in cutoffs:
            if (c - ORIGIN) % timedelta(days=self.days):
                raise ValueError(f"cutoff {c} does not lie on an edge of panes of {self.days} days")
        for w in windows:
            if w % self.days:
                raise ValueError(f"a window of {w} days is not made of panes of {self.days} days")

    def features(
        self, cutoffs: Sequence[datetime], windows: Sequence[int] = (), lookback_days: int | None = None
    ) -> DataFrame:
        """(cutoff, key, n_rows, statistics of the columns, first and last time) from partial results.

        Keys without a visible row have none. The table's buckets serve the merge, so nothing is shuffled.
        """
        cutoffs = sorted(set(cutoffs))
        self._check(cutoffs, [*windows, *([] if lookback_days is None else [lookback_days])])
        grid = CutoffGrid(tuple(cutoffs), False, lookback_days, tuple(windows))
        start = F.date_add(F.lit(ORIGIN.date()), F.col("pane") * self.days).cast("timestamp_ntz")
        rows = self.partials().withColumn("__start", start).withColumnRenamed(self.key, KEY)
        atoms = self._atoms(windows)
        atoms.need("first", F.col("first"), "min")
        atoms.need("last", F.col("last"), "max")
        merged = atoms.combine(grid.locate(rows, "__start"), Scope(grid, "__start", True))
        out = [F.col("n").alias("n_rows")]
        for x in self.columns:
            n, s = F.col(f"{x}__n"), F.col(f"{x}__s")
            out += [s.alias(f"{x}_sum"), ratio(s, n).alias(f"{x}_avg"), F.col(f"{x}__lo").alias(f"{x}_min")]
            out += [F.col(f"{x}__hi").alias(f"{x}_max"), F.col(f"{x}__std").alias(f"{x}_std")]
        for w in windows:
            out.append(F.coalesce(F.col(f"n__{w}"), F.lit(0)).alias(f"n_rows_{w}d"))
            for x in self.columns:
                out.append(F.col(f"{x}__s__{w}").alias(f"{x}_sum_{w}d"))
        out += [F.col("first").alias("first_time"), F.col("last").alias("last_time")]
        return merged.select(grid.stamp().alias("cutoff"), F.col(KEY).alias(self.key), *out)
