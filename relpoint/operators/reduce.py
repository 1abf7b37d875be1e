"""Reduce edges: one child relation compressed to its parent's key at every cutoff.

Decomposable statistics are computed once per (key, pane) and merged per (cutoff,
key). Distinct values, modes and concentrations go through counts per (key, value),
so no task ever holds the values of one key. Everything is hash aggregation with
map-side combine; a key that owns a third of the rows collapses to at most one row
per pane before it is shuffled by key alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.functions.scalars import day_difference, ratio
from relpoint.functions.timegrid import CUT, FEW_COPIES, FROM, PANE, TO, UNTIL, CutoffGrid, epoch_micros
from relpoint.spec import Relation

KEY = "__key"
DAY_MICROS = 86_400_000_000.0
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
WORD = "[^ \\t\\n\\r]+"
# Rows of peer groups are counted in so many hash buckets. The groups of a bucket with more rows than this, and so
# many times the mean, don't meet in one task.
PEER_BUCKETS, HEAVY_ROWS, HEAVY_TIMES = 4096, 100_000, 8


@dataclass(frozen=True)
class Feature:
    """Output column. Counts are 0 without rows; everything else stays NULL."""

    name: str
    kind: str = "value"  # count | value | text


@dataclass(frozen=True)
class Reduction:
    """Features per key, or per (cutoff ordinal, key) when ``timed``.

    With ``steps`` there are rows only where something of the key changes; each holds up to its ``UNTIL``.
    """

    df: DataFrame
    features: tuple[Feature, ...]
    timed: bool
    steps: bool = False

    @property
    def on(self) -> list[str]:
        return [CUT, KEY] if self.timed else [KEY]

    def join(self, other: Reduction) -> Reduction:
        return Reduction(
            self.df.join(other.df, self.on, "left"), self.features + other.features, self.timed
        )


@dataclass(frozen=True)
class ColumnPlan:
    """Frozen column roles of one relation (prefixed names)."""

    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    left_out: tuple[str, ...] = ()

    def merged(self, other: ColumnPlan) -> ColumnPlan:
        return ColumnPlan(
            self.numeric + other.numeric,
            self.categorical + other.categorical,
            self.flags + other.flags,
            self.text + other.text,
            {**self.categories, **other.categories},
            self.left_out + other.left_out,
        )


@dataclass(frozen=True)
class Scope:
    """Time handling of one reduction: static, expanded or bucketed, the latter also in steps."""

    grid: CutoffGrid | None
    time_col: str | None
    bucket: bool
    masks: dict[str, str] = field(default_factory=dict)
    steps: bool = False

    @classmethod
    def of(cls, grid: CutoffGrid, time_col: str | None, strategy: str, masks: dict[str, str] | None = None) -> Scope:
        if time_col is None and not masks:
            return cls(None, None, False)
        # Without a clock of its own, looked-up columns still appear over time.
        folds = cls.folds_wide if masks else cls.folds
        return cls(grid, time_col, folds(grid, time_col, strategy), masks or {})

    @staticmethod
    def folds(grid: CutoffGrid, time_col: str | None, strategy: str) -> bool:
        """Whether rows are folded before they are copied to cutoffs."""
        copied = grid.folds_first if time_col else len(grid) > FEW_COPIES
        return strategy == "bucket" or (strategy == "auto" and copied)

    @classmethod
    def folds_wide(cls, grid: CutoffGrid, time_col: str | None, strategy: str) -> bool:
        """The same for rows that carry looked-up values: two copies of their values already cost more than cells."""
        return cls.folds(grid, time_col, strategy) or (strategy == "auto" and grid.copies > 1)

    @property
    def timed(self) -> bool:
        return self.grid is not None

    @property
    def out_keys(self) -> list[str]:
        if self.steps:
            return [CUT, UNTIL, KEY]
        return [CUT, KEY] if self.timed else [KEY]

    @property
    def entries(self) -> dict[str, str]:
        """For each clock of looked-up rows, the column of the first cutoff that sees both rows."""
        return {c: f"__entry{i}" for i, c in enumerate(dict.fromkeys(self.masks.values()))}

    @property
    def cell_keys(self) -> list[str]:
        """A cell is two-sided: the row's own pane, and where looked-up values enter."""
        return [KEY, PANE, FROM, TO, *self.entries.values()]

    def located(self, rows: DataFrame) -> DataFrame:
        if not self.timed:
            return rows
        if self.time_col is None:
            found = rows.withColumns({PANE: F.lit(0), FROM: F.lit(0), TO: F.lit(len(self.grid) - 1)})
        else:
            found = self.grid.locate(rows, self.time_col)
        if not self.bucket:
            return found
        return found.withColumns(
            {
                name: F.greatest(FROM, self.grid.entry(F.col(seen_at), rows.schema[seen_at].dataType))
                for seen_at, name in self.entries.items()
            }
        )

    def entry(self, column: str) -> Column:
        """First cutoff at which a located row shows the column."""
        return F.col(self.entries[self.masks[column]]) if column in self.masks and self.bucket else F.col(FROM)

    def shows(self, columns: Sequence[str]) -> Column | None:
        """Condition on a cell's copy: all of the columns are visible. None: they always are."""
        wanted = dict.fromkeys(self.entries[self.masks[c]] for c in columns if c in self.masks)
        return fold(lambda a, b: a & b, [F.col(e) <= F.col(CUT) for e in wanted]) if wanted else None

    def spread(self, located: DataFrame) -> DataFrame:
        """Copies per cutoff; looked-up columns not yet visible there become NULL.

        Cells have no such columns any more: their sums are masked where they are merged.
        """
        if not self.timed:
            return located
        if self.steps:
            return self.grid.spread_steps(located, KEY, [e for e in self.entries.values() if e in located.columns])
        rows = self.grid.spread(located)
        for column, seen_at in () if self.bucket else self.masks.items():
            visible = self.grid.sees(F.col(seen_at), rows.schema[seen_at].dataType)
            rows = rows.withColumn(column, F.when(visible, F.col(column)))
        return rows

    def gathered(self, cells: DataFrame, *extra: str) -> DataFrame:
        """Cells by key before they are copied: copies are then folded where they are made and never shuffled.

        A key has at most one cell per pane, or pair of panes, whatever its row count.
        """
        return cells.repartition(KEY, *extra) if self.bucket and self.timed and not self.steps else cells

    def counted(
        self, rows: DataFrame, extra: Sequence[str], sums: dict[str, Column], uses: dict[str, str]
    ) -> DataFrame:
        """Sums per (cutoff, key, extra columns) through per-pane partial sums; ``uses`` names each sum's column."""
        located = self.located(rows)
        if self.bucket:
            located = located.groupBy(*self.cell_keys, *extra).agg(
                *(F.sum(c).alias(n) for n, c in sums.items())
            )
            located = self.gathered(located, *extra)
            shown = {n: self.shows([uses[n]]) for n in sums}
            sums = {n: F.col(n) if shown[n] is None else F.when(shown[n], F.col(n)) for n in sums}
        return self.spread(located).groupBy(*self.out_keys, *extra).agg(
            *(F.sum(c).alias(n) for n, c in sums.items())
        )


def slug(value: str) -> str:
    return re.sub(r"\W+", "_", value.strip().lower()).strip("_") or "blank"


def slugs(values: Sequence[str]) -> dict[str, str]:
    """Distinct column-name parts for category values."""
    names: dict[str, str] = {}
    for value in values:
        name, n = slug(value), 2
        while name in names.values():
            name, n = f"{slug(value)}_{n}", n + 1
        names[value] = name
    return names


class Atoms:
    """Named partial aggregates and the windows they are needed for."""

    def __init__(self) -> None:
        self.rows: dict[str, tuple[Column, str]] = {}
        self.uses: dict[str, tuple[Sequence[str], Column | None]] = {}
        self.windows: dict[str, set[int]] = {}
        self.deviations: list[str] = []

    def need(
        self,
        name: str,
        row: Column,
        merge: str = "sum",
        window: int | None = None,
        uses: Sequence[str] = (),
        hidden: int | None = None,
    ) -> Column:
        """``uses``: columns the row's part depends on; ``hidden``: its part where one of them is not visible."""
        self.rows.setdefault(name, (row, merge))
        self.uses.setdefault(name, (uses, None if hidden is None else F.lit(hidden).cast("bigint")))
        if window is None:
            return F.col(name)
        self.windows.setdefault(name, set()).add(window)
        return F.col(f"{name}__{window}")

    def deviation(self, column: str) -> Column:
        if column not in self.deviations:
            self.deviations.append(column)
        return F.col(f"{column}__std")

    def _std_columns(self, bucket: bool) -> list[Column]:
        if not bucket:
            return [F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std") for c in self.deviations]
        found = []
        for c in self.deviations:
            n, s = F.col(f"{c}__n"), F.col(f"{c}__s").cast("double")
            spread = n * (F.col(f"{c}__v") + F.pow(F.try_divide(s, n) - F.col(f"{c}__m"), F.lit(2.0)))
            found.append(F.sqrt(F.try_divide(F.sum(spread), F.sum(n))).alias(f"{c}__std"))
        return found

    def merge(self, cells: DataFrame, keys: Sequence[str], times: Sequence[str] = ()) -> DataFrame:
        """Partial results folded to ``keys`` and still mergeable: variances stay beside their counts and sums."""
        group = Window.partitionBy(*keys)
        means = {f"{c}__m": ratio(F.sum(f"{c}__s").over(group), F.sum(f"{c}__n").over(group)) for c in self.deviations}
        cells = cells.withColumns(means) if means else cells
        aggs = [MERGE[m](name).alias(name) for name, (_, m) in self.rows.items()]
        aggs += [MERGE[m](t).alias(t) for t, m in zip(times, ("min", "max"))]
        for c, std in zip(self.deviations, self._std_columns(True)):
            aggs.append((std * std).alias(f"{c}__v"))
        return cells.groupBy(*keys).agg(*aggs)

    def merged(self, rows: DataFrame, scope: Scope) -> DataFrame:
        """One row per output key holding every atom, windowed atom and deviation."""
        if not scope.timed:
            aggs = [MERGE[m](row).alias(name) for name, (row, m) in self.rows.items()]
            return rows.groupBy(KEY).agg(*aggs, *self._std_columns(False))
        located = scope.located(rows)
        atoms = self.rows
        if scope.bucket:
            located = located.groupBy(*scope.cell_keys).agg(
                *(MERGE[m](row).alias(name) for name, (row, m) in atoms.items()),
                *(F.var_pop(F.col(c).cast("double")).alias(f"{c}__v") for c in self.deviations),
            )
        return self.combine(scope.gathered(located), scope)

    def combine(self, cells: DataFrame, scope: Scope) -> DataFrame:
        """Merge located rows, or per-pane partial results, per (cutoff, key)."""
        spread = scope.spread(cells)
        if scope.bucket and scope.masks:
            masked = {}
            for name, (uses, hidden) in [*self.uses.items(), *((f"{c}__v", ([c], None)) for c in self.deviations)]:
                if (shown := scope.shows(uses)) is not None:
                    masked[name] = F.when(shown, F.col(name)).otherwise(hidden)
            spread = spread.withColumns(masked) if masked else spread
        if scope.bucket and self.deviations:
            # Mean first, then the spread around it (pairwise variance update); the
            # window holds at most one row per pane, whatever the key's row count.
            group = Window.partitionBy(CUT, KEY)
            spread = spread.withColumns(
                {
                    f"{c}__m": ratio(F.sum(f"{c}__s").over(group), F.sum(f"{c}__n").over(group))
                    for c in self.deviations
                }
            )
        aggs = []
        for name, (row, merge) in self.rows.items():
            value = F.col(name) if scope.bucket else row
            aggs.append(MERGE[merge](value).alias(name))
            for days in sorted(self.windows.get(name, ())):
                inside = F.when(scope.grid.in_window(days), value)
                aggs.append(MERGE[merge](inside).alias(f"{name}__{days}"))
        return spread.groupBy(*scope.out_keys).agg(*aggs, *self._std_columns(scope.bucket))


def _count(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def reduce_rows(rows: DataFrame, relation: Relation, plan: ColumnPlan, scope: Scope) -> Reduction:
    """All feature families of one relation at ``scope.out_keys`` grain."""
    result = _rollup(rows, relation, plan, scope)
    values = _value_columns(relation, plan)
    if values:
        result = result.join(value_profile(rows, values, scope))
        result = _ratios_of_counts(result, relation)
    if "sequence" in relation.families and scope.timed:
        result = result.join(gap_profile(rows, relation.prefix.lower(), scope))
    if "context" in relation.families and relation.context_keys and scope.time_col and plan.numeric:
        peers = [relation.col(k) for k in relation.context_keys]
        result = result.join(context_profile(rows, plan.numeric, peers, scope, relation.context_rank))
    return result


def changes_in_steps(relation: Relation) -> bool:
    """Whether the features change only where rows come into sight or leave it, and not with each cutoff."""
    ages = "recency" in relation.stats and relation.time is not None
    return set(relation.families) <= {"base", "semantic"} and "activity" not in relation.stats and not ages


def reduce_steps(rows: DataFrame, relation: Relation, plan: ColumnPlan, scope: Scope) -> list[Reduction]:
    """The same features as :func:`reduce_rows`, only at the cutoffs where they change.

    Rollups and value profiles change at different cutoffs and stay apart.
    """
    stepped = replace(scope, bucket=True, steps=True)
    values = _value_columns(relation, plan)
    found = [_rollup(rows, relation, plan, stepped)]
    return [*found, value_profile(rows, values, stepped)] if values else found


def _rollup(rows: DataFrame, relation: Relation, plan: ColumnPlan, scope: Scope) -> Reduction:
    p, stats, families = relation.prefix.lower(), relation.stats, relation.families
    atoms, out, kinds = Atoms(), {}, {}

    def emit(name: str, value: Column, kind: str = "value") -> None:
        out[name], kinds[name] = value, kind

    n = atoms.need("n", F.lit(1).cast("bigint"))
    emit(f"{p}_n_rows", _count(n), "count")
    if "count" in stats and relation.unique_pk and "nunique" in stats:
        emit(f"{p}_pk_nunique", _count(n), "count")

    def numeric(x: str, window: int | None, wanted: Sequence[str]) -> None:
        tail = "" if window is None else f"_{window}d"
        c = F.col(x)
        filled = atoms.need(f"{x}__n", c.isNotNull().cast("bigint"), "sum", window, [x], 0)
        total = atoms.need(f"{x}__s", c, "sum", window, [x])
        if window is not None:
            emit(f"{x}_count{tail}", _count(filled), "count")
        if "sum" in wanted:
            emit(f"{x}_sum{tail}", total)
        if "avg" in wanted:
            emit(f"{x}_avg{tail}", ratio(total, filled))
        if "min" in wanted:
            emit(f"{x}_min{tail}", atoms.need(f"{x}__lo", c, "min", window, [x]))
        if "max" in wanted:
            emit(f"{x}_max{tail}", atoms.need(f"{x}__hi", c, "max", window, [x]))
        if window is None and "std" in wanted:
            emit(f"{x}_std", atoms.deviation(x))

    if "base" in families:
        for x in plan.numeric:
            numeric(x, None, stats)
    if "temporal" in families and scope.timed:
        for x in plan.numeric:
            for w in relation.windows:
                numeric(x, w, ("sum", "avg", "min", "max"))

    conditions = {f: F.coalesce(F.col(f), F.lit(False)) for f in plan.flags}
    semantic, source = list(conditions), {f: [f] for f in plan.flags}
    for g, values in plan.categories.items():
        for value, part in slugs(values).items():
            conditions[f"{g}_{part}"] = F.coalesce(F.col(g) == F.lit(value), F.lit(False))
            source[f"{g}_{part}"] = [g]
    for name, condition in conditions.items():
        atom = f"{name}__c"
        hit = condition.cast("bigint")

        def hits_in(window: int | None = None, atom: str = atom, hit: Column = hit, uses: list = source[name]) -> Column:
            return atoms.need(atom, hit, "sum", window, uses, 0)

        if name in semantic and ("semantic" in families or "base" in families):
            emit(f"{name}_count", _count(hits_in()), "count")
            emit(f"{name}_share", ratio(hits_in(), n))
        elif name not in semantic and "base" in families and "topk" in stats:
            emit(f"{name}_count", _count(hits_in()), "count")
        if "conditional" in families and scope.timed:
            for w in relation.windows:
                hits = hits_in(w)
                emit(f"{name}_count_{w}d", _count(hits), "count")
                emit(f"{name}_share_{w}d", ratio(hits, atoms.need("n", F.lit(1), "sum", w)))
    if scope.timed and {"conditional", "temporal"} & set(families):
        for w in relation.windows:
            emit(f"{p}_n_rows_{w}d", _count(atoms.need("n", F.lit(1), "sum", w)), "count")

    for x, g in ((relation.col(a), relation.col(b)) for a, b in relation.gated):
        for value, part in slugs(plan.categories.get(g, ())).items():
            gated = F.when(F.col(g) == F.lit(value), F.col(x))
            total = atoms.need(f"{g}_{part}_{x}__s", gated, uses=[g, x])
            filled = atoms.need(f"{g}_{part}_{x}__n", gated.isNotNull().cast("bigint"), uses=[g, x], hidden=0)
            emit(f"{x}_if_{g}_{part}_sum", total)
            emit(f"{x}_if_{g}_{part}_avg", ratio(total, filled))

    for text in plan.text:
        c = F.col(text)
        words = F.regexp_count(c, F.lit(WORD)).cast("bigint")
        filled = atoms.need(f"{text}__n", c.isNotNull().cast("bigint"))
        emit(f"{text}_len_avg", ratio(atoms.need(f"{text}__len", F.char_length(c).cast("bigint")), filled))
        emit(f"{text}_words_avg", ratio(atoms.need(f"{text}__words", words), filled))
        blank = F.coalesce(words, F.lit(0)).eqNullSafe(F.lit(0)).cast("bigint")
        emit(f"{text}_blank_share", ratio(atoms.need(f"{text}__blank", blank), n))

    if scope.time_col and "recency" in stats:
        t = F.col(scope.time_col)
        last, first = atoms.need("__last", t, "max"), atoms.need("__first", t, "min")
        stamp = scope.grid.stamp(rows.schema[scope.time_col].dataType)
        emit(f"{p}_days_since_last", day_difference(stamp, last))
        emit(f"{p}_days_since_first", day_difference(stamp, first))
        emit(f"{p}_span_days", day_difference(last, first))

    merged = atoms.merged(rows, scope)
    df = merged.select(*scope.out_keys, *(value.alias(name) for name, value in out.items()))
    return Reduction(df, tuple(Feature(n, kinds[n]) for n in out), scope.timed, scope.steps)


@dataclass(frozen=True)
class ValueColumn:
    """A column (or key combination) summarized through counts per value."""

    name: str
    value: Column
    outputs: tuple[str, ...]  # nunique | mode | concentration | top_share


def _value_columns(relation: Relation, plan: ColumnPlan) -> list[ValueColumn]:
    p, stats, found = relation.prefix.lower(), relation.stats, []
    sequence = "sequence" in relation.families
    for g in plan.categorical:
        outputs = [s for s in ("nunique", "mode") if s in stats and "base" in relation.families]
        outputs += ["concentration", "top_share"] if sequence else []
        if outputs:
            found.append(ValueColumn(g, F.col(g), tuple(outputs)))
    if relation.time and (sequence or "activity" in stats):
        day = F.col(relation.time).cast("date").cast("string")
        found.append(ValueColumn(f"{p}_active_days", day, ("count",)))
    if "episode" in relation.families and relation.episode_keys:
        keys = [F.col(relation.col(k)) for k in relation.episode_keys]
        whole = fold(lambda a, b: a & b, [k.isNotNull() for k in keys])
        value = keys[0] if len(keys) == 1 else F.to_json(F.struct(*keys))
        found.append(ValueColumn(f"{p}_episodes", F.when(whole, value.cast("string")), ("count",)))
    if not relation.unique_pk and "nunique" in stats:
        found.append(ValueColumn(f"{p}_pk_nunique", F.col(relation.pk_col).cast("string"), ("count",)))
    return found


def value_profile(rows: DataFrame, columns: Sequence[ValueColumn], scope: Scope) -> Reduction:
    """Distinct counts, modes and concentrations of several columns in one pass.

    The rows are counted per (key, column, value) first, so the second step only
    folds counters and never gathers the values of a key.
    """
    located = scope.located(rows)
    if not scope.bucket:
        return _folded_values(scope.spread(located), columns, scope.out_keys, scope.timed)
    # A looked-up value's cell begins where the value is visible, so copies need no mask.
    stacked = _stacked(located, columns, [scope.entry(c.name) for c in columns])
    return _profile_of_runs(_value_runs(stacked, scope.grid), columns, scope)


def _value_runs(stacked: DataFrame, grid: CutoffGrid) -> DataFrame:
    """Runs of cutoffs over which the count ``m`` of a (key, column, value) stays the same; none where it is 0.

    A value is kept once per change of its count, not once per cutoff. A window holds the changes of one value,
    at most one per cutoff.
    """
    last, one = len(grid) - 1, F.lit(1).cast("bigint")
    changes = [F.struct(F.col(FROM).alias("at"), one.alias("d"))]
    if grid.lookback_days is not None:
        changes.append(F.struct((F.col(TO) + 1).alias("at"), (-one).alias("d")))
    events = stacked.select(KEY, "i", "v", F.inline(F.array(*changes))).where(F.col("at") <= last)
    events = events.groupBy(KEY, "i", "v", "at").agg(F.sum("d").alias("d"))
    by_value = Window.partitionBy(KEY, "i", "v").orderBy("at")
    runs = events.select(
        KEY,
        "i",
        "v",
        F.col("at").alias(FROM),
        F.coalesce(F.lead("at").over(by_value) - 1, F.lit(last)).alias(TO),
        F.sum("d").over(by_value.rowsBetween(Window.unboundedPreceding, 0)).alias("m"),
    )
    return runs.where(F.col("m") > 0)


def _stacked(df: DataFrame, columns: Sequence[ValueColumn], entries: Sequence[Column] | None = None) -> DataFrame:
    """(column number, value) pairs of the values that aren't null; with entries, each from its own cutoff on."""
    keep = [c for c in (KEY, PANE, FROM, TO, CUT) if c in df.columns and not (entries and c == FROM)]
    values = [(F.lit(i).alias("i"), c.value.cast("string").alias("v")) for i, c in enumerate(columns)]
    if entries:
        values = [(*pair, entry.alias(FROM)) for pair, entry in zip(values, entries)]
    found = df.select(*keep, F.inline(F.array(*(F.struct(*v) for v in values)))).where(F.col("v").isNotNull())
    return found.where(F.col(FROM) <= F.col(TO)) if entries else found


def _folded_values(spread: DataFrame, columns: Sequence[ValueColumn], keys: list[str], timed: bool) -> Reduction:
    counted = _stacked(spread, columns).groupBy(*keys, "i", "v").agg(F.count(F.lit(1)).alias("m"))
    return _profile_of_counts(counted, columns, keys, timed)


def _profile_of_counts(counted: DataFrame, columns: Sequence[ValueColumn], keys: list[str], timed: bool) -> Reduction:
    """Features from the counts ``m`` per (keys, column number i, value v)."""
    partial, _, out = _profile(columns)
    return _profile_features(counted.groupBy(*keys).agg(*partial), keys, out, timed)


def _profile_of_runs(runs: DataFrame, columns: Sequence[ValueColumn], scope: Scope) -> Reduction:
    """The same from runs: the values of a key are folded per run before anything is copied to cutoffs."""
    partial, merged, out = _profile(columns)
    cells = runs.groupBy(KEY, FROM, TO).agg(*partial)
    df = scope.spread(scope.gathered(cells)).groupBy(*scope.out_keys).agg(*merged)
    return _profile_features(df, scope.out_keys, out, scope.timed, scope.steps)


def _profile_features(df: DataFrame, keys: list[str], out: dict, timed: bool, steps: bool = False) -> Reduction:
    df = df.select(*keys, *(value.alias(name) for name, (value, _) in out.items()))
    return Reduction(df, tuple(Feature(name, kind) for name, (_, kind) in out.items()), timed, steps)


def _profile(columns: Sequence[ValueColumn]) -> tuple[list[Column], list[Column], dict[str, tuple[Column, str]]]:
    """Partial aggregates over counts per value, their merge, and the features made of them."""
    aggs, merged, out = [], [], {}
    m, v = F.col("m"), F.col("v")

    def need(name: str, value: Column, merge) -> None:
        aggs.append(value.alias(name))
        merged.append(merge(name).alias(name))

    for i, column in enumerate(columns):
        mine = F.col("i") == i
        a = f"__v{i}"
        if {"nunique", "count"} & set(column.outputs):
            name = column.name if "count" in column.outputs else f"{column.name}_nunique"
            need(f"{a}n", F.count(F.when(mine, 1)), F.sum)
            out[name] = (F.col(f"{a}n"), "count")
        if "mode" in column.outputs:
            need(f"{a}m", F.min(F.when(mine, F.struct((-m).alias("m"), v.alias("v")))), F.min)
            out[f"{column.name}_mode"] = (F.col(f"{a}m.v"), "text")
        if {"concentration", "top_share"} & set(column.outputs):
            need(f"{a}t", F.sum(F.when(mine, m)), F.sum)
        if "concentration" in column.outputs:
            square = m.cast("double") * m.cast("double")
            need(f"{a}q", F.sum(F.when(mine, square)), F.sum)
            total = F.col(f"{a}t").cast("double")
            out[f"{column.name}_concentration"] = (F.try_divide(F.col(f"{a}q"), total * total), "value")
        if "top_share" in column.outputs:
            need(f"{a}x", F.max(F.when(mine, m)), F.max)
            out[f"{column.name}_top_share"] = (ratio(F.col(f"{a}x"), F.col(f"{a}t")), "value")
    return aggs, merged, out


def _ratios_of_counts(result: Reduction, relation: Relation) -> Reduction:
    p = relation.prefix.lower()
    names, extra = {f.name for f in result.features}, {}
    n = F.col(f"{p}_n_rows")
    if f"{p}_active_days" in names and "activity" in relation.stats:
        extra[f"{p}_rows_per_active_day"] = ratio(n, F.col(f"{p}_active_days"))
    if f"{p}_episodes" in names:
        episodes = F.coalesce(F.col(f"{p}_episodes"), F.lit(0))
        extra[f"{p}_rows_per_episode"] = ratio(n, episodes)
        extra[f"{p}_repeat_share"] = F.lit(1.0) - ratio(episodes, n)
    if not extra:
        return result
    return Reduction(
        result.df.withColumns(extra), result.features + tuple(Feature(x) for x in extra), result.timed
    )


def gap_profile(rows: DataFrame, prefix: str, scope: Scope) -> Reduction:
    """Cadence: statistics of the gaps between consecutive rows of a key.

    A gap belongs to every cutoff that sees both of its end points, so gaps are
    found once, not per cutoff. Equal timestamps collapse to one row with a
    multiplicity first; consecutive timestamps are then paired inside minute slices
    of the key, slices are linked inside their day through their first and last
    timestamp, and days are linked in the same way. A heavy key is thereby split over
    its minutes; no link step holds more than the minutes of a day or one row a day.
    """
    t, grid = F.col("t"), scope.grid
    dtype = rows.schema[scope.time_col].dataType
    visible = rows.where(grid.bounds(F.col(scope.time_col), dtype))
    times = visible.groupBy(KEY, F.col(scope.time_col).alias("t")).agg(F.count(F.lit(1)).alias("m"))
    day = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date"))
    times = times.withColumn("slice", (day * 24 + F.hour(t)) * 60 + F.minute(t))
    inner = Window.partitionBy(KEY, "slice").orderBy("t")
    paired = times.withColumn("prev", F.lag("t").over(inner)).where(F.col("prev").isNotNull())
    ends = times.groupBy(KEY, "slice").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    ends = ends.withColumn("day", F.floor(F.col("slice") / 1440))
    days = ends.groupBy(KEY, "day").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    links = []
    for slices, group, order in ((ends, [KEY, "day"], "slice"), (days, [KEY], "day")):
        outer = Window.partitionBy(*group).orderBy(order)
        linked = slices.withColumn("prev", F.lag("last").over(outer)).where(F.col("prev").isNotNull())
        links.append(linked.select(KEY, "prev", F.col("first").alias("t")))
    repeated = times.where(F.col("m") > 1).select(KEY, t.alias("prev"), "t", (F.col("m") - 1).alias("w"))
    one = F.lit(1).cast("bigint")
    pairs = fold(DataFrame.unionByName, [paired.select(KEY, "prev", "t"), *links])
    gaps = pairs.withColumn("w", one).unionByName(repeated)
    gaps = gaps.withColumn("g", epoch_micros(t) - epoch_micros(F.col("prev")))

    # Repeated timestamps contribute w gaps of length zero: their own sums are zero
    # and they form separate cells, so the variance of a cell stays exact.
    cells = (
        grid.locate(gaps, "t", entered="prev")
        .groupBy(KEY, PANE, FROM, TO, (F.col("w") > 1).alias("many"))
        .agg(
            F.sum("w").alias("gap__n"),
            F.sum("g").alias("us"),
            F.min("g").alias("lo"),
            F.max("g").alias("hi"),
            F.var_pop(F.col("g") / F.lit(DAY_MICROS)).alias("gap__v"),
        )
        .withColumn("gap__s", F.col("us") / F.lit(DAY_MICROS))
    )
    atoms = Atoms()
    n = atoms.need("gap__n", F.col("gap__n"))
    total = atoms.need("us", F.col("us"))
    low, high = atoms.need("lo", F.col("lo"), "min"), atoms.need("hi", F.col("hi"), "max")
    std = atoms.deviation("gap")
    scope = Scope(grid, "t", True)
    merged = atoms.combine(scope.gathered(cells), scope)
    mean = ratio(total, n) / F.lit(DAY_MICROS)
    out = {
        f"{prefix}_gap_mean": mean,
        f"{prefix}_gap_std": std,
        f"{prefix}_gap_min": low / F.lit(DAY_MICROS),
        f"{prefix}_gap_max": high / F.lit(DAY_MICROS),
        f"{prefix}_burstiness": ratio(std - mean, std + mean),
    }
    df = merged.select(CUT, KEY, *(v.alias(k) for k, v in out.items()))
    return Reduction(df, tuple(Feature(k) for k in out), True)


def context_profile(
    rows: DataFrame, numeric: Sequence[str], peers: Sequence[str], scope: Scope, rank: bool
) -> Reduction:
    """How the key's rows compare with their peer groups, visible rows only.

    Rows meet once, by peer group and before they are copied to cutoffs; what they give is summed per key
    where they met. Groups that are too large for one task go through sums per (key, group) instead.
    """
    masks = {x: scope.masks[x] for x in numeric if x in scope.masks}
    kept = rows.select(*dict.fromkeys([KEY, scope.time_col, *peers, *numeric, *masks.values()]))
    kept = kept.where(fold(lambda a, b: a & b, [F.col(p).isNotNull() for p in peers]))
    group = F.struct(*peers) if len(peers) > 1 else F.col(peers[0])
    kept = kept.withColumn("__peer", group)
    kept = kept.withColumn("__bucket", F.pmod(F.xxhash64("__peer"), F.lit(PEER_BUCKETS)))
    plain = Scope(scope.grid, scope.time_col, scope.bucket, masks)
    heavy = F.broadcast(_heavy_buckets(kept, plain))
    parts = [_compared(kept.join(heavy, "__bucket", "left_anti"), numeric, plain, rank)]
    large = kept.join(heavy, "__bucket", "left_semi").drop("__bucket")
    parts.append(_compared_folded(large, numeric, plain))
    if rank:
        parts += _peer_ranks(large, numeric, plain)
    terms = [c for c in parts[0].columns if c not in (CUT, KEY)]
    united = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = united.groupBy(CUT, KEY).agg(*(F.sum(c).alias(c) for c in terms))
    out = {}
    for x in numeric:
        out[f"{x}_peer_diff"] = ratio(F.col(f"{x}__ad"), F.col(f"{x}__an"))
        out[f"{x}_peer_ratio"] = ratio(F.col(f"{x}__ar"), F.col(f"{x}__arn"))
        out[f"{x}_peer_z"] = ratio(F.col(f"{x}__az"), F.col(f"{x}__azn"))
    for x in numeric if rank else ():
        out[f"{x}_peer_rank"] = ratio(F.col(f"{x}__as"), F.col(f"{x}__an"))
    return Reduction(df.select(CUT, KEY, *(v.alias(k) for k, v in out.items())), tuple(Feature(k) for k in out), True)


def _heavy_buckets(rows: DataFrame, scope: Scope) -> DataFrame:
    """Hash buckets of peer groups that hold too many visible rows for one task: at most one in HEAVY_TIMES."""
    visible = rows.where(scope.grid.bounds(F.col(scope.time_col), rows.schema[scope.time_col].dataType))
    counted = visible.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum("n").over(Window.partitionBy(F.lit(0))) / F.lit(PEER_BUCKETS)
    counted = counted.withColumn("most", F.greatest(F.lit(HEAVY_ROWS), mean * F.lit(HEAVY_TIMES)))
    return counted.where(F.col("n") > F.col("most")).select("__bucket")


def _compared(rows: DataFrame, numeric: Sequence[str], scope: Scope, rank: bool) -> DataFrame:
    """What each row adds to its key at each cutoff: a group's statistics and running counts are windows over it.

    Only the rows themselves are shuffled, with the cutoffs at which they and their looked-up values show.
    """
    own, m = replace(scope, bucket=True), F.col("m")
    cells = own.located(rows).select(KEY, "__peer", FROM, TO, *own.entries.values(), *numeric).repartition("__peer")
    if scope.bucket:
        cells = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("m"))
    else:
        cells = cells.withColumn("m", F.lit(1).cast("bigint"))
    shown = {x: own.shows([x]) for x in numeric}
    values = [F.col(x) if shown[x] is None else F.when(shown[x], F.col(x)).alias(x) for x in numeric]
    copies = own.grid.spread(cells).select(CUT, KEY, "__peer", "m", *values)
    group, terms = Window.partitionBy("__peer", CUT), []
    for x in numeric:
        # One sort serves the statistics and the running count of a column.
        ordered = group.orderBy(x)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if rank else group
        n, value = F.when(F.col(x).isNotNull(), m), F.col(x).cast("double")
        total = F.sum(n).over(whole)
        found = {f"{x}__pm": ratio(F.sum(value * m).over(whole), total)}
        if rank:
            upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            found[f"{x}__share"] = ratio(F.sum(n).over(upto), total)
        if not scope.bucket:
            found[f"{x}__ps"] = F.stddev_pop(value).over(whole)
        copies = copies.withColumns(found)
        if scope.bucket:
            # A cell stands for several rows. Equal values have no spread, whatever the last bits of their mean.
            span = F.max(value).over(whole) - F.min(value).over(whole)
            squares = F.sum(m * F.pow(value - F.col(f"{x}__pm"), F.lit(2.0))).over(whole)
            copies = copies.withColumn(f"{x}__ps", F.when(span == 0, 0.0).otherwise(F.sqrt(ratio(squares, total))))
        terms += _peer_terms(x, n, value * m)
        if rank:
            terms.append((F.col(f"{x}__share") * n).alias(f"{x}__as"))
    return copies.select(CUT, KEY, *terms)


def _peer_terms(x: str, n: Column, s: Column) -> list[Column]:
    """What ``n`` values of the sum ``s`` add to their key's sums, beside the mean and deviation of their group."""
    pm, ps = F.col(f"{x}__pm"), F.col(f"{x}__ps")
    distance = s - n * pm
    return [
        n.alias(f"{x}__an"),
        distance.alias(f"{x}__ad"),
        F.try_divide(s, pm).alias(f"{x}__ar"),
        F.when(pm != 0, n).alias(f"{x}__arn"),
        F.try_divide(distance, ps).alias(f"{x}__az"),
        F.when(ps != 0, n).alias(f"{x}__azn"),
    ]


def _compared_folded(rows: DataFrame, numeric: Sequence[str], scope: Scope) -> DataFrame:
    """The same for groups of any size, but for ranks.

    Differences to a peer mean depend on the rows only through sums, so rows are
    folded to (key, peer group) before they meet the peer statistics.
    """
    atoms = Atoms()
    for x in numeric:
        atoms.need(f"{x}__n", F.col(x).isNotNull().cast("bigint"), uses=[x], hidden=0)
        atoms.need(f"{x}__s", F.col(x).cast("double"), uses=[x])
        atoms.deviation(x)
    by_peer = atoms.merged(rows.withColumn(KEY, F.col("__peer")), scope)
    by_peer = by_peer.select(
        CUT,
        F.col(KEY).alias("__peer"),
        *(
            c
            for x in numeric
            for c in (
                ratio(F.col(f"{x}__s"), F.col(f"{x}__n")).alias(f"{x}__pm"),
                F.col(f"{x}__std").alias(f"{x}__ps"),
            )
        ),
    )
    sums, uses = {}, {}
    for x in numeric:
        sums[f"{x}__n"] = F.col(x).isNotNull().cast("bigint")
        sums[f"{x}__s"] = F.col(x).cast("double")
        uses |= {f"{x}__n": x, f"{x}__s": x}
    own = scope.counted(rows, ["__peer"], sums, uses)
    joined = own.join(by_peer, [CUT, "__peer"])
    return joined.select(CUT, KEY, *(t for x in numeric for t in _peer_terms(x, F.col(f"{x}__n"), F.col(f"{x}__s"))))


def _peer_ranks(rows: DataFrame, numeric: Sequence[str], scope: Scope) -> list[DataFrame]:
    """Shares of the peer group at or below the key's values, for all columns of one type at once.

    The rows are stacked to (column, value). Slices are cut over the values of all columns together, and
    a running total is kept per (cutoff, column, peer group), so the number of columns adds no shuffle.
    """
    from relpoint.functions.ordered import running_share

    by_type: dict[str, list[str]] = {}
    for x in numeric:
        kind = rows.schema[x].dataType.simpleString()
        # These are exact as doubles.
        by_type.setdefault("double" if kind in ("tinyint", "smallint", "int", "float") else kind, []).append(x)
    found = []
    for kind, columns in by_type.items():
        located = scope.located(rows)
        source = located if scope.bucket else scope.spread(located)
        ends = [c for c in (FROM, TO, CUT) if c in source.columns and not (c == FROM and scope.bucket)]
        pairs = []
        for i, x in enumerate(columns):
            entry = [scope.entry(x).alias(FROM)] if scope.bucket else []
            pairs.append(F.struct(F.lit(i).alias("i"), F.col(x).cast(kind).alias("x"), *entry))
        stacked = source.select(KEY, "__peer", *ends, F.inline(F.array(*pairs))).where(F.col("x").isNotNull())
        if scope.bucket:
            stacked = stacked.where(F.col(FROM) <= F.col(TO))
            cells = stacked.groupBy(KEY, "__peer", FROM, TO, "i", "x").agg(F.count(F.lit(1)).alias("m"))
            spread = scope.grid.spread(cells)
        else:
            spread = stacked.withColumn("m", F.lit(1).cast("bigint"))
        mine = spread.groupBy(CUT, KEY, "__peer", "i", "x").agg(F.sum("m").alias("m"))
        histogram = mine.groupBy(CUT, "__peer", "i", "x").agg(F.sum("m").alias("m"))
        shares = running_share(histogram, [CUT, "__peer", "i"], "x", "m", "share", seen=stacked)
        ranked = mine.join(shares, [CUT, "__peer", "i", "x"])
        shared = F.col("share") * F.col("m")
        found.append(ranked.select(CUT, KEY, *(F.when(F.col("i") == i, shared).alias(f"{x}__as") for i, x in enumerate(columns))))
    return found


def versions(reduction: Reduction, last: int) -> DataFrame:
    """A timed reduction as intervals: one row per key and change, valid from cutoff ``since`` to ``until``.

    The rows of a key cover all cutoffs up to ``last``; where the reduction has no row the features are
    NULL. A window holds at most one row per cutoff.
    """
    names = [f.name for f in reduction.features]
    by_key, state = Window.partitionBy(KEY).orderBy(CUT), F.struct(*names)
    end = F.col(UNTIL) if reduction.steps else F.col(CUT)
    missing = F.struct(*(F.lit(None).cast(reduction.df.schema[n].dataType).alias(n) for n in names))
    rows = reduction.df.select(
        KEY,
        CUT,
        state.alias("state"),
        end.alias("end"),
        F.lag(end).over(by_key).alias("before"),
        F.lag(state).over(by_key).alias("former"),
        F.lead(CUT).over(by_key).alias("next"),
    )
    follows = F.coalesce(F.col("before") == F.col(CUT) - 1, F.lit(False))
    same = follows & F.col("former").eqNullSafe(F.col("state"))
    ends = (F.col("end") < last) & ~F.coalesce(F.col("next") == F.col("end") + 1, F.lit(False))

    def event(when: Column, since: Column, state: Column) -> Column:
        return F.when(when, F.struct(since.cast("int").alias("since"), state.alias("state")))

    events = F.array(
        event(~same, F.col(CUT), F.col("state")),
        event(ends, F.col("end") + 1, missing),
        event(F.col("before").isNull() & (F.col(CUT) > 0), F.lit(0), missing),
    )
    changes = rows.select(KEY, F.inline(F.filter(events, lambda e: e.isNotNull())))
    until = F.coalesce(F.lead("since").over(Window.partitionBy(KEY).orderBy("since")) - 1, F.lit(last))
    return changes.select(KEY, "since", until.alias("until"), "state.*")


def _meet_versions(located: DataFrame, dynamic: Sequence[tuple[Reduction, str]], own: Scope) -> DataFrame:
    """Located rows cut into runs of cutoffs over which all features below them stay the same."""
    last = len(own.grid) - 1
    for key in dict.fromkeys(k for _, k in dynamic if k in own.masks):
        # Before the looked-up row is visible its key leads nowhere. Split once, so that all joins by a key share a shuffle.
        others = [c for c in located.columns if c not in (FROM, TO, key)]
        entry, nowhere = own.entry(key), F.lit(None).cast(located.schema[key].dataType)
        runs = F.array(
            F.struct(F.col(FROM), F.least(F.col(TO), entry - 1).alias(TO), nowhere.alias(key)),
            F.struct(F.greatest(F.col(FROM), entry).alias(FROM), F.col(TO), F.col(key)),
        )
        located = located.select(*others, F.inline(runs)).where(F.col(FROM) <= F.col(TO))
    for key in dict.fromkeys(k for _, k in dynamic):
        located = located.withColumn("__place", _scattered(key, located.schema[key].dataType))
        for child in (c for c, k in dynamic if k == key):
            right = versions(child, last).withColumnRenamed(KEY, "__right")
            equal = (F.col("__place") == F.col("__right")) & F.col(key).isNotNull()
            meets = equal & (F.col("since") <= F.col(TO)) & (F.col(FROM) <= F.col("until"))
            joined = located.join(right, meets, "left")
            # greatest and least skip the NULLs of rows without a version.
            located = joined.withColumns({FROM: F.greatest(FROM, "since"), TO: F.least(TO, "until")}).drop(
                "__right", "since", "until"
            )
        located = located.drop("__place")
    return located


def _scattered(key: str, dtype: T.DataType) -> Column:
    """The key, with any other value for NULL: rows that lead nowhere would all meet in one task."""
    drawn = F.xxhash64(KEY, FROM, TO)
    if isinstance(dtype, T.IntegerType):
        drawn = F.hash(KEY, FROM, TO)
    elif not isinstance(dtype, (T.LongType, T.StringType)):
        return F.col(key)
    return F.coalesce(F.col(key), drawn.cast(dtype))


def reduce_hops(
    rows: DataFrame,
    dynamic: Sequence[tuple[Reduction, str]],
    scope: Scope,
    grid: CutoffGrid,
    stats: Sequence[str],
    folds: bool = False,
) -> Reduction:
    """Fold features that already depend on the cutoff one level further up.

    A key that a looked-up row carries leads to its own children only where that row is visible.
    Text features fold to their most frequent value. With ``folds`` the features below are joined as
    intervals and partial results per run of cutoffs are copied; else each row is copied per cutoff.
    """
    keys = list(dict.fromkeys(k for _, k in dynamic))
    masks = {k: scope.masks[k] for k in keys if k in scope.masks}
    time_cols = [scope.time_col] if scope.time_col else []
    narrow = rows.select(*dict.fromkeys([KEY, *time_cols, *keys, *masks.values()]))
    own = Scope(grid, scope.time_col, folds, masks)
    located = own.located(narrow)
    if folds:
        pieces = _meet_versions(located, dynamic, own)
    else:
        pieces = own.spread(located)
        for key in keys:
            pieces = pieces.withColumn("__place", _scattered(key, pieces.schema[key].dataType))
            for child in (c for c, k in dynamic if k == key):
                names = [f.name for f in child.features]
                right = child.df.select(F.col(CUT).alias("__rcut"), F.col(KEY).alias("__right"), *names)
                equal = (F.col(CUT) == F.col("__rcut")) & (F.col("__place") == F.col("__right"))
                pieces = pieces.join(right, equal & F.col(key).isNotNull(), "left").drop("__rcut", "__right")
            pieces = pieces.drop("__place")
    partial, merged, merges, out = [], [], {}, {}

    def need(name: str, value: Column, merge: str) -> Column:
        partial.append(value.alias(name))
        merged.append(MERGE[merge](name).alias(name))
        merges[name] = merge
        return F.col(name)

    for child, _ in dynamic:
        for f in child.features:
            if f.kind == "text":
                continue
            value = F.coalesce(F.col(f.name), F.lit(0)) if f.kind == "count" else F.col(f.name)
            kind = "count" if f.kind == "count" else "value"
            total = need(f"{f.name}_sum", F.sum(value), "sum") if {"sum", "avg"} & set(stats) else None
            if "sum" in stats:
                out[f"{f.name}_sum"] = (total, kind)
            if "avg" in stats:
                out[f"{f.name}_avg"] = (ratio(total, need(f"{f.name}__n", F.count(value), "sum")), "value")
            for stat in ("min", "max"):
                if stat in stats:
                    out[f"{f.name}_{stat}"] = (need(f"{f.name}_{stat}", MERGE[stat](value), stat), "value")
    texts = [f.name for c, _ in dynamic for f in c.features if f.kind == "text"]
    modes = [ValueColumn(name, F.col(name), ("mode",)) for name in texts]
    of_modes, _, made = _profile(modes)
    if folds and modes:
        # One pass over the pieces: a cell is copied as row -1, its numbers, and a row per text value.
        cells = pieces.groupBy(KEY, FROM, TO, *texts).agg(*partial, F.count(F.lit(1)).alias("m"))
        none = [F.lit(None).cast(cells.schema[n].dataType).alias(n) for n in merges]
        stacked = [F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("v"), *merges)]
        stacked += [F.struct(F.lit(i).alias("i"), F.col(t).cast("string").alias("v"), *none) for i, t in enumerate(texts)]
        cells = own.gathered(cells)
        rows = cells.select(KEY, FROM, TO, "m", F.inline(F.array(*stacked))).where((F.col("i") < 0) | F.col("v").isNotNull())
        counted = grid.spread(rows).groupBy(CUT, KEY, "i", "v").agg(*merged, F.sum("m").alias("m"))
        numbers = [MERGE[m](F.when(F.col("i") < 0, F.col(n))).alias(n) for n, m in merges.items()]
        df = counted.groupBy(CUT, KEY).agg(*numbers, *of_modes)
    elif folds:
        cells = own.gathered(pieces.groupBy(KEY, FROM, TO).agg(*partial))
        df = grid.spread(cells).groupBy(CUT, KEY).agg(*merged)
    else:
        df = pieces.groupBy(CUT, KEY).agg(*partial)
    if folds:
        out |= made
    folded = Reduction(
        df.select(CUT, KEY, *(v.alias(n) for n, (v, _) in out.items())), tuple(Feature(n, k) for n, (_, k) in out.items()), True
    )
    if folds or not modes:
        return folded
    return folded.join(_folded_values(pieces, modes, [CUT, KEY], True))
