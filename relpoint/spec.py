"""Plan-time description of a relational graph: relations, edges, cutoffs."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary of the feature.
FAMILIES = ("base", "semantic", "conditional", "temporal", "sequence", "episode", "context")
BASE_STATS = (
    "count", "sum", "avg", "min", "max", "std", "nunique", "mode", "topk", "recency", "activity",
)

# Top categories need a number of values, so a caller asks for them.
DEFAULT_STATS = tuple(s for s in BASE_STATS if s != "topk")
WINDOWED = ("conditional", "temporal")

Predicate = str | Callable[[], Column]


def normalize_families(families: Sequence[str]) -> tuple[str, ...]:
    """Keep order, drop duplicates, reject unknown names."""
    chosen = tuple(dict.fromkeys(families))
    unknown = sorted(set(chosen) - set(FAMILIES))
    if unknown:
        raise ValueError(f"unknown feature families: {unknown}")
    return chosen


@dataclass(frozen=True)
class Relation:
    """One role of a source table. The same ``df`` may appear under several prefixes.

    Columns are exposed as ``<prefix>_<column>`` in lower case. ``filters`` and
    ``derived`` are SQL expressions over those names (or over ``{column}``
    templates); ``annotations`` are boolean templates evaluated before reduction.
    ``top_k`` has to be given where category values are to be found in the data; with a
    ``cardinality_threshold`` columns of more values get none (the plan names them).
    ``gated`` lists (numeric, category) column pairs. ``unique_pk`` claims that ``pk``
    tells rows apart, so that rows are counted instead of values.
    """

    name: str
    df: DataFrame
    pk: str
    prefix: str
    time_col: str | None = None
    columns: tuple[str, ...] | None = None
    filters: tuple[Predicate, ...] = ()
    derived: Mapping[str, Predicate] = field(default_factory=dict)
    annotations: Mapping[str, Predicate] = field(default_factory=dict)
    families: tuple[str, ...] = ("base",)
    stats: tuple[str, ...] = DEFAULT_STATS
    windows: tuple[int, ...] = ()
    top_k: int | None = None
    cardinality_threshold: int | None = None
    categories: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    context_keys: tuple[str, ...] = ()
    context_rank: bool = False
    episode_keys: tuple[str, ...] = ()
    text_columns: tuple[str, ...] = ()
    gated: tuple[tuple[str, str], ...] = ()
    unique_pk: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "families", normalize_families(self.families))
        object.__setattr__(self, "windows", tuple(sorted(set(self.windows))))
        unknown = sorted(set(self.stats) - set(BASE_STATS))
        if unknown:
            raise ValueError(f"unknown base statistics: {unknown}")
        if self.time_col is None and self.families != ("base",):
            object.__setattr__(self, "families", ("base",))
        if bool(self.windows) != bool(set(WINDOWED) & set(self.families)):
            raise ValueError(f"{self.name}: windows and the families {WINDOWED} need each other, and a clock")
        lowered = [c.lower() for c in self.df.columns]
        if len(lowered) != len(set(lowered)):
            raise ValueError(f"{self.name}: column names differ only by case")
        for column in (self.pk, *([self.time_col] if self.time_col else []), *(self.columns or ())):
            if column.lower() not in lowered:
                raise ValueError(f"{self.name}: no column {column!r}")

    def role(self, name: str, prefix: str) -> Relation:
        """The same source in another place of the graph."""
        return replace(self, name=name, prefix=prefix)

    def col(self, column: str) -> str:
        return re.sub(r"\W+", "_", f"{self.prefix}_{column}".lower())

    @property
    def pk_col(self) -> str:
        return self.col(self.pk)

    @property
    def time(self) -> str | None:
        return None if self.time_col is None else self.col(self.time_col)

    def expression(self, predicate: Predicate) -> Column:
        """SQL text with ``{column}`` templates, or a callable returning a Column."""
        if callable(predicate):
            return predicate()
        known = {c.lower() for c in self.df.columns} | {d.lower() for d in self.derived}

        def substitute(match: re.Match[str]) -> str:
            if match.group(1).lower() not in known:
                raise ValueError(f"{self.name}: unknown column {match.group(1)!r} in {predicate!r}")
            return f"`{self.col(match.group(1))}`"

        return F.expr(re.sub(r"\{([^{}]+)\}", substitute, predicate))

    def prepared(self, keys: Sequence[str] = ()) -> DataFrame:
        """Project with prefix, add derived columns, filter, then add flags."""
        wanted = None
        if self.columns is not None:
            extra = (self.pk, self.time_col, *keys, *self.context_keys, *self.episode_keys, *self.text_columns)
            wanted = {c.lower() for c in (*self.columns, *extra) if c}
        df = self.df.select(
            *(
                F.col(f"`{c}`").alias(self.col(c))
                for c in self.df.columns
                if wanted is None or c.lower() in wanted or self._mentioned(c)
            )
        )
        if self.time is not None and isinstance(df.schema[self.time].dataType, T.DateType):
            df = df.withColumn(self.time, F.col(self.time).cast("timestamp_ntz"))
        for name, predicate in self.derived.items():
            df = df.withColumn(self.col(name), self.expression(predicate))
        for predicate in self.filters:
            df = df.where(self.expression(predicate))
        for name, predicate in self.annotations.items():
            df = df.withColumn(self.col(name), self.expression(predicate).cast("boolean"))
        return df

    def _mentioned(self, column: str) -> bool:
        """A column used only inside an expression still has to be read."""
        texts = [*self.filters, *self.derived.values(), *self.annotations.values()]
        needles = (self.col(column), "{" + column.lower() + "}")
        return any(isinstance(t, str) and any(n in t.lower() for n in needles) for t in texts)


@dataclass(frozen=True)
class Edge:
    """``parent.parent_key = child.child_key``.

    ``reduce=True`` aggregates the child to the parent's grain before joining;
    ``reduce=False`` looks up attributes of a child that is unique on its key.
    """

    parent: str
    child: str
    parent_key: str
    child_key: str
    reduce: bool = True


@dataclass(frozen=True)
class CompressionGraph:
    """Relations below one prediction entity, compressed at many cutoffs in one job."""

    entity: str
    relations: tuple[Relation, ...]
    edges: tuple[Edge, ...]
    cutoffs: tuple[datetime, ...]
    inclusive: bool = False
    lookback_days: float | None = None
    hops_back: int = 1
    hop_stats: tuple[str, ...] = ("sum", "avg", "min", "max")
    strategy: str = "auto"

    def __post_init__(self) -> None:
        prefixes = [r.prefix.lower() for r in self.relations]
        names = [r.name for r in self.relations]
        if len(set(prefixes)) != len(prefixes) or len(set(names)) != len(names):
            raise ValueError("relation names and prefixes must be unique")
        if self.strategy not in ("auto", "expand", "bucket"):
            raise ValueError("strategy must be auto, expand or bucket")
        object.__setattr__(self, "cutoffs", tuple(sorted(set(self.cutoffs))))
        for edge in self.edges:
            self.relation(edge.parent), self.relation(edge.child)
        if len({e.child for e in self.edges}) != len(self.edges):
            raise ValueError("a role can be the child of one edge only; add one with Relation.role")

    def relation(self, name: str) -> Relation:
        for relation in self.relations:
            if relation.name == name:
                return relation
        raise ValueError(f"no relation named {name!r}")

    def children(self, name: str, depth: int) -> list[Edge]:
        """Edges below a relation; edges past the hop limit are pruned here."""
        return [e for e in self.edges if e.parent == name] if depth < self.hops_back else []

    def keys_of(self, name: str) -> list[str]:
        keys = [e.parent_key for e in self.edges if e.parent == name]
        keys += [e.child_key for e in self.edges if e.child == name]
        return list(dict.fromkeys(keys))

    def with_cutoffs(self, cutoffs: Sequence[datetime]) -> CompressionGraph:
        return replace(self, cutoffs=tuple(cutoffs))
