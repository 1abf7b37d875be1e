"""Compile a graph to one lazy DataFrame keyed by (cutoff, entity)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.functions.timegrid import CUT, FROM, TO, CutoffGrid, timestamp_array
from relpoint.operators.profile import top_values
from relpoint.operators.reduce import (
    KEY,
    ColumnPlan,
    Feature,
    Reduction,
    Scope,
    changes_in_steps,
    reduce_hops,
    reduce_rows,
    reduce_steps,
)
from relpoint.sources.tables import assert_unique, repeated_keys
from relpoint.spec import CompressionGraph, Edge, Relation


@dataclass(frozen=True)
class FrozenPlan:
    """Column roles and category values, fixed once and replayed for every split."""

    columns: dict[str, ColumnPlan]

    def to_json(self) -> str:
        return json.dumps(
            {
                name: {
                    "numeric": p.numeric,
                    "categorical": p.categorical,
                    "flags": p.flags,
                    "text": p.text,
                    "categories": p.categories,
                    "left_out": p.left_out,
                }
                for name, p in self.columns.items()
            },
            sort_keys=True,
        )

    @classmethod
    def from_json(cls, text: str) -> FrozenPlan:
        return cls(
            {
                name: ColumnPlan(
                    tuple(p["numeric"]),
                    tuple(p["categorical"]),
                    tuple(p["flags"]),
                    tuple(p["text"]),
                    {k: tuple(v) for k, v in p["categories"].items()},
                    tuple(p.get("left_out", ())),
                )
                for name, p in json.loads(text).items()
            }
        )


def column_roles(graph: CompressionGraph, relation: Relation) -> ColumnPlan:
    """Numeric, categorical, flag and text columns in schema order."""
    keys = graph.keys_of(relation.name)
    df = relation.prepared(keys)
    used = {relation.pk, relation.time_col, *keys, *relation.context_keys, *relation.episode_keys}
    barred = {relation.col(c) for c in used if c}
    text = tuple(relation.col(c) for c in relation.text_columns)
    if relation.columns is None:
        wanted = {f.name for f in df.schema}
    else:
        wanted = {relation.col(c) for c in (*relation.columns, *relation.derived, *relation.annotations)}
    numeric, categorical, flags = [], [], []
    for f in df.schema:
        if f.name in barred or f.name in text or f.name not in wanted:
            continue
        if isinstance(f.dataType, T.BooleanType):
            flags.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            categorical.append(f.name)
    categories = {relation.col(c): tuple(v) for c, v in relation.categories.items()}
    return ColumnPlan(tuple(numeric), tuple(categorical), tuple(flags), text, categories)


def compile_graph(graph: CompressionGraph, at: datetime | None = None) -> FrozenPlan:
    """Resolve roles and freeze top categories on rows visible at ``at``.

    That is the newest cutoff of the graph unless given: compile the graph of the training cutoffs and
    replay the plan on the others. Category values come from one aggregation per relation that needs
    them. Columns above the cardinality threshold get none and are listed in ``left_out``; a relation
    without a visible row is an error, since its columns would be missing at every cutoff.
    """
    newest = CutoffGrid((at or graph.cutoffs[-1],), graph.inclusive, graph.lookback_days)
    columns = {}
    for name in _reachable(graph):
        relation = graph.relation(name)
        plan = column_roles(graph, relation)
        gated = {relation.col(g) for _, g in relation.gated}
        wants = ("topk" in relation.stats and "base" in relation.families) or "conditional" in relation.families
        open_columns = [c for c in plan.categorical if c not in plan.categories and (wants or c in gated)]
        if open_columns and name != graph.entity:
            if relation.top_k is None:
                raise ValueError(f"{name}: top_k is needed for the categories of {open_columns}")
            rows = relation.prepared(graph.keys_of(name))
            if relation.time is not None:
                rows = newest.locate(rows, relation.time)
            found, left_out = top_values(rows, open_columns, relation.top_k, relation.cardinality_threshold)
            if not found and not left_out and rows.isEmpty():
                raise ValueError(f"{name}: no row is visible at the cutoff that freezes its categories")
            plan = plan.merged(ColumnPlan(categories=found, left_out=left_out))
        columns[name] = plan
    return FrozenPlan(columns)


def _reachable(graph: CompressionGraph) -> list[str]:
    found, level = [graph.entity], [(graph.entity, 0)]
    while level:
        level = [(e.child, d + 1) for name, d in level for e in graph.children(name, d)]
        found += [name for name, _ in level]
    return found


@dataclass
class _Node:
    """Rows of a relation with everything that does not depend on the cutoff."""

    relation: Relation
    rows: DataFrame
    plan: ColumnPlan
    masks: dict[str, str] = field(default_factory=dict)
    dynamic: list[tuple[Reduction, str]] = field(default_factory=list)


def _build(
    graph: CompressionGraph, frozen: FrozenPlan, grid: CutoffGrid, name: str, depth: int, steps: bool = False
) -> _Node:
    """``steps``: whoever takes the features below joins them as intervals."""
    relation = graph.relation(name)
    node = _Node(relation, relation.prepared(graph.keys_of(name)), frozen.columns[name])
    for edge in graph.children(name, depth):
        if edge.reduce:
            _attach_reduction(graph, frozen, grid, node, edge, depth, steps)
        else:
            _attach_lookup(graph, frozen, grid, node, edge, depth, steps)
    return node


def _attach_reduction(graph, frozen, grid, node: _Node, edge: Edge, depth: int, steps: bool) -> None:
    key = node.relation.col(edge.parent_key)
    for reduction in _reduce(graph, frozen, grid, edge, depth + 1, steps):
        if reduction.timed:
            node.dynamic.append((reduction, key))
            continue
        # Without a clock below, the features are plain attributes of the parent row.
        right = reduction.df.withColumnRenamed(KEY, "__right")
        node.rows = node.rows.join(right, node.rows[key] == right["__right"], "left").drop("__right")
        counts = [f.name for f in reduction.features if f.kind == "count"]
        node.rows = node.rows.fillna(0, counts) if counts else node.rows
        numeric = tuple(f.name for f in reduction.features if f.kind != "text")
        text = tuple(f.name for f in reduction.features if f.kind == "text")
        node.plan = node.plan.merged(ColumnPlan(numeric=numeric, categorical=text))


def _attach_lookup(graph, frozen, grid, node: _Node, edge: Edge, depth: int, steps: bool) -> None:
    """Left join parent attributes. Catalyst and AQE choose broadcast by measured size.

    A key that occurs twice would multiply the child's rows; the plan raises an error for it.
    """
    child = _build(graph, frozen, grid, edge.child, depth + 1, steps)
    key, target = node.relation.col(edge.parent_key), child.relation.col(edge.child_key)
    carried = [k for _, k in child.dynamic]
    masks = {}
    for column in (*child.plan.numeric, *child.plan.categorical, *child.plan.flags, *carried):
        seen_at = child.masks.get(column)
        if child.relation.time is not None:
            own = child.relation.time
            if seen_at is not None:
                both = f"{seen_at}__{own}"
                child.rows = child.rows.withColumn(both, F.greatest(seen_at, own))
                own = both
            seen_at = own
        if seen_at is not None:
            masks[column] = seen_at
    columns = list(
        dict.fromkeys(
            [*child.plan.numeric, *child.plan.categorical, *child.plan.flags, *carried, *masks.values()]
        )
    )
    right = child.rows.where(F.col(target).isNotNull()).select(
        F.col(target).alias("__right"), *(c for c in columns)
    )
    source = child.relation.prepared(graph.keys_of(edge.child)).select(F.col(target).alias("__right"))
    right = right.unionByName(repeated_keys(source, "__right", edge.child), allowMissingColumns=True)
    node.rows = node.rows.join(right, node.rows[key] == right["__right"], "left").drop("__right")
    node.plan = node.plan.merged(
        ColumnPlan(child.plan.numeric, child.plan.categorical, child.plan.flags, (), child.plan.categories)
    )
    node.masks.update(masks)
    node.dynamic += child.dynamic


def _reduce(graph, frozen, grid, edge: Edge, depth: int, steps: bool) -> list[Reduction]:
    """Bottom-up: reduce the subtree below ``edge.child`` to the edge's key."""
    relation = graph.relation(edge.child)
    folds = Scope.folds(grid, relation.time, graph.strategy)
    node = _build(graph, frozen, grid, edge.child, depth, folds)
    key = F.col(relation.col(edge.child_key))
    rows = node.rows.where(key.isNotNull()).withColumn(KEY, key)
    windowed = replace(grid, windows=relation.windows)
    scope = Scope.of(windowed, relation.time, graph.strategy, node.masks)
    if steps and scope.timed and not node.dynamic and changes_in_steps(relation):
        return reduce_steps(rows, relation, node.plan, scope)
    own = reduce_rows(rows, relation, node.plan, scope)
    if not node.dynamic:
        return [own]
    hops = reduce_hops(rows, node.dynamic, scope, grid, graph.hop_stats, folds)
    return [own.join(hops)] if own.timed else [own, hops]


def frame(
    graph: CompressionGraph,
    frozen: FrozenPlan | None = None,
    keys: DataFrame | None = None,
    cutoff_col: str = "cutoff",
    how: str = "inner",
) -> DataFrame:
    """One row per (cutoff, entity) with every relation below it compressed.

    ``keys`` (cutoff, entity, further columns) restricts the rows, e.g. to a label
    table, and carries its further columns through, so that labels need no second
    join with the wide frame. ``how="left"`` keeps keys without a visible entity.
    Keys at a cutoff outside the graph and repeated keys are errors. Without keys, every
    entity visible at a cutoff gets a row.
    """
    frozen = frozen or compile_graph(graph)
    grid = CutoffGrid(graph.cutoffs, graph.inclusive, graph.lookback_days)
    everyone = CutoffGrid(graph.cutoffs, graph.inclusive)
    entity = graph.relation(graph.entity)
    node = _build(graph, frozen, grid, graph.entity, 0)
    pk = entity.pk_col
    node.rows = node.rows.where(F.col(pk).isNotNull())
    carried: list[str] = []
    stamp = grid.stamp(None if entity.time is None else node.rows.schema[entity.time].dataType)
    if keys is not None:
        rows, carried = _keyed(node, everyone, keys, cutoff_col, how)
        stamp = F.col("__stamp")
    elif entity.time is not None:
        rows = everyone.spread(everyone.locate(node.rows, entity.time))
    else:
        last = len(grid) - 1
        rows = everyone.spread(node.rows.withColumns({FROM: F.lit(0), TO: F.lit(last)}))
    for column, seen_at in node.masks.items():
        visible = (F.col(seen_at) <= stamp) if graph.inclusive else (F.col(seen_at) < stamp)
        rows = rows.withColumn(column, F.when(visible, F.col(column)))
    attributes = [c for c in (*node.plan.numeric, *node.plan.categorical, *node.plan.flags) if c != pk]
    links = [k for _, k in node.dynamic]
    stamps = [] if keys is None else ["__stamp"]
    base = rows.select(CUT, *dict.fromkeys([*stamps, pk, *carried, *attributes, *links]))
    features: list[Feature] = []
    for reduction, key in node.dynamic:
        right = reduction.df.withColumnRenamed(KEY, "__right").withColumnRenamed(CUT, "__rcut")
        base = base.join(
            right, (base[CUT] == right["__rcut"]) & (base[key] == right["__right"]), "left"
        ).drop("__right", "__rcut")
        features += reduction.features
    out = [stamp.alias("cutoff"), F.col(pk), *(F.col(c) for c in carried)]
    out += [_export(base, a) for a in attributes]
    for f in features:
        column = _export(base, f.name)
        out.append(F.coalesce(column, F.lit(0)).alias(f.name) if f.kind == "count" else column)
    return base.select(*out)


def _keyed(
    node: _Node, everyone: CutoffGrid, keys: DataFrame, cutoff_col: str, how: str
) -> tuple[DataFrame, list[str]]:
    """Entity rows for given (cutoff, entity) keys, plus the names of carried columns."""
    entity = node.relation
    pk, time = entity.pk_col, entity.time
    entity_col = next(c for c in keys.columns if c != cutoff_col)
    carried = [c for c in keys.columns if c not in (cutoff_col, entity_col)]
    known = timestamp_array(everyone.cutoffs, keys.schema[cutoff_col].dataType)
    place = F.array_position(known, F.col(cutoff_col))
    unknown = F.raise_error(F.concat(F.lit("key at a cutoff the graph lacks: "), _shown(cutoff_col)))
    wanted = keys.select(
        F.col(cutoff_col).alias("__stamp"),
        F.when(place > 0, (place - 1).cast("int")).otherwise(unknown.cast("int")).alias(CUT),
        F.col(entity_col).alias("__wanted"),
        *carried,
    )
    # One to one: a key may not occur twice. The window holds the rows of one key.
    same = F.count(F.lit(1)).over(Window.partitionBy(CUT, "__wanted"))
    doubled = F.raise_error(F.concat(F.lit("key given more than once: "), _shown("__wanted")))
    wanted = wanted.withColumn("__same", F.when(F.col("__wanted").isNull(), 1).otherwise(same))
    wanted = wanted.where(F.when(F.col("__same") > 1, doubled.cast("boolean")).otherwise(True)).drop("__same")
    condition = F.col("__wanted") == F.col(pk)
    if time is not None:
        seen, at = F.col(time), F.col("__stamp")
        condition = condition & ((seen <= at) if everyone.inclusive else (seen < at))
    rows = wanted.join(node.rows, condition, how)
    return rows.withColumn(pk, F.col("__wanted")), carried


def _shown(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def _export(df: DataFrame, name: str):
    """Decimals stay exact while they are summed and leave the engine as doubles."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name).cast("double").alias(name)
    return F.col(name)


def assert_keys(graph: CompressionGraph) -> None:
    """Keys that must be unique: the entity's, those looked up, and declared primary keys."""
    entity = graph.relation(graph.entity)
    assert_unique(entity.prepared(graph.keys_of(entity.name)), [entity.pk_col])
    for edge in graph.edges:
        child = graph.relation(edge.child)
        if not edge.reduce:
            assert_unique(child.prepared([edge.child_key]), [child.col(edge.child_key)])
        elif child.unique_pk and child.pk != edge.child_key:
            assert_unique(child.prepared([edge.child_key]), [child.pk_col])


def shared_columns(schemas: Sequence[Sequence[str]]) -> list[str]:
    """Columns present in every frame, in the first frame's order."""
    if not schemas:
        return []
    common = set(schemas[0]).intersection(*map(set, schemas[1:]))
    return [c for c in schemas[0] if c in common]
