"""Boosted trees as a table: one row per node, scored by Column expressions, cut short by validation.

A fitted model is turned into rows (tree, node, feature, threshold, value), which can be stored, compared
and scored without Spark ML: scoring is a projection, with no join, no vector column and no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "tree int, weight double, node int, feature string, threshold double, value double"

_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_TREE = re.compile(r"Tree (\d+) \(weight (\S+)\):")


@dataclass(frozen=True)
class Node:
    """Node k of a tree has children 2k (value at most the threshold) and 2k + 1 (all else, NULL and NaN
    too). A leaf has a value and no feature."""

    tree: int
    weight: float
    node: int
    feature: str | None
    threshold: float | None
    value: float | None


def _below(lines: Iterator[str], tree: int, weight: float, node: int, features: Sequence[str]) -> Iterator[Node]:
    line = next(lines)
    if line.startswith("Predict:"):
        yield Node(tree, weight, node, None, None, float(line.split()[1]))
        return
    split = _SPLIT.fullmatch(line)
    if split is None:
        raise ValueError(f"not a split on a number: {line}")
    yield Node(tree, weight, node, features[int(split[1])], float(split[2]), None)
    yield from _below(lines, tree, weight, 2 * node, features)
    next(lines)
    yield from _below(lines, tree, weight, 2 * node + 1, features)


def _value(bin_: float, splits: Sequence[float]) -> float:
    """The largest value in bins up to this one; the bin of missing values lies above the last."""
    above = math.floor(bin_) + 1
    return math.nextafter(splits[above], -math.inf) if above < len(splits) - 1 else math.inf


@dataclass(frozen=True)
class Ensemble:
    """Weighted sum of trees. With ``classify`` the score is the probability of label 1, else the sum."""

    nodes: tuple[Node, ...]
    classify: bool

    @classmethod
    def of(cls, model: PipelineModel, features: Sequence[str]) -> Ensemble:
        """Trees of a fitted pipeline of this package; ``features`` in the order they were fitted in."""
        boosted = model.stages[-1]
        edges = {}
        for stage in model.stages:
            if isinstance(stage, Bucketizer):
                edges |= dict(zip(stage.getInputCols(), stage.getSplitsArray()))
        lines = iter([line.strip() for line in boosted.toDebugString.splitlines()[1:] if line.strip()])
        nodes: list[Node] = []
        for line in lines:
            head = _TREE.fullmatch(line)
            if head is None:
                raise ValueError(f"not the head of a tree: {line}")
            own = _below(lines, int(head[1]), float(head[2]), 1, features)
            nodes += (replace(n, threshold=_value(n.threshold, edges[n.feature])) if n.feature in edges else n for n in own)
        return cls(tuple(nodes), hasattr(boosted, "numClasses"))

    @classmethod
    def read(cls, table: DataFrame, classify: bool) -> Ensemble:
        """Trees from their table. It is as large as the model, which plans have to hold anyway."""
        rows = table.select("tree", "weight", "node", "feature", "threshold", "value").orderBy("tree", "node").collect()
        return cls(tuple(Node(*r) for r in rows), classify)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n.tree, n.weight, n.node, n.feature, n.threshold, n.value) for n in self.nodes]
        return spark.createDataFrame(rows, NODES)

    def trees(self) -> list[int]:
        return sorted({n.tree for n in self.nodes})

    def first(self, trees: int) -> Ensemble:
        """The first trees only."""
        kept = set(self.trees()[:trees])
        return replace(self, nodes=tuple(n for n in self.nodes if n.tree in kept))

    def values(self) -> list[Column]:
        """Weighted answer of each tree, in order."""
        found = []
        for tree in self.trees():
            own = {n.node: n for n in self.nodes if n.tree == tree}
            found.append(F.lit(own[1].weight) * self._answer(own, 1))
        return found

    def _answer(self, own: dict[int, Node], at: int) -> Column:
        node = own[at]
        if node.feature is None:
            return F.lit(node.value)
        low, high = self._answer(own, 2 * at), self._answer(own, 2 * at + 1)
        return F.when(F.col(f"`{node.feature}`").cast("double") <= F.lit(node.threshold), low).otherwise(high)

    def margin(self) -> Column:
        return sum(self.values(), F.lit(0.0))

    def score(self) -> Column:
        return probability(self.margin()) if self.classify else self.margin()


def probability(margin: Column) -> Column:
    """Probability of label 1; the margin is half its log odds."""
    return 1 / (1 + F.exp(-2 * margin))


def stage_losses(ensemble: Ensemble, validation: DataFrame, target: str) -> list[float | None]:
    """Mean loss after the first 1, 2, ... trees: log loss of a classifier, else the absolute error.

    All stages are added up in one pass over the rows. Rows without a target don't count; without any,
    the losses are None.
    """
    values = ensemble.values()
    names = [f"__v{i}" for i in range(len(values))]
    rows = validation.where(F.col(target).isNotNull()).select(
        F.col(target).cast("double").alias("__y"), *(v.alias(n) for v, n in zip(values, names))
    )
    losses, margin = [], F.lit(0.0)
    for name in names:
        margin = margin + F.col(name)
        if ensemble.classify:
            loss = F.log1p(F.exp(F.when(F.col("__y") > 0, -2 * margin).otherwise(2 * margin)))
        else:
            loss = F.abs(F.col("__y") - margin)
        losses.append(F.avg(loss))
    return list(rows.agg(*(x.alias(n) for x, n in zip(losses, names))).first())


def stop_early(ensemble: Ensemble, validation: DataFrame, target: str) -> Ensemble:
    """The trees up to the stage of least validation loss, the first of equals; all without targets."""
    losses = stage_losses(ensemble, validation, target)
    known = [(loss, k) for k, loss in enumerate(losses, 1) if loss is not None]
    return ensemble.first(min(known)[1]) if known else ensemble
