"""relpoint: point-in-time relational feature frames on Spark."""

from relpoint.plans.compiler import FrozenPlan, compile_graph
from relpoint.spec import CompressionGraph, Edge, Relation

__all__ = ["CompressionGraph", "Edge", "FrozenPlan", "Relation", "compile_graph"]
