import random

import numpy as np
import pytest

from relpoint.llm.components import components, union_find


def by_search(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = start
                todo += near[node]
    return found


def test_union_find_matches_a_search():
    rng = random.Random(3)
    for n in (1, 5, 60):
        edges = [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(n)]
        nodes, root = union_find(*(np.array(x) for x in zip(*edges)))
        assert dict(zip(nodes.tolist(), root.tolist())) == by_search(edges)


@pytest.mark.parametrize("task_edges", [1_000_000, 8])
def test_components_with_and_without_contraction(spark, task_edges):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(200, k) for k in range(201, 230)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(40)] + [(7, 7), (300, 300), (60, 61), (60, 61)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long").repartition(3)
    found = components(frame, task_edges)
    assert {r["node"]: r["component"] for r in found.collect()} == by_search(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
