import math
import random

import numpy as np
from pyspark.sql import functions as F

from relpoint.llm.hard_negatives import Half, _visits, _with_state, build, by_bound, fitted, hard_negatives, quantised

SCHEMA = "vec_id long, embedding array<double>, label int, id string, q int"


def slow(rows, every=100, positives=5, negatives=5, low=80, high=100):
    own = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * x) for x in vector]
        if sum(256 * x * (256 * x) for x in vector) < 2.0**60:
            own[i] = max(own.get(i, (label, q)), (label, q))
    found = []
    for a, (label, q) in own.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, r)), i, kind == label) for i, (kind, r) in own.items() if i != a)
        for p, i, _ in [s for s in scores if s[2]][:positives]:
            inside = [s for s in scores if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            found += [(a, i, k, j, -p, -n) for k, (n, j, _) in enumerate(inside, 1)]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)


def read(df):
    columns = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    return sorted(tuple(r) for r in df.select(*columns).collect())


def mixed(seed=11, n=260, dim=6):
    """Clusters, copies, ties, zeros, negative scores, other lengths, nulls, repeated ids and huge values."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [
        (k, [round(c + rng.gauss(0, 0.3), 2) for c in centres[rng.randrange(5)]], rng.randrange(3)) for k in range(n)
    ]
    copy = rows[5][1]
    rows += [(1000 + k, copy, k % 3) for k in range(80)]
    rows += [(1100 + k, [0.0] * dim, k % 2) for k in range(8)]
    rows += [(1200, copy[:3], 1), (1210, [*copy, 2.0, 3.0], 2), (1220, [], 0), (1230, None, 1), (1240, copy, None), (None, copy, 1)]
    rows += [(1250, [None, 1.0], 1), (1260, [math.nan], 1), (1270, [math.inf], 0), (1280, [1e300] * dim, 0), (1290, [-1.0] * dim, 1)]
    return rows + [(10, copy, 2), rows[3], (1300, [4e5] * dim, 1), (1310, [4e5] * dim, 2), (1320, [4e5, 3e5, 4e5], 2)]


def test_matches_brute_force(spark):
    rows = mixed()
    expected = slow(rows, 10)
    assert len({r[0] for r in expected}) > 20 and any(r[4] == 0 for r in expected)
    vectors = quantised(table(spark, rows))
    for codes, block in ((4, 16), (1, 1024)):
        assert read(hard_negatives(vectors, F.col("id") % 10 == 0, codes=codes, block=block)) == expected


def test_limits_are_parameters(spark):
    rows = mixed(12, 120)
    vectors = quantised(table(spark, rows))
    got = hard_negatives(vectors, F.col("id") % 20 == 0, 2, 3, 50, 90, codes=3, sample=50, block=8)
    assert read(got) == slow(rows, 20, 2, 3, 50, 90)


def test_walk_falls_and_is_whole():
    rng = np.random.default_rng(1)
    first, second = rng.normal(size=7), np.repeat(rng.normal(size=3), 2)
    walk = list(by_bound(first, second))
    assert [b for b, _, _ in walk] == sorted((b for b, _, _ in walk), reverse=True)
    assert {(i, j) for _, i, j in walk} == {(i, j) for i in range(7) for j in range(6)}
    assert all(abs(first[i] + second[j] - b) < 1e-12 for b, i, j in walk)


def test_certified_windows_spare_cells(spark):
    """Tight clusters: once five near rows are known, cells of far clusters are not visited."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(k, (centres[k % 8] + rng.normal(size=16) * 0.01).tolist(), 0) for k in range(400)]
    vectors = quantised(table(spark, rows))
    index = build(vectors, codes=8)
    every = F.expr("array(struct(0 as w, -9223372036854775807L as low, 9223372036854775807L as high))")
    asks = vectors.where("id % 50 = 0").withColumn("windows", every)
    assert asks.count() == 8 and len(index.filled) >= 8
    q = {r["id"]: np.array(r["q"]) for r in vectors.collect()}
    best = [
        (a, 0, o, int(s), k)
        for a in range(0, 400, 50)
        for k, (s, o) in enumerate(sorted(((int(q[a] @ q[o]), -o) for o in q if o != a), reverse=True)[:5], 1)
    ]
    best = [(a, w, -o, s, k) for a, w, o, s, k in best]
    known = spark.createDataFrame(best, "id long, w int, other_id long, score long, rank int")
    blind = _visits(_with_state(asks, None, 5), index, 0, 64).count()
    sure = _visits(_with_state(asks, known, 5), index, 0, 64).count()
    assert blind == 8 * len(index.filled) and sure < blind / 2


def test_codes_and_empty_tables(spark):
    x = np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]])
    assert fitted(x, 4).tolist() == [[1, 2], [3, 4]] and fitted(x[:0], 4).shape == (1, 2)
    assert Half(2, None, np.zeros((1, 3)), np.zeros(1)).of(np.ones((2, 3))).tolist() == [[1, 0, 0]] * 2
    assert hard_negatives(quantised(table(spark, []))).count() == 0
    assert hard_negatives(quantised(table(spark, [(100, [1.0], 1)]))).count() == 0
    assert hard_negatives(quantised(table(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]))).count() == 1
