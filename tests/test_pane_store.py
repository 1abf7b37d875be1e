"""A store of partial results equals a fresh build, whatever came late."""

import random
import uuid
from datetime import datetime, timedelta
from statistics import pstdev

import pytest

from relpoint.sources.panes import PaneStore

START = datetime(2020, 1, 1)
CUTS = [START + timedelta(days=d) for d in (2, 9, 16, 30, 31)]
SCHEMA = "k bigint, t timestamp_ntz, x double, y int"


def facts(seed=1, n=400):
    rng = random.Random(seed)
    return [
        (0 if i % 3 == 0 else rng.choice([None, 1, 2, 3]), None if rng.random() < 0.05 else START + timedelta(hours=rng.randrange(40 * 24)),
         rng.choice([None, round(rng.uniform(-9, 9), 2)]), rng.randrange(100))
        for i in range(n)
    ]


@pytest.fixture
def store(spark, tmp_path):
    names = []

    def make(days=1, columns=("x", "y")):
        names.append(f"panes_{uuid.uuid4().hex}")
        return PaneStore(spark, names[-1], "k", "t", columns, days, 4, str(tmp_path / names[-1]))

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))
    return a == b


def rows_of(df):
    return {(r["cutoff"], r["k"]): r.asDict() for r in df.collect()}


def assert_same(left, right):
    assert left.keys() == right.keys() and left
    for key, row in left.items():
        assert all(close(v, right[key][name]) for name, v in row.items()), (key, row, right[key])


def test_three_appends_with_late_rows_equal_a_fresh_build(spark, store):
    rows = facts()
    fresh, grown = store(), store()
    fresh.add(spark.createDataFrame(rows, SCHEMA))
    dated = sorted((r for r in rows if r[1]), key=lambda r: r[1])
    # The last 30 rows of the first part come with the third append: late by weeks.
    first, late = dated[:120], dated[120:150]
    for part in (first, dated[150:300], dated[300:] + late + [r for r in rows if not r[1]], []):
        grown.add(spark.createDataFrame(part, SCHEMA))
    assert grown.partials().count() > fresh.partials().count()
    expected = rows_of(fresh.features(CUTS, (2, 7)))
    assert_same(rows_of(grown.features(CUTS, (2, 7))), expected)
    small = grown.compact(f"{grown.name}_small", f"{grown.path}-small")
    assert small.partials().count() == fresh.partials().count()
    assert_same(rows_of(small.features(CUTS, (2, 7))), expected)
    spark.sql(f"DROP TABLE {small.name}")


@pytest.mark.parametrize("lookback", [None, 10])
def test_against_brute_force(spark, store, lookback):
    rows, panes = facts(2), store(2)
    panes.add(spark.createDataFrame(rows, SCHEMA))
    cuts = [c for c in CUTS if not (c - datetime(1970, 1, 1)).days % 2]
    got = rows_of(panes.features(cuts, (4,), lookback))
    seen = 0
    for c in cuts:
        for k in (0, 1, 2, 3):
            floor = datetime.min if lookback is None else c - timedelta(days=lookback)
            own = [r for r in rows if r[0] == k and r[1] and floor <= r[1] < c]
            if not own:
                assert (c, k) not in got
                continue
            seen += 1
            r, xs = got[c, k], [x[2] for x in own if x[2] is not None]
            inside = [x for x in own if x[1] >= c - timedelta(days=4)]
            assert r["n_rows"] == len(own) and r["n_rows_4d"] == len(inside)
            assert close(r["x_sum"], sum(xs) if xs else None) and close(r["x_std"], pstdev(xs) if xs else None)
            assert (r["x_min"], r["x_max"]) == ((min(xs), max(xs)) if xs else (None, None))
            assert r["y_sum_4d"] == (sum(x[3] for x in inside) if inside else None)
            assert (r["first_time"], r["last_time"]) == (min(x[1] for x in own), max(x[1] for x in own))
    assert seen > 6


def test_reads_without_a_shuffle(spark, store):
    panes = store()
    panes.add(spark.createDataFrame(facts(3), SCHEMA))
    df = panes.features(CUTS, (2,))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" in plan
    assert panes.features(CUTS[:1]).count() > 0


def test_edges_are_checked(store):
    panes = store(7)
    with pytest.raises(ValueError, match="does not lie on an edge"):
        panes.features([datetime(2020, 1, 3)])
    with pytest.raises(ValueError, match="not made of panes"):
        panes.features([datetime(2020, 1, 2)], (3,))
