import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relpoint.functions.scalars import is_truthy
from relpoint.functions.timegrid import CutoffGrid
from relpoint.operators.history import latest_record, latest_record_at, latest_value, modes
from relpoint.operators.labels import (
    Measure,
    active_by,
    asof_flag,
    drop_dangling,
    eligible,
    entity_cutoffs,
    keep_active,
    label_table,
    outside_unit,
    window_measures,
)

START = datetime(2020, 1, 1)
WEEK = timedelta(days=7)
# Overlapping windows: more than four cutoffs see one event.
DENSE = [START + timedelta(days=d) for d in range(5, 17)]


def events(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [
        (i, rng.choice([None, 0, 0, 0, 1, 2, 3]), START + timedelta(hours=rng.randrange(30 * 24)),
         rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None]))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "id bigint, k bigint, t timestamp_ntz, v bigint, g string")


@pytest.mark.parametrize("cutoffs", [DENSE[:2], DENSE])
@pytest.mark.parametrize("past", [False, True])
def test_window_measures(spark, cutoffs, past):
    rows, df = events(spark)
    measures = [
        Measure("n", "count"),
        Measure("s", "sum", F.col("v")),
        Measure("a", "avg", F.col("v"), F.col("g") == "x"),
        Measure("d", "nunique", F.col("v"), F.col("g") == "x"),
    ]
    got = {(r["cutoff"], r["k"]): r for r in window_measures(df, "k", "t", cutoffs, WEEK, measures, past).collect()}
    keys = set()
    for cut in cutoffs:
        lo, hi = (cut - WEEK, cut) if past else (cut, cut + WEEK)
        for k in range(4):
            inside = [r for r in rows if r[1] == k and lo < r[2] <= hi]
            if not inside:
                continue
            keys.add((cut, k))
            out = got[cut, k]
            vs = [r[3] for r in inside if r[3] is not None]
            xs = [r[3] for r in inside if r[3] is not None and r[4] == "x"]
            assert out["n"] == len(inside)
            assert out["s"] == (sum(vs) if vs else None)
            assert out["d"] == len(set(xs))
            assert out["a"] == (sum(xs) / len(xs) if xs else None)
    assert set(got) == keys


def test_label_table_fills_zero(spark):
    _, df = events(spark)
    keys = entity_cutoffs(spark.createDataFrame([(9,), (0,), (None,)], "e bigint"), "e", DENSE[:2])
    counted = window_measures(df, "k", "t", DENSE[:2], WEEK, [Measure("n", "count")])
    rows = label_table(keys, "e", counted, "k", ["n"]).collect()
    assert len(rows) == 4
    assert {r["n"] for r in rows if r["e"] == 9} == {0}
    assert all(r["n"] > 0 for r in rows if r["e"] == 0)


def test_entities_appear_when_created(spark):
    df = spark.createDataFrame([(1, DENSE[1]), (2, DENSE[0])], "e bigint, born timestamp_ntz")
    got = {(r["cutoff"], r["e"]) for r in entity_cutoffs(df, "e", DENSE[:2], "born").collect()}
    assert got == {(DENSE[0], 2), (DENSE[1], 2), (DENSE[1], 1)}


def test_existence(spark):
    rows, df = events(spark)
    other = spark.createDataFrame([(7, DENSE[3])], "k bigint, t timestamp_ntz")
    sources = [(df.where("k = 2"), "k", "t"), (other, "k", "t")]
    active = active_by(sources, DENSE)
    first = min(r[2] for r in rows if r[1] == 2)
    want = {(c, 2) for c in DENSE if first <= c} | {(c, 7) for c in DENSE[3:]}
    assert {(r["cutoff"], r["key"]) for r in active.collect()} == want
    strict = active_by([(other, "k", "t")], DENSE, inclusive=False)
    assert strict.count() == len(DENSE) - 4
    frame = spark.createDataFrame([(DENSE[0], 7), (DENSE[5], 7)], "cutoff timestamp_ntz, e bigint")
    assert [r["cutoff"] for r in keep_active(frame, "e", sources).collect()] == [DENSE[5]]
    assert eligible(df, "k", "t", DENSE, WEEK).columns == ["cutoff", "k"]


def test_dangling_and_fraction(spark):
    labels = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "e bigint, y double")
    kept = drop_dangling(labels, "e", spark.createDataFrame([(1,), (2,)], "id bigint"), "id")
    assert sorted(r["e"] for r in kept.collect()) == [1, 2]
    assert outside_unit(labels, "y").first()["violations"] == 2


def test_asof_flag(spark):
    t = [START + timedelta(days=d) for d in range(5)]
    rows = spark.createDataFrame([(1, t[1]), (1, t[2]), (2, t[4]), (None, t[4])], "u bigint, at timestamp_ntz")
    signals = spark.createDataFrame([(1, t[2]), (1, t[3]), (None, t[0])], "su bigint, s timestamp_ntz")
    got = asof_flag(rows, "at", signals, "s", [("u", "su")], "hit").collect()
    assert {(r["u"], r["at"]): r["hit"] for r in got} == {(1, t[1]): 0, (1, t[2]): 1, (2, t[4]): 0, (None, t[4]): 0}


def test_truthiness(spark):
    values = ["1", "TRUE", "t", "Yes", "y", "Clicked", "0", "no", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(is_truthy(F.col("v"))).collect()] == [1] * 6 + [0] * 4


def test_latest_and_modes(spark):
    rows, df = events(spark)
    want = {}
    for r in rows:
        if r[1] is not None and (r[1] not in want or (r[2], r[0]) > want[r[1]][:2]):
            want[r[1]] = (r[2], r[0], r[3])
    got = {r["k"]: (r["t"], r["id"], r["v"]) for r in latest_record(df, "k", "t", "id", ["v"]).collect()}
    assert got == want
    for r in latest_record_at(df, "k", "t", "id", ["v"], CutoffGrid(tuple(DENSE))).collect():
        seen = [x for x in rows if x[1] == r["k"] and x[2] < r["cutoff"]]
        assert (r["t"], r["id"]) == max((x[2], x[0]) for x in seen)
    known = df.groupBy("k").agg(latest_value(F.col("v"), F.col("t"), F.col("id")).alias("v")).collect()
    for r in known:
        seen = [x for x in rows if x[1] == r["k"] and x[3] is not None]
        assert r["v"] == max(seen, key=lambda x: (x[2], x[0]))[3]
    for r in modes(df, "k", {"m": F.col("g")}).collect():
        seen = [x[4] for x in rows if x[1] == r["k"] and x[4]]
        assert r["m"] == min(set(seen), key=lambda v: (-seen.count(v), v))
