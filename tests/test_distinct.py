"""Distinct counts: runs between occurrences, sketches, thresholds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relpoint import CompressionGraph, Edge, Relation
from relpoint.functions.timegrid import FROM, PANE, TO, CutoffGrid
from relpoint.operators.labels import Measure, window_measures
from relpoint.operators.profile import ManifestSource, columns_above, manifest, top_values, with_manifests

START = datetime(2020, 1, 1)


def events(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [
        (rng.choice([None, 1, 1, 1, 2, 3]), None if rng.random() < 0.05 else START + timedelta(hours=rng.randrange(60 * 24)), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, True, False]))
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, "k bigint, t timestamp_ntz, v string, ok boolean")


@pytest.mark.parametrize("step,days,past", [(1, 7, False), (3, 7, True), (10, 4, False), (60, 30, False)])
def test_windowed_distinct_counts(spark, step, days, past):
    rows, df = events(spark)
    cuts, width = [START + timedelta(days=d) for d in range(1, 60, step)], timedelta(days=days)
    measures = [
        Measure("n", "nunique", F.col("v")),
        Measure("good", "nunique", F.col("v"), F.col("ok")),
        Measure("about", "sketch", F.col("v"), F.col("ok")),
        Measure("rows", "count"),
    ]
    got = {(r["cutoff"], r["k"]): tuple(r)[2:] for r in window_measures(df, "k", "t", cuts, width, measures, past).collect()}
    expected = {}
    for c in cuts:
        low, high = (c - width, c) if past else (c, c + width)
        for k in (1, 2, 3):
            inside = [r for r in rows if r[0] == k and r[1] is not None and low < r[1] <= high]
            if inside:
                good = len({r[2] for r in inside if r[3]} - {None})
                expected[c, k] = (len({r[2] for r in inside} - {None}), good, good, len(inside))
    assert got == expected


def test_no_row_per_value_and_cutoff(spark):
    """The copies over cutoffs hold counts, not values."""
    _, df = events(spark)
    cuts = [START + timedelta(days=d) for d in range(1, 51)]
    found = window_measures(df, "k", "t", cuts, timedelta(days=30), [Measure("n", "nunique", F.col("v"))])
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    copies = [line for line in lines if "Generate explode(sequence(" in line]
    assert copies and not any("__value" in line for line in copies)


def test_runs_do_not_overlap(spark):
    grid = CutoffGrid(tuple(START + timedelta(days=d) for d in range(0, 40, 2)), True, 9)
    df = spark.createDataFrame([(1, START + timedelta(days=d)) for d in (0, 1, 5, 6, 30)], "k int, t timestamp_ntz")
    located = grid.locate(df, "t").select("k", PANE, FROM, TO).distinct()
    runs = sorted((r[FROM], r[TO]) for r in grid.runs(located, ["k"]).collect())
    covered = [c for a, b in runs for c in range(a, b + 1)]
    assert len(covered) == len(set(covered))
    assert set(covered) == {c for r in located.collect() for c in range(r[FROM], r[TO] + 1)}


@pytest.mark.parametrize("n", [999, 1000, 1001])
def test_threshold_is_exact(spark, n):
    df = spark.range(20_000).select(
        F.col("id"),
        F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias("edge"),
        F.concat(F.lit("free text "), F.col("id").cast("string")).alias("free"),
        F.when(F.col("id") > 10, "x").alias("few"),
        F.lit(None).cast("string").alias("none"),
    )
    columns = ["edge", "free", "few", "none"]
    assert columns_above(df, columns, 1000) == (["edge", "free"] if n > 1000 else ["free"])
    assert columns_above(df, [], 5) == [] and columns_above(df.limit(0), columns, 0) == []
    source = ManifestSource("id")
    roles = {r["column"]: r["role"] for r in manifest(df, source, exact=False).collect()}
    assert roles == {r["column"]: r["role"] for r in manifest(df, source).collect()}
    assert roles["edge"] == ("categorical" if n <= 1000 else "dropped")
    found, out = top_values(df, columns, 3, 1000)
    assert set(out) == ({"edge", "free"} if n > 1000 else {"free"}) and found["few"] == ("x",)
    users = Relation("users", spark.range(3).toDF("uid"), "uid", "u")
    facts = Relation("facts", df.withColumn("u", F.col("id") % 3), "id", "f")
    graph = CompressionGraph("users", (users, facts), (Edge("users", "facts", "uid", "u"),), (START,))
    narrowed = with_manifests(graph, {"facts": source}, START).relation("facts")
    assert ("edge" in narrowed.columns) == (n <= 1000) and "free" not in narrowed.columns
