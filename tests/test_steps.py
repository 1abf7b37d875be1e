"""Features below a hop at the cutoffs where they change, against a row per cutoff."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relpoint.functions.timegrid import CUT, FROM, TO, CutoffGrid
from relpoint.operators.reduce import (
    KEY,
    ColumnPlan,
    Feature,
    Reduction,
    Scope,
    ValueColumn,
    _meet_versions,
    reduce_hops,
    reduce_rows,
    reduce_steps,
    value_profile,
    versions,
)
from relpoint.spec import Relation

START = datetime(2020, 1, 1)
CUTOFFS = tuple(START + timedelta(days=30 * k) for k in range(1, 13))


def _rows(spark):
    rows = []
    for i in range(300):
        seen = None if i % 11 == 0 else START + timedelta(days=i * 53 % 400)
        flag = None if i % 7 == 0 else "abc"[i * i % 3]
        rows.append((i, i % 40, START + timedelta(days=i * 37 % 380), seen, i % 13, flag))
    return spark.createDataFrame(rows, f"id bigint, {KEY} bigint, t timestamp_ntz, seen timestamp_ntz, x bigint, flag string")


@pytest.mark.parametrize("lookback", [None, 75])
@pytest.mark.parametrize("masks", [{}, {"x": "seen", "flag": "seen"}])
def test_steps_equal_rows_per_cutoff(spark, lookback, masks):
    rows, grid = _rows(spark), CutoffGrid(CUTOFFS, lookback_days=lookback)
    relation = Relation("r", rows, "id", "r", "t", stats=("count", "sum", "max", "std", "nunique", "mode"), unique_pk=True)
    plan = ColumnPlan(numeric=("x",), categorical=("flag",))
    last = len(CUTOFFS) - 1
    dense = reduce_rows(rows, relation, plan, Scope(grid, "t", False, masks))
    steps = reduce_steps(rows, relation, plan, Scope(grid, "t", False, masks))
    every = dense.df.toPandas().set_index([CUT, KEY])
    for part in steps:
        spans = versions(part, last)
        assert spans.select(F.sum(F.col("until") - F.col("since") + 1)).first()[0] == 40 * len(CUTOFFS)
        for row in spans.collect():
            for cut in range(row["since"], row["until"] + 1):
                found = every.loc[(cut, row[KEY])] if (cut, row[KEY]) in every.index else None
                for f in part.features:
                    want = None if found is None or found[f.name] != found[f.name] else found[f.name]
                    if f.kind == "count":
                        assert (row[f.name] or 0) == (want or 0), (cut, row, f)
                    elif isinstance(want, float):
                        assert row[f.name] == pytest.approx(want), (cut, row, f)
                    else:
                        assert row[f.name] == want, (cut, row, f)


def test_values_are_not_copied_per_cutoff(spark):
    # 2,000 values seen once, at 24 cutoffs: no shuffle carries a row per value and cutoff.
    cutoffs = tuple(START + timedelta(days=k) for k in range(24))
    rows = spark.range(2000).select(F.lit(1).alias(KEY), F.lit(START - timedelta(days=9)).alias("t"), F.col("id").cast("string").alias("v"))
    column = [ValueColumn("v", F.col("v"), ("nunique",))]
    found = value_profile(rows, column, Scope(CutoffGrid(cutoffs), "t", True)).df
    assert [r["v_nunique"] for r in found.collect()] == [2000] * 24
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    copies = final.index("explode(sequence")
    # Operators above the copies come first in the plan: the values were folded below them.
    assert "v#" not in final[:copies].replace("__v0", "")


def test_rows_that_lead_nowhere_spread_over_tasks(spark):
    located = spark.range(4000).select(
        (F.col("id") % 50).alias(KEY), F.lit(0).alias(FROM), F.lit(3).alias(TO),
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("order"),
    )
    below = spark.range(4000).select(F.col("id").alias(KEY), F.lit(1).alias(CUT), F.lit(7).alias("n"))
    child = Reduction(below, (Feature("n"),), True)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        grid = CutoffGrid(CUTOFFS[:4])
        met = _meet_versions(located, [(child, "order")], Scope(grid, "t", True))
        nulls = met.where(F.col("order").isNull())
        sizes = [r["count"] for r in nulls.groupBy(F.spark_partition_id()).count().collect()]
        assert nulls.where(F.col("n").isNotNull()).isEmpty()
        assert sum(sizes) == 3600 and max(sizes) < 1800
        assert met.where(F.col("n") == 7).count() == 400
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_looked_up_values_are_folded_from_two_cutoffs_on():
    assert Scope.of(CutoffGrid(CUTOFFS[:3]), "t", "auto", {"x": "seen"}).bucket
    assert not Scope.of(CutoffGrid(CUTOFFS[:3]), "t", "auto").bucket
    assert not Scope.of(CutoffGrid(CUTOFFS[:3]), "t", "expand", {"x": "seen"}).bucket


def test_copied_rows_that_lead_nowhere_are_scattered(spark):
    rows = spark.range(400).select(
        (F.col("id") % 5).alias(KEY), F.lit(START).cast("timestamp_ntz").alias("t"),
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("order"),
    )
    below = spark.range(400).select(F.col("id").alias(KEY), F.lit(1).alias(CUT), F.lit(7).cast("bigint").alias("n"))
    grid = CutoffGrid(CUTOFFS[:3])
    child = Reduction(below, (Feature("n", "count"),), True)
    found = reduce_hops(rows, [(child, "order")], Scope(grid, "t", False), grid, ("sum",)).df
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r[CUT], r[KEY]): r["n_sum"] for r in found.collect()}
    assert got == {(c, k): (280 if c == 1 and k == 0 else 0) for c in range(3) for k in range(5)}


@pytest.mark.parametrize("lookback", [None, 75])
def test_changes_as_bits_equal_changes_as_sets(spark, lookback, monkeypatch):
    from relpoint.functions import timegrid

    grid = CutoffGrid(CUTOFFS, lookback_days=lookback)
    cells = grid.locate(_rows(spark), "t")
    cells = cells.withColumn("e", F.greatest(FROM, grid.entry(F.col("seen"))))
    by_bits = grid.spread_steps(cells, KEY, ["e"])
    plan = by_bits._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and "collect_set" not in plan
    monkeypatch.setattr(timegrid, "MASK_BITS", 0)
    by_sets = grid.spread_steps(cells, KEY, ["e"])
    assert by_bits.columns == by_sets.columns
    assert sorted(by_bits.collect(), key=str) == sorted(by_sets.collect(), key=str)
