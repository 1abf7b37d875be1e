from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relpoint.functions.timegrid import CUT, CutoffGrid, epoch_micros

START = datetime(2020, 1, 1)
hours = st.integers(0, 24 * 40)


def visible(t, cutoff, inclusive, days):
    if inclusive:
        return t <= cutoff and (days is None or t > cutoff - timedelta(days=days))
    return t < cutoff and (days is None or t >= cutoff - timedelta(days=days))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    cutoffs=st.sets(hours, min_size=1, max_size=5),
    step=st.sampled_from([1, 24]),
    times=st.lists(hours, min_size=1, max_size=30),
    inclusive=st.booleans(),
    lookback=st.sampled_from([None, 1, 5, 12]),
    windows=st.sampled_from([(), (1, 3), (2, 7, 30)]),
)
def test_rows_reach_exactly_the_cutoffs_that_see_them(spark, cutoffs, step, times, inclusive, lookback, windows):
    cuts = tuple(sorted({START + timedelta(hours=h // step * step) for h in cutoffs}))
    stamps = [START + timedelta(hours=h) for h in times]
    grid = CutoffGrid(cuts, inclusive, lookback, windows)
    df = spark.createDataFrame(list(enumerate(stamps)), "i int, t timestamp_ntz")
    rows = grid.spread(grid.locate(df, "t"))
    flags = [grid.in_window(w).alias(f"w{w}") for w in windows]
    got = {(r["i"], r[CUT]): r for r in rows.select("i", CUT, *flags).collect()}
    want = {
        (i, o) for i, t in enumerate(stamps) for o, c in enumerate(cuts) if visible(t, c, inclusive, lookback)
    }
    assert set(got) == want
    for (i, o), row in got.items():
        for w in windows:
            assert row[f"w{w}"] == visible(stamps[i], cuts[o], inclusive, w)


def test_future_windows_are_half_open(spark):
    cut = datetime(2020, 1, 10)
    grid = CutoffGrid.future([cut], timedelta(days=7))
    moments = [cut, cut + timedelta(microseconds=1), cut + timedelta(days=7), cut + timedelta(days=7, microseconds=1)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    assert sorted(r["t"] for r in grid.locate(df, "t").collect()) == moments[1:3]


def test_null_times_and_zoned_times(spark):
    grid = CutoffGrid((datetime(2020, 1, 2), datetime(2020, 1, 3)), True)
    df = spark.createDataFrame([(datetime(2020, 1, 2),), (None,)], "t timestamp_ntz")
    assert grid.spread(grid.locate(df, "t")).count() == 2
    zoned = df.select(F.col("t").cast("timestamp").alias("t"))
    assert grid.spread(grid.locate(zoned, "t")).count() == 2


def test_unknown_window_is_rejected():
    with pytest.raises(ValueError):
        CutoffGrid((START,), windows=(7,)).in_window(8)
    with pytest.raises(ValueError):
        CutoffGrid((START, START))


def test_epoch_micros(spark):
    moments = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29, 13, 14, 15, 161718)]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp_ntz")
    zero = datetime(1970, 1, 1)
    got = [r[0] for r in df.select(epoch_micros(F.col("t"))).collect()]
    assert got == [(m - zero) // timedelta(microseconds=1) for m in moments]
