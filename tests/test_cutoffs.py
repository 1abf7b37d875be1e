from datetime import datetime, timedelta

import pytest

from relpoint.plans.cutoffs import (
    even_sample,
    latest_train_cutoff,
    observed_cutoffs,
    outside_schedule,
    sampled_schedule,
    schedule_frame,
    single_cutoff_rows,
    split_cutoffs,
    stratified_sample,
    stride_sample,
    time_bounds,
)

VAL, TEST, DELTA = datetime(2020, 4, 1), datetime(2020, 7, 1), timedelta(days=30)


def test_latest_train_cutoff():
    assert latest_train_cutoff(VAL, DELTA) == datetime(2020, 3, 2)


def test_split_schedules():
    first, last = datetime(2020, 1, 15), datetime(2020, 9, 1)
    train = split_cutoffs("train", VAL, TEST, DELTA, first, last)
    assert train == [datetime(2020, 2, 1), datetime(2020, 3, 2)]
    assert split_cutoffs("val", VAL, TEST, DELTA, first, last, 9)[-1] <= TEST - DELTA
    assert split_cutoffs("test", VAL, TEST, DELTA, first, last, 9)[-1] <= last - DELTA
    assert split_cutoffs("test", VAL, TEST, DELTA, first, last) == [TEST]
    with pytest.raises(ValueError):
        split_cutoffs("other", VAL, TEST, DELTA, first, last)


def test_schedule_frame_equals_lists(spark):
    times = [datetime(2020, 1, 15), datetime(2020, 9, 1)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    rows = schedule_frame(time_bounds([(df, "t"), (df, "t")]), VAL, TEST, 30, 3).collect()
    for split in ("train", "val", "test"):
        got = sorted(r["cutoff"] for r in rows if r["split"] == split)
        assert got == split_cutoffs(split, VAL, TEST, DELTA, *times, eval_count=3)


def test_stratified_sample(spark):
    values = [datetime(2001, 1, 1) + timedelta(days=91 * i) for i in range(46)]
    picked = stratified_sample(values, 15)
    assert len(set(picked)) == 15 and picked == sorted(picked) and picked[-1] == values[-1]
    for i, value in enumerate(picked[:-1]):
        assert values[i * 45 // 14] <= value < values[min(45, (i + 1) * 45 // 14 + 1)]
    assert stratified_sample(values, 1) == values[-1:]
    assert stratified_sample(values[:3], 15) == values[:3]
    with pytest.raises(ValueError):
        stratified_sample(values, 0)
    schedule = spark.createDataFrame([(v,) for v in values], "cutoff timestamp_ntz")
    marked = sampled_schedule(schedule, 15, 10).where("stratified = 1").collect()
    assert sorted(r["cutoff"] for r in marked) == picked


def test_even_and_stride_samples():
    values = list(range(19))
    assert even_sample(values, 5) == [0, 4, 9, 14, 18]
    assert even_sample(values[:4], 5) == values[:4]
    assert even_sample(values, None) == values
    with pytest.raises(ValueError):
        even_sample(values, 1)
    assert stride_sample(values, 10) == [0, 10, 18]
    assert stride_sample(values, 10, keep_last=False) == [0, 10]
    assert stride_sample(values, 9) == [0, 9, 18]


def test_sampled_schedule_marks(spark):
    moments = [datetime(2001 + i, 1, 1) for i in range(19)]
    df = spark.createDataFrame([(m,) for m in moments], "cutoff timestamp_ntz")
    rows = sampled_schedule(df, 5, 10).orderBy("cutoff").collect()
    assert [i for i, r in enumerate(rows) if r["even"]] == [0, 4, 9, 14, 18]
    assert [i for i, r in enumerate(rows) if r["strided"]] == [0, 10, 18]
    strata = [i for i, r in enumerate(rows) if r["stratified"]]
    assert len(strata) == 5 and strata[-1] == 18
    assert all(i * 18 // 4 <= v < (i + 1) * 18 // 4 for i, v in enumerate(strata[:-1]))


def test_single_cutoff_and_containment(spark):
    days = [datetime(2020, 1, 1), datetime(2020, 1, 2), datetime(2020, 1, 2)]
    task = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "t timestamp_ntz, e int")
    assert single_cutoff_rows(task, "t", "train", days[1]).count() == 2
    assert {r["t"] for r in single_cutoff_rows(task, "t", "train", VAL).collect()} == {days[1]}
    assert {r["t"] for r in single_cutoff_rows(task, "t", "val", VAL).collect()} == {days[0]}
    schedule = spark.createDataFrame([(days[0],)], "cutoff timestamp_ntz")
    assert [r["cutoff"] for r in outside_schedule(observed_cutoffs(task, "t"), schedule).collect()] == [days[1]]
