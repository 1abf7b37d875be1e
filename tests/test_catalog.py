"""Registered queries: complete, and equal to their SQL on the small tables."""

import pytest

import __spark_entry__ as driver
from relpoint import catalog
from tests.oracle import differences, duck_rows, spark_rows

SAMPLE = (
    "customer_frame_base", "customer_frame_multihop", "event_sequence", "label_conditional",
    "supplier_history_star", "training_frame", "metrics_classification", "schedule_train",
    "tree_scores", "tree_stages",
)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(driver.queries()) >= set(catalog.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    got = spark_rows(driver.queries()[name](spark, sf))
    assert not differences(got, duck_rows(driver.oracle_sql()[name], sf))


def test_entry(spark, sf):
    assert driver.entry(spark).columns[:2] == ["cutoff", "cus_c_custkey"]
