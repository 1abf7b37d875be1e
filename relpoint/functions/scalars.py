"""Scalar expressions shared by sources, families, labels and model inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as true in a text flag.
TRUE_SPELLINGS = ("1", "true", "t", "yes", "y", "clicked")
# Fixed value: stands for a null category in model inputs.
MISSING_CATEGORY = "__missing__"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL when the denominator is zero or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def safe_double(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def first_amount(*candidates: Column) -> Column:
    """First castable amount of a fallback chain, else 0."""
    return F.coalesce(*(safe_double(c) for c in candidates), F.lit(0.0))


def is_truthy(value: Column) -> Column:
    """1 when the text form of the value is one of the true spellings, else 0."""
    return F.when(F.lower(value.cast("string")).isin(*TRUE_SPELLINGS), 1).otherwise(0)


def indicator(condition: Column) -> Column:
    """1.0 when true; 0.0 when false or unknown."""
    return F.when(condition, 1.0).otherwise(0.0)


def differs_or_null(value: Column, other: object) -> Column:
    return value.isNull() | (value != F.lit(other))


def day_difference(later: Column, earlier: Column) -> Column:
    """Number of calendar-day boundaries between two timestamps."""
    return F.datediff(later.cast("date"), earlier.cast("date")).cast("bigint")


def numeric_input(value: Column) -> Column:
    """Model input: unparsable or missing becomes 0."""
    return F.coalesce(safe_double(value), F.lit(0.0))


def category_input(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING_CATEGORY))


def finite_or_null(value: Column) -> Column:
    x = value.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def integer_key(value: Column) -> Column:
    """Key as a long, NULL when it cannot be read as one."""
    return value.cast("string").try_cast("bigint")


def binary_target(value: Column) -> Column:
    return value.cast("int")


def amount_target(value: Column) -> Column:
    return F.coalesce(safe_double(value), F.lit(0.0))


def clip_unit(value: Column) -> Column:
    return F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(1.0))
