"""From a feature frame to model inputs: alignment, selection, frozen encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.functions.ordered import with_row_id
from relpoint.functions.scalars import category_input, finite_or_null, integer_key, numeric_input
from relpoint.session import reliable


def align_labels(
    features: DataFrame, labels: DataFrame, feature_entity: str, label_entity: str, as_text: bool = False
) -> DataFrame:
    """Every label row with its features (NULL where there are none).

    ``as_text`` compares keys of different types through their string form.
    """
    f = features.withColumnsRenamed({"cutoff": "__cutoff"})
    left, right = labels[label_entity], f[feature_entity]
    if as_text:
        left, right = left.cast("string"), right.cast("string")
    joined = labels.join(f, (labels["cutoff"] == f["__cutoff"]) & (left == right), "left")
    return joined.drop("__cutoff") if feature_entity == label_entity else joined.drop("__cutoff", feature_entity)


def alignment_faults(features: DataFrame, labels: DataFrame, feature_entity: str, label_entity: str) -> DataFrame:
    """Keys that occur more than once on either side of the one-to-one alignment."""

    def repeated(df: DataFrame, entity: str, side: str) -> DataFrame:
        counts = df.groupBy("cutoff", F.col(entity).cast("string").alias("entity")).agg(
            F.count(F.lit(1)).alias("n")
        )
        return counts.where(F.col("n") > 1).withColumn("side", F.lit(side))

    return repeated(features, feature_entity, "features").unionByName(
        repeated(labels, label_entity, "labels")
    )


def coerce_keys(df: DataFrame, column: str) -> DataFrame:
    """Key as a long; rows whose key cannot be read are dropped."""
    return df.withColumn(column, integer_key(F.col(column))).where(F.col(column).isNotNull())


def target_table(frame: DataFrame, time_col: str, entity: str, target: str) -> DataFrame:
    return frame.select(time_col, entity, target)


def select_features(
    schemas: Sequence[T.StructType], target: str, excluded: Sequence[str] = (), numeric_only: bool = True
) -> list[str]:
    """Feature columns shared by all splits, in the first split's order.

    Targets, excluded columns, anything named like a label, ids and timestamps
    never become features.
    """
    common = set(schemas[0].names).intersection(*(s.names for s in schemas[1:]))
    kinds = (T.NumericType, T.BooleanType) if numeric_only else (T.NumericType, T.BooleanType, T.StringType)
    return [
        f.name
        for f in schemas[0]
        if f.name in common
        and f.name != target
        and f.name not in excluded
        and "label" not in f.name.lower()
        and not f.name.lower().endswith("_id")
        and isinstance(f.dataType, kinds)
    ]


@dataclass(frozen=True)
class InputLayout:
    """Column order and kinds, fixed on the training split and replayed elsewhere."""

    columns: tuple[str, ...]
    categorical: tuple[str, ...]

    @classmethod
    def fit(cls, schema: T.StructType, columns: Sequence[str]) -> InputLayout:
        text = tuple(c for c in columns if isinstance(schema[c].dataType, T.StringType))
        return cls(tuple(columns), text)

    @property
    def categorical_indices(self) -> list[int]:
        return [self.columns.index(c) for c in self.categorical]

    def apply(self, frame: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Numeric columns to double with 0 for missing, categories to text."""
        out = []
        for c in self.columns:
            value = F.col(c) if c in frame.columns else F.lit(None).cast("string")
            if c in frame.columns and isinstance(frame.schema[c].dataType, T.BooleanType):
                value = value.cast("int") if c not in self.categorical else value
            out.append((category_input(value) if c in self.categorical else numeric_input(value)).alias(c))
        return frame.select(*keep, *out)


def category_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): 0-based codes in value order, learned on train only.

    The codes are stored: every column that is encoded looks them up, and none numbers them again.
    """
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)
    )
    distinct = train.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    numbered = with_row_id(distinct, ["column", "value"], "__id")
    first = numbered.groupBy("column").agg(F.min("__id").alias("__first"))
    return reliable(
        numbered.join(F.broadcast(first), "column").select(
            "column", "value", (F.col("__id") - F.col("__first")).alias("code")
        )
    )


def encode(frame: DataFrame, codes: DataFrame, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """Replace categories by codes; unseen values and infinities become NULL."""
    for c in columns:
        mine = codes.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
        joined = frame.join(mine, frame[c].cast("string") == mine["__v"], "left")
        frame = joined.withColumn(c, F.col("__c")).drop("__v", "__c")
    return frame.withColumns({c: finite_or_null(F.col(c)) for c in numeric}) if numeric else frame


def with_class_weights(frame: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Largest class count over the row's class count. One row per class is joined."""
    counts = frame.groupBy(F.col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    top = counts.agg(F.max("__n")).scalar()
    weights = counts.select("__class", (top.cast("double") / F.col("__n")).alias(name))
    return frame.join(weights, frame[target] == weights["__class"], "left").drop("__class")


def usable_cutoffs(frame: DataFrame, target: str) -> DataFrame:
    """Cutoffs whose target takes at least two values."""
    spread = frame.groupBy("cutoff").agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
    return spread.where(F.col("lo") < F.col("hi")).select("cutoff")


def trainable_rows(frame: DataFrame, target: str) -> DataFrame:
    return frame.join(usable_cutoffs(frame, target), "cutoff", "left_semi")
