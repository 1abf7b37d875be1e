"""From frames to model inputs, and source profiling."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import (
    DELTA,
    ORDER_CUTOFFS,
    VALIDATION,
    cuts,
    dsum,
    stamp,
    table,
)
from relpoint.operators.labels import Measure, entity_cutoffs, label_table, window_measures
from relpoint.operators.model_inputs import (
    InputLayout,
    align_labels,
    alignment_faults,
    category_codes,
    coerce_keys,
    encode,
    select_features,
    target_table,
    trainable_rows,
    with_class_weights,
)
from relpoint.operators.profile import (
    ManifestSource,
    column_statistics,
    manifest,
    manifest_summary,
    profile_sample,
    visible_before,
    ranked_values,
)
from relpoint.plans.compiler import frame
from relpoint.session import reliable, shared_folder
from relpoint.sources.frames import concat_frames, frame_statistics, read_frame, write_frame
from relpoint.sources.tables import duplicate_keys
from relpoint.spec import CompressionGraph, Edge, Relation

# The last cutoff lies behind all orders: every target is equal and it is dropped.
LABEL_CUTOFFS = (*ORDER_CUTOFFS, datetime(2002, 1, 1))


def order_graph(spark: SparkSession, folder: str, cutoffs) -> CompressionGraph:
    customer = Relation(
        "customer", table(spark, folder, "customer"), "c_custkey", "cus", columns=("c_mktsegment",)
    )
    orders = Relation(
        "orders", table(spark, folder, "orders"), "o_orderkey", "ord", "o_orderdate",
        columns=("o_totalprice",), stats=("count", "sum", "recency"),
    )
    edge = Edge("customer", "orders", "c_custkey", "o_custkey")
    return CompressionGraph("customer", (customer, orders), (edge,), tuple(cutoffs))


def churn_labels(spark: SparkSession, folder: str, cutoffs) -> DataFrame:
    """(cutoff, customer as text, target) as an external task table would hold it."""
    keys = entity_cutoffs(table(spark, folder, "customer"), "c_custkey", cutoffs)
    counted = window_measures(
        table(spark, folder, "orders"), "o_custkey", "o_orderdate", cutoffs, DELTA, [Measure("n", "count")]
    )
    labels = label_table(keys, "c_custkey", counted, "o_custkey", ["n"])
    target = (F.col("n") == 0).cast("int").alias("target")
    return target_table(
        labels.select("cutoff", F.col("c_custkey").cast("string").alias("customer"), target),
        "cutoff", "customer", "target",
    )


def training_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Labels with their features, class weights, usable cutoffs only.

    The labels are the frame's base, so the features are joined once.
    """
    # A label table is stored once; cutoff filter, weights and frame all read it.
    labels = reliable(coerce_keys(churn_labels(spark, folder, LABEL_CUTOFFS), "customer"))
    labels = with_class_weights(trainable_rows(labels, "target"), "target")
    rows = frame(order_graph(spark, folder, LABEL_CUTOFFS), keys=labels, how="left")
    return rows.withColumnRenamed("cus_c_custkey", "customer")


def aligned_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels joined to a finished frame, keys compared as text."""
    labels = churn_labels(spark, folder, ORDER_CUTOFFS)
    features = frame(order_graph(spark, folder, ORDER_CUTOFFS[:2]))
    aligned = align_labels(features, labels, "cus_c_custkey", "customer", as_text=True)
    return aligned.select("cutoff", "customer", "target", "ord_n_rows", "ord_o_totalprice_sum")


_ALIGNED_FEATURES = f"cutoff <> {stamp(ORDER_CUTOFFS[2])}"

_CHURN = f"""
SELECT cutoff, c_custkey, CAST(count(o_orderkey) = 0 AS INTEGER) AS target
FROM cuts CROSS JOIN customer LEFT JOIN orders ON o_custkey = c_custkey
  AND o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL {DELTA.days} DAY
GROUP BY cutoff, c_custkey"""

_FEATURES = f"""
SELECT cutoff, o_custkey AS k, count(*) AS n, {dsum("o_totalprice")} AS s,
  date_diff('day', max(o_orderdate), cutoff) AS dl, date_diff('day', min(o_orderdate), cutoff) AS df,
  date_diff('day', min(o_orderdate), max(o_orderdate)) AS sp
FROM cuts JOIN orders ON o_orderdate < cutoff GROUP BY cutoff, o_custkey"""

_TRAINING_SQL = f"""
WITH {cuts(LABEL_CUTOFFS)}, l AS ({_CHURN}),
kept AS (SELECT * FROM l WHERE cutoff IN (
  SELECT cutoff FROM l GROUP BY cutoff HAVING count(DISTINCT target) > 1)),
w AS (SELECT target, CAST(max(count(*)) OVER () AS DOUBLE) / count(*) AS weight FROM kept GROUP BY target),
f AS ({_FEATURES})
SELECT kept.cutoff, kept.c_custkey AS customer, kept.target, weight, c_mktsegment AS cus_c_mktsegment,
  COALESCE(n, 0) AS ord_n_rows, s AS ord_o_totalprice_sum, dl AS ord_days_since_last,
  df AS ord_days_since_first, sp AS ord_span_days
FROM kept JOIN customer ON customer.c_custkey = kept.c_custkey LEFT JOIN w ON w.target = kept.target
LEFT JOIN f ON f.cutoff = kept.cutoff AND f.k = kept.c_custkey
"""


_ALIGNED_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}, l AS ({_CHURN}), f AS ({_FEATURES})
SELECT l.cutoff, CAST(c_custkey AS VARCHAR) AS customer, target,
  CASE WHEN l.{_ALIGNED_FEATURES} THEN COALESCE(n, 0) END AS ord_n_rows,
  CASE WHEN l.{_ALIGNED_FEATURES} THEN s END AS ord_o_totalprice_sum
FROM l LEFT JOIN f ON f.cutoff = l.cutoff AND f.k = c_custkey
"""


def label_alignment_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicated keys found on real data: two orders of one customer on one date."""
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").alias("cutoff"), "o_custkey")
    customers = entity_cutoffs(table(spark, folder, "customer"), "c_custkey", ORDER_CUTOFFS)
    return alignment_faults(customers, orders, "c_custkey", "o_custkey")


_FAULTS_SQL = """
SELECT o_orderdate AS cutoff, CAST(o_custkey AS VARCHAR) AS entity, count(*) AS n, 'labels' AS side
FROM orders GROUP BY o_orderdate, o_custkey HAVING count(*) > 1
"""


def frame_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Frame written by cutoff, then read with partition and column pruning."""
    path = shared_folder(spark, "frame")
    write_frame(frame(order_graph(spark, folder, ORDER_CUTOFFS)), path)
    columns = ["cutoff", "cus_c_custkey", "ord_n_rows", "ord_o_totalprice_sum"]
    return read_frame(spark, path, ORDER_CUTOFFS[1:], columns)


_ROUND_TRIP_SQL = f"""
WITH {cuts(ORDER_CUTOFFS[1:])}, f AS ({_FEATURES})
SELECT c.cutoff, c_custkey AS cus_c_custkey, COALESCE(n, 0) AS ord_n_rows, s AS ord_o_totalprice_sum
FROM (SELECT cutoff, c_custkey FROM cuts, customer) c LEFT JOIN f ON f.cutoff = c.cutoff AND f.k = c_custkey
"""


def training_frame_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Row count, distinct targets and target deviation of a frame."""
    stats = frame_statistics(churn_labels(spark, folder, LABEL_CUTOFFS), "target")
    return stats.withColumn("target_std", F.round("target_std", 9))


_STATS_SQL = f"""
WITH {cuts(LABEL_CUTOFFS)}, l AS ({_CHURN})
SELECT count(*) AS n_rows, count(DISTINCT target) AS target_nunique, round(stddev_pop(target), 9) AS target_std FROM l
"""


def frames_concatenated(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of two cutoffs with different columns; what one lacks becomes NULL."""
    first = frame(order_graph(spark, folder, ORDER_CUTOFFS[:1]))
    graph = order_graph(spark, folder, ORDER_CUTOFFS[1:2])
    orders = replace(graph.relation("orders"), stats=("count", "max"))
    second = frame(replace(graph, relations=(graph.relation("customer"), orders)))
    return concat_frames([first, second])


_CONCAT_SQL = f"""
WITH {cuts(ORDER_CUTOFFS[:2])}, f AS ({_FEATURES}),
m AS (SELECT o_custkey AS k, CAST(max(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS m
  FROM orders WHERE o_orderdate < {stamp(ORDER_CUTOFFS[1])} GROUP BY o_custkey),
b AS (SELECT c.*, f.* EXCLUDE (cutoff) FROM (SELECT cutoff, customer.* FROM cuts, customer) c
  LEFT JOIN f ON f.cutoff = c.cutoff AND f.k = c_custkey)
SELECT cutoff, c_custkey AS cus_c_custkey, c_mktsegment AS cus_c_mktsegment, COALESCE(n, 0) AS ord_n_rows,
  CASE WHEN cutoff = {stamp(ORDER_CUTOFFS[0])} THEN s END AS ord_o_totalprice_sum,
  CASE WHEN cutoff = {stamp(ORDER_CUTOFFS[0])} THEN dl END AS ord_days_since_last,
  CASE WHEN cutoff = {stamp(ORDER_CUTOFFS[0])} THEN df END AS ord_days_since_first,
  CASE WHEN cutoff = {stamp(ORDER_CUTOFFS[0])} THEN sp END AS ord_span_days,
  CASE WHEN cutoff = {stamp(ORDER_CUTOFFS[1])} THEN m END AS ord_o_totalprice_max
FROM b LEFT JOIN m ON m.k = c_custkey
"""


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Part attributes with missing, unparsable and infinite values."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey",
        "case when p_size > 5 then p_brand end as brand",
        "p_type as kind",
        "case when p_size > 40 then 'n/a' else cast(p_size as string) end as size",
        "case when p_size = 1 then double('infinity') else cast(p_retailprice as double) end as price",
    )


def frozen_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Column kinds frozen on one split and replayed on another with other types."""
    parts = _mixed(spark, folder)
    train = parts.withColumn("size", F.col("size").try_cast("double"))
    columns = select_features([train.schema, parts.schema], "price", ["p_partkey"], numeric_only=False)
    return InputLayout.fit(train.schema, columns).apply(parts, keep=["p_partkey"])


_FROZEN_SQL = """
SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand ELSE '__missing__' END AS brand, p_type AS kind,
  CASE WHEN p_size > 40 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS size
FROM part
"""


def encoded_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Codes learned on a split without some categories; unseen ones and infinities become NULL."""
    parts = _mixed(spark, folder)
    train = parts.where("kind <> 'SMALL' and brand <> 'Brand#7'")
    codes = category_codes(train, ["brand", "kind"])
    return encode(parts.drop("size"), codes, ["brand", "kind"], ["price"])


_ENCODED_SQL = """
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_brand END AS brand, p_type AS kind,
  CASE WHEN p_size = 1 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) END AS price FROM part),
t AS (SELECT * FROM p WHERE kind <> 'SMALL' AND brand <> 'Brand#7'),
b AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS code FROM (SELECT DISTINCT brand FROM t)),
k AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS code FROM (SELECT DISTINCT kind FROM t))
SELECT p_partkey, b.code AS brand, k.code AS kind, price
FROM p LEFT JOIN b ON b.brand = p.brand LEFT JOIN k ON k.kind = p.kind
"""

_ORDER_SOURCE = ManifestSource("o_orderkey", "o_orderdate", ("o_custkey",), ("o_orderpriority",))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("constant", F.lit("x")).withColumn(
        "note", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    )


def profile_orders_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Reproducible 10,000-row sample strictly before validation."""
    sample = profile_sample(_orders(spark, folder), "o_orderkey", "o_orderdate", VALIDATION, 10_000)
    return sample.select("o_orderkey", "o_orderdate", "o_orderstatus")


_SAMPLE_SQL = f"""
SELECT * FROM orders WHERE o_orderdate < {stamp(VALIDATION)}
ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10000
"""


def profile_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Roles from all rows before validation."""
    return manifest(visible_before(_orders(spark, folder), "o_orderdate", VALIDATION), _ORDER_SOURCE)


def _manifest_sql() -> str:
    roles = {
        "o_orderkey": "key", "o_custkey": "key", "o_orderstatus": "categorical", "o_totalprice": "numeric",
        "o_orderdate": "time", "o_orderpriority": "dropped", "constant": "dropped", "note": "dropped",
    }
    values = {"constant": "'x'", "note": "'order ' || o_orderkey"}
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({values.get(c, c)}) AS n_null, "
        f"count(DISTINCT {values.get(c, c)}) AS n_distinct, '{r}' AS role FROM s"
        for c, r in roles.items()
    ]
    return f"WITH s AS (SELECT * FROM orders WHERE o_orderdate < {stamp(VALIDATION)}) " + " UNION ALL ".join(parts)


def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_summary(profile_manifest(spark, folder))


def part_column_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Exact statistics of every column over the whole table."""
    return column_statistics(spark.read.parquet(f"{folder}/part.parquet"))


_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_PART_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, "
    f"count(DISTINCT {c}) AS n_distinct FROM part"
    for c in _PART_COLUMNS
)


def top_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Top 5 values per column; columns with more than 30 values are left out."""
    part = table(spark, folder, "part")
    return ranked_values(part, ["p_brand", "p_type", "p_name", "p_size"], 5, 30)


_TOP_SQL = """
WITH s AS (UNPIVOT (SELECT p_brand, p_type, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part)
  ON p_brand, p_type, p_name, p_size INTO NAME "column" VALUE value),
c AS (SELECT "column", value, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY "column") AS d FROM c)
SELECT "column", value, n, rank FROM r WHERE rank <= 5 AND d <= 30
"""


def duplicate_line_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Primary key check: line numbers are not unique within an order."""
    return duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


_DUPLICATES_SQL = """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
"""

QUERIES = {
    "training_frame": training_frame,
    "aligned_labels": aligned_labels,
    "label_alignment_faults": label_alignment_faults,
    "frame_round_trip": frame_round_trip,
    "training_frame_statistics": training_frame_statistics,
    "frames_concatenated": frames_concatenated,
    "frozen_inputs": frozen_inputs,
    "encoded_inputs": encoded_inputs,
    "profile_orders_sample": profile_orders_sample,
    "profile_manifest": profile_manifest,
    "profile_summary": profile_summary,
    "part_column_statistics": part_column_statistics,
    "top_categories": top_categories,
    "duplicate_line_keys": duplicate_line_keys,
}

SQL = {
    "training_frame": _TRAINING_SQL,
    "aligned_labels": _ALIGNED_SQL,
    "label_alignment_faults": _FAULTS_SQL,
    "frame_round_trip": _ROUND_TRIP_SQL,
    "training_frame_statistics": _STATS_SQL,
    "frames_concatenated": _CONCAT_SQL,
    "frozen_inputs": _FROZEN_SQL,
    "encoded_inputs": _ENCODED_SQL,
    "profile_orders_sample": f"SELECT o_orderkey, o_orderdate, o_orderstatus FROM ({_SAMPLE_SQL})",
    "profile_manifest": _manifest_sql(),
    "profile_summary": (
        f"SELECT count(*) AS source, count(*) FILTER (WHERE role <> 'dropped') AS graph, "
        f"count(*) FILTER (WHERE role NOT IN ('dropped', 'key', 'time')) AS features FROM ({_manifest_sql()})"
    ),
    "part_column_statistics": _PART_STATS_SQL,
    "top_categories": _TOP_SQL,
    "duplicate_line_keys": _DUPLICATES_SQL,
}
