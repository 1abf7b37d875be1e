"""Histories: latest records, bridges and the supplier star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import ORDER_CUTOFFS, cuts, dec, dsum, stamp, table
from relpoint.functions.scalars import day_difference, differs_or_null, indicator, ratio
from relpoint.functions.timegrid import CutoffGrid, timestamp_literal
from relpoint.operators.history import (
    collapse_bridge,
    latest_record_at,
    latest_value,
    modes,
    star,
)
from relpoint.operators.labels import before
from relpoint.session import reliable

CUTOFF = ORDER_CUTOFFS[1]


def latest_order_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    """Last visible order per customer and cutoff; ties on the date go to the larger key."""
    orders = table(spark, folder, "orders")
    grid = CutoffGrid(ORDER_CUTOFFS)
    latest = latest_record_at(
        orders, "o_custkey", "o_orderdate", "o_orderkey", ["o_orderstatus", "o_totalprice"], grid
    )
    return latest.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


_LATEST_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
r AS (SELECT cutoff, o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice,
  row_number() OVER (PARTITION BY cutoff, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM cuts JOIN orders ON o_orderdate < cutoff)
SELECT * EXCLUDE (rn) FROM r WHERE rn = 1
"""


def latest_known_priority(spark: SparkSession, folder: str) -> DataFrame:
    """Value at the latest time where the value is known (a NULL never wins)."""
    orders = table(spark, folder, "orders").withColumn(
        "known", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    )
    return orders.groupBy("o_custkey").agg(
        latest_value(F.col("known"), F.col("o_orderdate"), F.col("o_orderkey")).alias("latest_known"),
        F.max("o_orderdate").alias("last_order"),
    )


_KNOWN_SQL = """
SELECT a.o_custkey, latest_known, last_order
FROM (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) a
LEFT JOIN (
  SELECT o_custkey, o_orderpriority AS latest_known,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus <> 'P') b ON b.o_custkey = a.o_custkey AND rn = 1
"""


def order_part_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Order -> lineitem -> part collapsed to the order: counts and modes."""
    lines = before(table(spark, folder, "lineitem"), "l_shipdate", CUTOFF)
    part = table(spark, folder, "part")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))
    return collapse_bridge(
        lines.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus"),
        part.select("p_partkey", "p_brand", "p_type"),
        "l_orderkey",
        "l_partkey",
        "p_partkey",
        {"part_count": F.col("l_partkey"), "returned_part_count": returned},
        {"brand": F.col("p_brand"), "part_type": F.col("p_type"), "line_status": F.col("l_linestatus")},
    )


def _mode_sql(source: str, key: str, column: str, name: str) -> str:
    return (
        f"{name} AS (SELECT {key} AS k, {column} AS v, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY count(*) DESC, {column}) AS r FROM {source} WHERE {column} IS NOT NULL GROUP BY {key}, {column})"
    )


_BRIDGE_SQL = f"""
WITH j AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linestatus, p_brand, p_type
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_shipdate < {stamp(CUTOFF)}),
a AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS part_count,
  count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS returned_part_count FROM j GROUP BY l_orderkey),
{_mode_sql("j", "l_orderkey", "p_brand", "b")}, {_mode_sql("j", "l_orderkey", "p_type", "t")},
{_mode_sql("j", "l_orderkey", "l_linestatus", "s")}
SELECT a.*, b.v AS brand, t.v AS part_type, s.v AS line_status FROM a
LEFT JOIN b ON b.k = l_orderkey AND b.r = 1 LEFT JOIN t ON t.k = l_orderkey AND t.r = 1
LEFT JOIN s ON s.k = l_orderkey AND s.r = 1
"""


def supplier_history_star(spark: SparkSession, folder: str) -> DataFrame:
    """Line history with order-grain summaries, reduced to the supplier.

    Order-grain summaries (latest line, part bridge, two-stage success rate, volume)
    are built first; the star joins them once to the lines, and one bounded
    aggregation follows.
    """
    lines = before(table(spark, folder, "lineitem"), "l_shipdate", CUTOFF)
    orders = before(table(spark, folder, "orders"), "o_orderdate", CUTOFF, inclusive=True)
    part = table(spark, folder, "part")

    base = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        "o_orderpriority",
        F.col("o_totalprice").alias("order_value"),
        (F.col("o_orderstatus") == "F").alias("is_final"),
    )
    bridge = collapse_bridge(
        lines.select("l_orderkey", "l_partkey"),
        part.select("p_partkey", "p_brand"),
        "l_orderkey",
        "l_partkey",
        "p_partkey",
        {"part_count": F.col("l_partkey")},
        {"order_brand": F.col("p_brand")},
    )
    # One flag per (order, ship date), then the share of good dates per order, and the volume with it.
    tested = differs_or_null(F.col("l_returnflag"), "N") & F.col("l_discount").between(0, 0.1)
    dated = lines.groupBy("l_orderkey", "l_shipdate").agg(
        F.min(F.when(tested, indicator(F.col("l_tax") < 0.05))).alias("is_good"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"),
    )
    volume = dated.groupBy("l_orderkey").agg(
        F.nullif(F.count("is_good"), F.lit(0)).alias("outcome_count"),
        F.avg("is_good").alias("good_rate"),
        F.sum("lines").alias("line_count"),
        F.sum("quantity").alias("quantity"),
    )
    fact = lines.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    # Two aggregations read the star's rows; they are stored once.
    rows = reliable(star(fact, base, "l_orderkey", [bridge, volume]))

    order = (F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
    weight = F.col("good_rate") * F.col("outcome_count")
    hi = timestamp_literal(CUTOFF)
    summary = rows.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("history_rows"),
        F.countDistinct("l_orderkey").alias("order_count"),
        F.sum("order_value").cast("double").alias("order_value"),
        F.max("order_value").cast("double").alias("order_value_max"),
        latest_value(F.col("o_orderpriority"), *order).alias("latest_priority"),
        latest_value(F.col("order_brand"), *order).alias("latest_brand"),
        F.avg(indicator(F.col("is_final"))).alias("final_share"),
        F.sum("part_count").alias("part_count"),
        F.sum("outcome_count").alias("outcome_count"),
        ratio(F.sum(weight), F.sum("outcome_count")).alias("good_rate"),
        F.sum("line_count").alias("line_count"),
        F.sum("quantity").cast("double").alias("quantity"),
        day_difference(hi, F.max("l_shipdate")).alias("days_since_latest"),
    )
    brands = modes(rows, "l_suppkey", {"common_brand": F.col("order_brand")})
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    full = summary.join(brands, "l_suppkey", "left")
    return supplier.join(full, supplier["s_suppkey"] == full["l_suppkey"], "left").drop("l_suppkey").withColumn(
        "good_rate", F.round("good_rate", 9)
    )


_STAR_SQL = f"""
WITH li AS (SELECT * FROM lineitem WHERE l_shipdate < {stamp(CUTOFF)}),
j AS (SELECT l_orderkey, l_partkey, p_brand FROM li LEFT JOIN part ON p_partkey = l_partkey),
pc AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS part_count FROM j GROUP BY l_orderkey),
{_mode_sql("j", "l_orderkey", "p_brand", "ob")},
dated AS (SELECT l_orderkey, l_shipdate, min(CASE WHEN l_tax < 0.05 THEN 1.0 ELSE 0.0 END) AS good FROM li
  WHERE (l_returnflag IS NULL OR l_returnflag != 'N') AND l_discount BETWEEN 0 AND 0.1
  GROUP BY l_orderkey, l_shipdate),
suc AS (SELECT l_orderkey, count(*) AS outcome_count, avg(good) AS good_rate FROM dated GROUP BY l_orderkey),
vol AS (SELECT l_orderkey, count(*) AS line_count, sum({dec("l_quantity")}) AS quantity FROM li GROUP BY l_orderkey),
h AS (
  SELECT li.*, o_orderpriority, o_totalprice, o_orderstatus, part_count, ob.v AS brand, outcome_count, good_rate,
    line_count, quantity,
    row_number() OVER (PARTITION BY l_suppkey
      ORDER BY l_shipdate DESC, li.l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS latest
  FROM li JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= {stamp(CUTOFF)}
  LEFT JOIN pc USING (l_orderkey) LEFT JOIN ob ON ob.k = li.l_orderkey AND ob.r = 1
  LEFT JOIN suc USING (l_orderkey) LEFT JOIN vol USING (l_orderkey)),
{_mode_sql("h", "l_suppkey", "brand", "cb")}
SELECT s_suppkey, s_name, history_rows, order_count, order_value, order_value_max, latest_priority, latest_brand,
  final_share, part_count, outcome_count, good_rate, line_count, quantity, days_since_latest, cb.v AS common_brand
FROM supplier LEFT JOIN (
  SELECT l_suppkey, count(*) AS history_rows, count(DISTINCT l_orderkey) AS order_count,
    {dsum("o_totalprice")} AS order_value, CAST(max({dec("o_totalprice")}) AS DOUBLE) AS order_value_max,
    max(CASE WHEN latest = 1 THEN o_orderpriority END) AS latest_priority,
    max(CASE WHEN latest = 1 THEN brand END) AS latest_brand,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) AS final_share,
    CAST(sum(part_count) AS BIGINT) AS part_count, CAST(sum(outcome_count) AS BIGINT) AS outcome_count,
    round(sum(good_rate * outcome_count) / NULLIF(sum(outcome_count), 0), 9) AS good_rate,
    CAST(sum(line_count) AS BIGINT) AS line_count, CAST(sum(quantity) AS DOUBLE) AS quantity,
    date_diff('day', max(l_shipdate), {stamp(CUTOFF)}) AS days_since_latest
  FROM h GROUP BY l_suppkey) ON l_suppkey = s_suppkey
LEFT JOIN cb ON cb.k = s_suppkey AND cb.r = 1
"""

QUERIES = {
    "latest_order_per_customer": latest_order_per_customer,
    "latest_known_priority": latest_known_priority,
    "order_part_bridge": order_part_bridge,
    "supplier_history_star": supplier_history_star,
}

SQL = {
    "latest_order_per_customer": _LATEST_SQL,
    "latest_known_priority": _KNOWN_SQL,
    "order_part_bridge": _BRIDGE_SQL,
    "supplier_history_star": _STAR_SQL,
}
