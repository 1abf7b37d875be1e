"""Entity frames: reduce edges, hops, lookups, roles."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import (
    DELTA,
    ORDER_CUTOFFS,
    TEST,
    VALIDATION,
    cuts,
    davg,
    dec,
    dsum,
    numeric_sql,
    recency_sql,
    rounded,
    stamp,
    table,
    zero,
)
from relpoint.plans.compiler import frame
from relpoint.plans.cutoffs import split_cutoffs, time_bounds
from relpoint.session import reliable, shared_folder
from relpoint.sources.panes import PaneStore
from relpoint.spec import CompressionGraph, Edge, Relation

FULL = ("count", "sum", "avg", "min", "max", "std", "nunique", "mode", "topk", "recency", "activity")
STATUSES = ("F", "O", "P")
#: Many cutoffs: rows are folded per pane, and hops joined as intervals.
QUARTERS = tuple(datetime(1996, 1, 1) + k * DELTA for k in range(24))


def base_graph(spark: SparkSession, folder: str) -> CompressionGraph:
    customer = Relation(
        "customer", table(spark, folder, "customer"), "c_custkey", "cus", columns=("c_mktsegment",)
    )
    orders = Relation(
        "orders",
        table(spark, folder, "orders"),
        "o_orderkey",
        "ord",
        "o_orderdate",
        columns=("o_totalprice", "o_orderstatus"),
        stats=FULL,
        categories={"o_orderstatus": STATUSES},
        unique_pk=True,
    )
    edge = Edge("customer", "orders", "c_custkey", "o_custkey")
    return CompressionGraph("customer", (customer, orders), (edge,), ORDER_CUTOFFS)


def customer_frame_base(spark: SparkSession, folder: str) -> DataFrame:
    """customer <- orders at three cutoffs, whole base family."""
    return rounded(frame(base_graph(spark, folder)), ["ord_o_totalprice_std"], 4)


def customer_frame_lookback(spark: SparkSession, folder: str) -> DataFrame:
    """Finite lookback and inclusive boundary: rows in (c - 365 days, c]."""
    graph = replace(base_graph(spark, folder), inclusive=True, lookback_days=365)
    return rounded(frame(graph), ["ord_o_totalprice_std"], 4)


def _base_sql(visible: str) -> str:
    return f"""
WITH {cuts(ORDER_CUTOFFS)},
vis AS (SELECT cutoff, o.* FROM cuts JOIN orders o ON {visible}),
agg AS (
  SELECT cutoff, o_custkey AS k, count(*) AS ord_n_rows, {numeric_sql("o_totalprice", "ord")},
    count(*) FILTER (WHERE o_orderstatus = 'F') AS ord_o_orderstatus_f_count,
    count(*) FILTER (WHERE o_orderstatus = 'O') AS ord_o_orderstatus_o_count,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS ord_o_orderstatus_p_count,
    count(DISTINCT o_orderstatus) AS ord_o_orderstatus_nunique,
    count(DISTINCT CAST(o_orderdate AS DATE)) AS ord_active_days,
    {recency_sql("o_orderdate", "ord")}
  FROM vis GROUP BY cutoff, o_custkey),
ranked AS (
  SELECT cutoff, o_custkey AS k, o_orderstatus AS m,
    row_number() OVER (PARTITION BY cutoff, o_custkey ORDER BY count(*) DESC, o_orderstatus) AS r
  FROM vis GROUP BY cutoff, o_custkey, o_orderstatus)
SELECT c.cutoff, c_custkey AS cus_c_custkey, c_mktsegment AS cus_c_mktsegment,
  {zero("ord_n_rows", "ord_o_orderstatus_f_count", "ord_o_orderstatus_o_count",
        "ord_o_orderstatus_p_count", "ord_o_orderstatus_nunique", "ord_active_days")},
  COALESCE(ord_n_rows, 0) AS ord_pk_nunique,
  ord_o_totalprice_sum, ord_o_totalprice_avg, ord_o_totalprice_min, ord_o_totalprice_max,
  ord_o_totalprice_std, ranked.m AS ord_o_orderstatus_mode,
  ord_days_since_last, ord_days_since_first, ord_span_days,
  CAST(ord_n_rows AS DOUBLE) / ord_active_days AS ord_rows_per_active_day
FROM (SELECT cutoff, customer.* FROM cuts, customer) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = c_custkey
LEFT JOIN ranked ON ranked.cutoff = c.cutoff AND ranked.k = c_custkey AND ranked.r = 1
"""


def training_cutoffs(spark: SparkSession, folder: str) -> list:
    """Whole training schedule of the order history (one row of bounds is read)."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    low, high = time_bounds([(orders, "o_orderdate")]).first()
    return split_cutoffs("train", VALIDATION, TEST, DELTA, low, high)


def customer_frame_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Every training cutoff in one job; facts are folded per pane once."""
    graph = base_graph(spark, folder)
    orders = replace(graph.relation("orders"), stats=("count", "sum", "max", "recency"), categories={},
                     columns=("o_totalprice",))
    graph = replace(
        graph,
        relations=(graph.relation("customer"), orders),
        cutoffs=tuple(training_cutoffs(spark, folder)),
        strategy="bucket",
    )
    return frame(graph)


_SCHEDULE_SQL = f"""
WITH RECURSIVE cuts(cutoff) AS (
  SELECT {stamp(VALIDATION - DELTA)} UNION ALL
  SELECT cutoff - INTERVAL 90 DAY FROM cuts
  WHERE cutoff - INTERVAL 90 DAY >= (SELECT min(o_orderdate) FROM orders)),
agg AS (
  SELECT cutoff, o_custkey AS k, count(*) AS n, {numeric_sql("o_totalprice", "ord", ("sum", "max"))},
    {recency_sql("o_orderdate", "ord")}
  FROM cuts JOIN orders ON o_orderdate < cutoff GROUP BY cutoff, o_custkey)
SELECT c.cutoff, c_custkey AS cus_c_custkey, c_mktsegment AS cus_c_mktsegment,
  COALESCE(n, 0) AS ord_n_rows,
  ord_o_totalprice_sum, ord_o_totalprice_max, ord_days_since_last, ord_days_since_first, ord_span_days
FROM (SELECT cutoff, customer.* FROM cuts, customer) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = c_custkey
"""


def multihop_graph(spark: SparkSession, folder: str, cutoffs: Sequence[datetime]) -> CompressionGraph:
    """customer <- orders <- lineitem -> part: filters, lookup, two reductions."""
    customer = Relation("customer", table(spark, folder, "customer"), "c_custkey", "cus", columns=())
    orders = Relation(
        "orders",
        table(spark, folder, "orders"),
        "o_orderkey",
        "ord",
        "o_orderdate",
        columns=("o_totalprice",),
        filters=("ord_o_orderstatus != 'P'", "ord_o_custkey is not null"),
        stats=("count", "sum"),
    )
    lineitem = Relation(
        "lineitem",
        table(spark, folder, "lineitem"),
        "l_orderkey",
        "li",
        "l_shipdate",
        columns=("l_quantity",),
        stats=("count", "sum", "max"),
    )
    part = Relation("part", table(spark, folder, "part"), "p_partkey", "prt", columns=("p_size", "p_brand"))
    edges = (
        Edge("customer", "orders", "c_custkey", "o_custkey"),
        Edge("orders", "lineitem", "o_orderkey", "l_orderkey"),
        Edge("lineitem", "part", "l_partkey", "p_partkey", reduce=False),
    )
    return CompressionGraph(
        "customer", (customer, orders, lineitem, part), edges, tuple(cutoffs), hops_back=3
    )


def customer_frame_multihop(spark: SparkSession, folder: str) -> DataFrame:
    """customer <- orders <- lineitem -> part: filters, lookup, two reductions."""
    return frame(multihop_graph(spark, folder, ORDER_CUTOFFS[1:]))


_HOP_FEATURES = ("li_n_rows", "li_l_quantity_sum", "li_l_quantity_max", "prt_p_size_sum", "prt_p_size_max")


def _hop_items() -> str:
    items = []
    for f in _HOP_FEATURES:
        value = f"COALESCE({f}, 0)" if f == "li_n_rows" else f
        typed = "" if f in ("li_n_rows", "prt_p_size_sum", "prt_p_size_max") else "DOUBLE"

        def cast(x: str, to: str = typed) -> str:
            return f"CAST({x} AS {to or 'BIGINT'})"

        items += [
            f"{cast(f'sum({value})')} AS {f}_sum",
            f"CAST(sum({value}) AS DOUBLE) / NULLIF(count({value}), 0) AS {f}_avg",
            f"{cast(f'min({value})')} AS {f}_min",
            f"{cast(f'max({value})')} AS {f}_max",
        ]
    return ", ".join(items)


_MULTIHOP_SQL = f"""
WITH {cuts(ORDER_CUTOFFS[1:])},
items AS (
  SELECT cutoff, l_orderkey AS k, count(*) AS li_n_rows, sum({dec("l_quantity")}) AS li_l_quantity_sum,
    max({dec("l_quantity")}) AS li_l_quantity_max, sum(p_size) AS prt_p_size_sum, max(p_size) AS prt_p_size_max
  FROM cuts JOIN lineitem ON l_shipdate < cutoff LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY cutoff, l_orderkey),
vis AS (
  SELECT cuts.cutoff, o.* FROM cuts JOIN orders o ON o_orderdate < cutoff AND o_orderstatus != 'P'),
agg AS (
  SELECT vis.cutoff, o_custkey AS k, count(*) AS ord_n_rows, {dsum("o_totalprice")} AS ord_o_totalprice_sum,
    {_hop_items()}
  FROM vis LEFT JOIN items ON items.cutoff = vis.cutoff AND items.k = o_orderkey
  GROUP BY vis.cutoff, o_custkey)
SELECT c.cutoff, c_custkey AS cus_c_custkey,
  {zero("ord_n_rows")}, COALESCE(li_n_rows_sum, 0) AS li_n_rows_sum,
  agg.* EXCLUDE (cutoff, k, ord_n_rows, li_n_rows_sum)
FROM (SELECT cutoff, c_custkey FROM cuts, customer) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = c_custkey
"""


def lineitem_via_part(spark: SparkSession, folder: str) -> DataFrame:
    """supplier <- lineitem -> part with the many-to-one edge declared as a reduction."""
    supplier = Relation("supplier", table(spark, folder, "supplier"), "s_suppkey", "sup", columns=())
    lineitem = Relation(
        "lineitem",
        table(spark, folder, "lineitem"),
        "l_orderkey",
        "li",
        "l_shipdate",
        columns=("l_quantity",),
        stats=("count", "sum", "max"),
    )
    part = Relation(
        "part", table(spark, folder, "part"), "p_partkey", "prt", columns=("p_size",), stats=("count", "sum")
    )
    edges = (
        Edge("supplier", "lineitem", "s_suppkey", "l_suppkey"),
        Edge("lineitem", "part", "l_partkey", "p_partkey"),
    )
    graph = CompressionGraph("supplier", (supplier, lineitem, part), edges, ORDER_CUTOFFS, hops_back=2)
    return frame(graph)


_VIA_PART_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
parts AS (SELECT p_partkey AS k, count(*) AS n, sum(p_size) AS s FROM part GROUP BY p_partkey),
agg AS (
  SELECT cutoff, l_suppkey AS k, count(*) AS li_n_rows, {numeric_sql("l_quantity", "li", ("sum", "max"))},
    CAST(sum(COALESCE(n, 0)) AS BIGINT) AS prt_n_rows_sum, max(COALESCE(n, 0)) AS prt_n_rows_max,
    CAST(sum(s) AS BIGINT) AS prt_p_size_sum_sum, CAST(max(s) AS BIGINT) AS prt_p_size_sum_max
  FROM cuts JOIN lineitem ON l_shipdate < cutoff LEFT JOIN parts ON parts.k = l_partkey
  GROUP BY cutoff, l_suppkey)
SELECT c.cutoff, s_suppkey AS sup_s_suppkey, {zero("li_n_rows")}, agg.* EXCLUDE (cutoff, k, li_n_rows)
FROM (SELECT cutoff, s_suppkey FROM cuts, supplier) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = s_suppkey
"""


def timed_lookup_graph(spark: SparkSession, folder: str, cutoffs: Sequence[datetime]) -> CompressionGraph:
    """supplier <- lineitem -> orders: an order's attributes count only once it is visible."""
    supplier = Relation("supplier", table(spark, folder, "supplier"), "s_suppkey", "sup", columns=())
    lineitem = Relation(
        "lineitem",
        table(spark, folder, "lineitem"),
        "l_orderkey",
        "li",
        "l_shipdate",
        columns=(),
        stats=("count", "sum", "avg", "nunique", "mode"),
    )
    orders = Relation(
        "orders", table(spark, folder, "orders"), "o_orderkey", "ord", "o_orderdate",
        columns=("o_totalprice", "o_orderstatus"),
    )
    edges = (
        Edge("supplier", "lineitem", "s_suppkey", "l_suppkey"),
        Edge("lineitem", "orders", "l_orderkey", "o_orderkey", reduce=False),
    )
    return CompressionGraph("supplier", (supplier, lineitem, orders), edges, tuple(cutoffs), hops_back=2)


def timed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """supplier <- lineitem -> orders: an order's attributes count only once it is visible."""
    return frame(timed_lookup_graph(spark, folder, ORDER_CUTOFFS))


_TIMED_LOOKUP_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
vis AS (
  SELECT cutoff, l_suppkey, l_orderkey, CASE WHEN o_orderdate < cutoff THEN o_totalprice END AS o_totalprice,
    CASE WHEN o_orderdate < cutoff THEN o_orderstatus END AS st
  FROM cuts JOIN lineitem ON l_shipdate < cutoff LEFT JOIN orders ON o_orderkey = l_orderkey),
agg AS (
  SELECT cutoff, l_suppkey AS k, count(*) AS li_n_rows,
    {numeric_sql("o_totalprice", "ord", ("sum", "avg"))}, count(DISTINCT st) AS ord_o_orderstatus_nunique,
    count(DISTINCT l_orderkey) AS li_pk_nunique
  FROM vis GROUP BY cutoff, l_suppkey),
ranked AS (
  SELECT cutoff, l_suppkey AS k, st,
    row_number() OVER (PARTITION BY cutoff, l_suppkey ORDER BY count(*) DESC, st) AS r
  FROM vis WHERE st IS NOT NULL GROUP BY cutoff, l_suppkey, st)
SELECT c.cutoff, s_suppkey AS sup_s_suppkey, {zero("li_n_rows", "ord_o_orderstatus_nunique", "li_pk_nunique")},
  ord_o_totalprice_sum, ord_o_totalprice_avg,
  ranked.st AS ord_o_orderstatus_mode
FROM (SELECT cutoff, s_suppkey FROM cuts, supplier) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = s_suppkey
LEFT JOIN ranked ON ranked.cutoff = c.cutoff AND ranked.k = s_suppkey AND ranked.r = 1
"""


def below_lookup_graph(spark: SparkSession, folder: str, cutoffs: Sequence[datetime]) -> CompressionGraph:
    """supplier <- lineitem -> orders <- lineitem: what lies below an order counts once the order is visible."""
    supplier = Relation("supplier", table(spark, folder, "supplier"), "s_suppkey", "sup", columns=())
    lineitem = Relation(
        "lineitem", table(spark, folder, "lineitem"), "l_orderkey", "li", "l_shipdate", columns=(), stats=("count", "sum")
    )
    orders = Relation(
        "orders", table(spark, folder, "orders"), "o_orderkey", "ord", "o_orderdate", columns=("o_totalprice",),
        stats=("count", "sum"),
    )
    other = replace(
        lineitem.role("other", "oth"), columns=("l_quantity", "l_returnflag"), stats=("count", "sum", "mode")
    )
    edges = (
        Edge("supplier", "lineitem", "s_suppkey", "l_suppkey"),
        Edge("lineitem", "orders", "l_orderkey", "o_orderkey", reduce=False),
        Edge("orders", "other", "o_orderkey", "l_orderkey"),
    )
    return CompressionGraph(
        "supplier", (supplier, lineitem, orders, other), edges, tuple(cutoffs), hops_back=3, hop_stats=("sum", "max")
    )


def hops_below_timed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """supplier <- lineitem -> orders <- lineitem: what lies below an order counts once the order is visible."""
    return frame(below_lookup_graph(spark, folder, ORDER_CUTOFFS))


_BELOW_LOOKUP_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
seen AS (SELECT cutoff, lineitem.* FROM cuts JOIN lineitem ON l_shipdate < cutoff),
per_flag AS (SELECT cutoff, l_orderkey AS k, l_returnflag AS f,
    row_number() OVER (PARTITION BY cutoff, l_orderkey ORDER BY count(*) DESC, l_returnflag) AS r
  FROM seen WHERE l_returnflag IS NOT NULL GROUP BY cutoff, l_orderkey, l_returnflag),
items AS (
  SELECT a.*, f FROM (SELECT cutoff, l_orderkey AS k, count(*) AS n, sum({dec("l_quantity")}) AS s
    FROM seen GROUP BY cutoff, l_orderkey) a
  LEFT JOIN per_flag p ON p.cutoff = a.cutoff AND p.k = a.k AND r = 1),
vis AS (
  SELECT v.cutoff, l_suppkey, CASE WHEN o_orderdate < v.cutoff THEN o_totalprice END AS price,
    CASE WHEN o_orderdate < v.cutoff THEN n END AS n, CASE WHEN o_orderdate < v.cutoff THEN s END AS s,
    CASE WHEN o_orderdate < v.cutoff THEN f END AS f
  FROM seen v LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN items ON items.cutoff = v.cutoff AND items.k = l_orderkey),
agg AS (
  SELECT cutoff, l_suppkey AS k, count(*) AS li_n_rows, {dsum("price")} AS ord_o_totalprice_sum,
    CAST(sum(COALESCE(n, 0)) AS BIGINT) AS oth_n_rows_sum, max(COALESCE(n, 0)) AS oth_n_rows_max,
    CAST(sum(s) AS DOUBLE) AS oth_l_quantity_sum_sum, CAST(max(s) AS DOUBLE) AS oth_l_quantity_sum_max
  FROM vis GROUP BY cutoff, l_suppkey),
ranked AS (SELECT cutoff, l_suppkey AS k, f,
    row_number() OVER (PARTITION BY cutoff, l_suppkey ORDER BY count(*) DESC, f) AS r
  FROM vis WHERE f IS NOT NULL GROUP BY cutoff, l_suppkey, f)
SELECT c.cutoff, s_suppkey AS sup_s_suppkey, {zero("li_n_rows")}, ord_o_totalprice_sum,
  COALESCE(oth_n_rows_sum, 0) AS oth_n_rows_sum, oth_n_rows_max, oth_l_quantity_sum_sum, oth_l_quantity_sum_max,
  ranked.f AS oth_l_returnflag_mode_mode
FROM (SELECT cutoff, s_suppkey FROM cuts, supplier) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = s_suppkey
LEFT JOIN ranked ON ranked.cutoff = c.cutoff AND ranked.k = s_suppkey AND ranked.r = 1
"""


def timed_lookup_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """The timed lookup at 24 cutoffs: folded by the panes of both rows before anything is copied."""
    return frame(timed_lookup_graph(spark, folder, QUARTERS))


def multihop_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Two hops at 24 cutoffs: what lies below an order is joined as intervals between its changes."""
    return frame(multihop_graph(spark, folder, QUARTERS))


def below_lookup_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Hops below a timed lookup at 24 cutoffs."""
    return frame(below_lookup_graph(spark, folder, QUARTERS))


def role_playing_nations(spark: SparkSession, folder: str) -> DataFrame:
    """nation twice: customers of it, suppliers of it, and the nation of each customer."""
    nation = table(spark, folder, "nation")
    entity = Relation("nation", nation, "n_nationkey", "nat", columns=("n_name",))
    customer = Relation(
        "customer", table(spark, folder, "customer"), "c_custkey", "cus", columns=("c_acctbal",),
        stats=("count", "sum", "avg", "nunique"), unique_pk=True,
    )
    supplier = Relation(
        "supplier", table(spark, folder, "supplier"), "s_suppkey", "sup", columns=("s_acctbal",),
        stats=("count", "sum", "max"),
    )
    again = Relation("customer_nation", nation, "n_nationkey", "cna", columns=("n_name",))
    edges = (
        Edge("nation", "customer", "n_nationkey", "c_nationkey"),
        Edge("nation", "supplier", "n_nationkey", "s_nationkey"),
        Edge("customer", "customer_nation", "c_nationkey", "n_nationkey", reduce=False),
    )
    graph = CompressionGraph(
        "nation", (entity, customer, supplier, again), edges, ORDER_CUTOFFS[-1:], hops_back=2
    )
    return frame(graph)


_ROLES_SQL = f"""
WITH c AS (
  SELECT c_nationkey AS k, count(*) AS cus_n_rows, {numeric_sql("c_acctbal", "cus", ("sum", "avg"))},
    count(DISTINCT n_name) AS cna_n_name_nunique
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey),
s AS (
  SELECT s_nationkey AS k, count(*) AS sup_n_rows, {numeric_sql("s_acctbal", "sup", ("sum", "max"))}
  FROM supplier GROUP BY s_nationkey)
SELECT {stamp(ORDER_CUTOFFS[-1])} AS cutoff, n_nationkey AS nat_n_nationkey, n_name AS nat_n_name,
  {zero("cus_n_rows", "cna_n_name_nunique", "sup_n_rows")}, COALESCE(cus_n_rows, 0) AS cus_pk_nunique,
  cus_c_acctbal_sum, cus_c_acctbal_avg, sup_s_acctbal_sum, sup_s_acctbal_max
FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey
"""


def pane_store_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Orders folded into a store in three rounds, each with rows of all times; cutoffs then read partial results."""
    orders = table(spark, folder, "orders")
    name = f"panes_{uuid.uuid4().hex}"
    store = PaneStore(spark, name, "o_custkey", "o_orderdate", ("o_totalprice",), path=shared_folder(spark, name))
    turn = F.col("o_orderkey") % 10
    for rows in (orders.where(turn < 6), orders.where((turn >= 6) & (turn < 9)), orders.where(turn == 9)):
        store.add(rows)
    found = store.features(ORDER_CUTOFFS, (90, 360), 1080)
    money = {c: F.col(c).cast("double") for c in found.columns if c.startswith("o_totalprice_")}
    found = reliable(rounded(found.withColumns(money), ["o_totalprice_std"], 4))
    spark.sql(f"DROP TABLE {name}")
    return found


_STORE_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}
SELECT cutoff, o_custkey, count(*) AS n_rows, {dsum("o_totalprice")} AS o_totalprice_sum,
  {davg("o_totalprice")} AS o_totalprice_avg, CAST(min({dec("o_totalprice")}) AS DOUBLE) AS o_totalprice_min,
  CAST(max({dec("o_totalprice")}) AS DOUBLE) AS o_totalprice_max, round(stddev_pop(o_totalprice), 4) AS o_totalprice_std,
  count(*) FILTER (WHERE o_orderdate >= cutoff - INTERVAL 90 DAY) AS n_rows_90d,
  {dsum("o_totalprice", "o_orderdate >= cutoff - INTERVAL 90 DAY")} AS o_totalprice_sum_90d,
  count(*) FILTER (WHERE o_orderdate >= cutoff - INTERVAL 360 DAY) AS n_rows_360d,
  {dsum("o_totalprice", "o_orderdate >= cutoff - INTERVAL 360 DAY")} AS o_totalprice_sum_360d,
  min(o_orderdate) AS first_time, max(o_orderdate) AS last_time
FROM cuts JOIN orders ON o_orderdate < cutoff AND o_orderdate >= cutoff - INTERVAL 1080 DAY
GROUP BY cutoff, o_custkey
"""


def custom_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """Caller-given aggregate expressions by key (``agg key`` + ``aggfunc`` strings)."""
    items = table(spark, folder, "lineitem").select(
        *(F.col(c).alias(f"li_{c}") for c in ("l_suppkey", "l_partkey", "l_returnflag", "l_quantity"))
    )
    return items.groupBy("li_l_suppkey").agg(
        F.expr("count(li_l_partkey)").alias("li_lines"),
        F.expr("sum(case when li_l_returnflag = 'R' then 1 else 0 end)").alias("li_returned"),
        F.expr("cast(max(li_l_quantity) as double)").alias("li_quantity_max"),
    )


_CUSTOM_SQL = f"""
SELECT l_suppkey AS li_l_suppkey, count(l_partkey) AS li_lines,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS li_returned,
  CAST(max({dec("l_quantity")}) AS DOUBLE) AS li_quantity_max
FROM lineitem GROUP BY l_suppkey
"""

QUERIES = {
    "customer_frame_base": customer_frame_base,
    "customer_frame_lookback": customer_frame_lookback,
    "customer_frame_schedule": customer_frame_schedule,
    "customer_frame_multihop": customer_frame_multihop,
    "lineitem_via_part": lineitem_via_part,
    "timed_lookup": timed_lookup,
    "hops_below_timed_lookup": hops_below_timed_lookup,
    "timed_lookup_schedule": timed_lookup_schedule,
    "multihop_schedule": multihop_schedule,
    "below_lookup_schedule": below_lookup_schedule,
    "role_playing_nations": role_playing_nations,
    "pane_store_rounds": pane_store_rounds,
    "custom_reduction": custom_reduction,
}

SQL = {
    "customer_frame_base": _base_sql("o_orderdate < cutoff"),
    "customer_frame_lookback": _base_sql(
        "o_orderdate <= cutoff AND o_orderdate > cutoff - INTERVAL 365 DAY"
    ),
    "customer_frame_schedule": _SCHEDULE_SQL,
    "customer_frame_multihop": _MULTIHOP_SQL,
    "lineitem_via_part": _VIA_PART_SQL,
    "timed_lookup": _TIMED_LOOKUP_SQL,
    "hops_below_timed_lookup": _BELOW_LOOKUP_SQL,
    "timed_lookup_schedule": _TIMED_LOOKUP_SQL.replace(cuts(ORDER_CUTOFFS), cuts(QUARTERS)),
    "multihop_schedule": _MULTIHOP_SQL.replace(cuts(ORDER_CUTOFFS[1:]), cuts(QUARTERS)),
    "below_lookup_schedule": _BELOW_LOOKUP_SQL.replace(cuts(ORDER_CUTOFFS), cuts(QUARTERS)),
    "role_playing_nations": _ROLES_SQL,
    "pane_store_rounds": _STORE_SQL,
    "custom_reduction": _CUSTOM_SQL,
}
