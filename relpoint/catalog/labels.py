"""Labels, eligibility, existence and as-of flags."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import (
    DELTA,
    EVENT_CUTOFFS,
    ORDER_CUTOFFS,
    WEEK,
    cuts,
    dec,
    dsum,
    table,
)
from relpoint.functions.scalars import amount_target, binary_target, is_truthy, safe_double
from relpoint.operators.labels import (
    SKETCH_BITS,
    Measure,
    active_by,
    asof_flag,
    drop_dangling,
    eligible,
    entity_cutoffs,
    keep_active,
    label_table,
    outside_unit,
    window_measures,
)
from relpoint.sources.tables import with_amount


#: Cutoffs 30 days apart, so that windows of 90 days overlap.
MONTHS = tuple(datetime(1997, 1, 1) + timedelta(days=30 * k) for k in range(40))


def customer_keys(spark: SparkSession, folder: str, cutoffs) -> DataFrame:
    return entity_cutoffs(table(spark, folder, "customer"), "c_custkey", cutoffs)


def label_churn(spark: SparkSession, folder: str) -> DataFrame:
    """No order in (c, c + 90 d] means churn."""
    orders = table(spark, folder, "orders")
    counted = window_measures(orders, "o_custkey", "o_orderdate", ORDER_CUTOFFS, DELTA, [Measure("n", "count")])
    labels = label_table(customer_keys(spark, folder, ORDER_CUTOFFS), "c_custkey", counted, "o_custkey", ["n"])
    return labels.select(
        "cutoff",
        "c_custkey",
        F.col("n").alias("n_future"),
        binary_target(F.col("n") == 0).alias("churn"),
        binary_target(F.col("n") > 0).alias("has_activity"),
    )


_CHURN_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}
SELECT cutoff, c_custkey, count(o_orderkey) AS n_future,
  CAST(count(o_orderkey) = 0 AS INTEGER) AS churn, CAST(count(o_orderkey) > 0 AS INTEGER) AS has_activity
FROM cuts CROSS JOIN customer LEFT JOIN orders ON o_custkey = c_custkey
  AND o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL 90 DAY
GROUP BY cutoff, c_custkey
"""


def label_ltv(spark: SparkSession, folder: str) -> DataFrame:
    """Future order value of customers active in (c - 90 d, c]; 0 without orders."""
    orders = table(spark, folder, "orders")
    total = window_measures(
        orders, "o_custkey", "o_orderdate", ORDER_CUTOFFS, DELTA,
        [Measure("ltv", "sum", F.col("o_totalprice"))],
    )
    keys = eligible(orders, "o_custkey", "o_orderdate", ORDER_CUTOFFS, DELTA)
    keys = keys.withColumnRenamed("o_custkey", "c_custkey")
    labels = label_table(keys, "c_custkey", total, "o_custkey", ["ltv"])
    return labels.withColumn("ltv", amount_target(F.col("ltv")))


_LTV_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}
SELECT cutoff, c_custkey, COALESCE((
  SELECT {dsum("o_totalprice")} FROM orders WHERE o_custkey = c_custkey
    AND o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL 90 DAY), 0) AS ltv
FROM cuts CROSS JOIN customer
WHERE EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_orderdate > cutoff - INTERVAL 90 DAY AND o_orderdate <= cutoff)
"""


def label_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """More than one distinct event type within a week."""
    events = table(spark, folder, "events")
    found = window_measures(
        events, "user_id", "ts", EVENT_CUTOFFS, WEEK, [Measure("n_types", "nunique", F.col("event_type"))]
    )
    labels = label_table(customer_keys(spark, folder, EVENT_CUTOFFS), "c_custkey", found, "user_id", ["n_types"])
    return labels.withColumn("multi_type", binary_target(F.col("n_types") > 1))


_DISTINCT_SQL = f"""
WITH {cuts(EVENT_CUTOFFS)}
SELECT cutoff, c_custkey, count(DISTINCT event_type) AS n_types,
  CAST(count(DISTINCT event_type) > 1 AS INTEGER) AS multi_type
FROM cuts CROSS JOIN customer LEFT JOIN events ON user_id = c_custkey
  AND ts > cutoff AND ts <= cutoff + INTERVAL 7 DAY
GROUP BY cutoff, c_custkey
"""


def label_conditional(spark: SparkSession, folder: str) -> DataFrame:
    """Future clicks: how many, and on how many distinct days."""
    events = table(spark, folder, "events")
    clicked = is_truthy(F.when(F.col("event_type") == "click", "clicked").otherwise("no")) == 1
    measures = [
        Measure("clicks", "count", where=clicked),
        Measure("click_days", "nunique", F.col("ts").cast("date"), clicked),
        Measure("click_value", "sum", F.col("value"), clicked),
    ]
    found = window_measures(events, "user_id", "ts", EVENT_CUTOFFS, WEEK, measures)
    labels = label_table(
        customer_keys(spark, folder, EVENT_CUTOFFS), "c_custkey", found, "user_id",
        ["clicks", "click_days", "click_value"],
    )
    clicked_any = binary_target(F.col("clicks") + F.col("click_days") > 0)
    return labels.withColumns(
        {"click_value": F.col("click_value").cast("double"), "clicked": clicked_any}
    )


_CONDITIONAL_SQL = f"""
WITH {cuts(EVENT_CUTOFFS)}
SELECT cutoff, c_custkey, count(event_id) AS clicks, count(DISTINCT CAST(ts AS DATE)) AS click_days,
  COALESCE({dsum("value")}, 0) AS click_value, CAST(count(event_id) > 0 AS INTEGER) AS clicked
FROM cuts CROSS JOIN customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'click'
  AND ts > cutoff AND ts <= cutoff + INTERVAL 7 DAY
GROUP BY cutoff, c_custkey
"""


def label_active_fraction(spark: SparkSession, folder: str) -> DataFrame:
    """Fractional target: share of purchases among a user's events of the next week."""
    events = table(spark, folder, "events")
    bought = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    found = window_measures(
        events, "user_id", "ts", EVENT_CUTOFFS, WEEK,
        [Measure("n", "count"), Measure("purchase_share", "avg", bought)],
    )
    return found.withColumn("violations", outside_unit(found, "purchase_share").scalar())


_FRACTION_SQL = f"""
WITH {cuts(EVENT_CUTOFFS)}
SELECT cutoff, user_id, count(*) AS n,
  CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / count(*) AS purchase_share,
  0::BIGINT AS violations
FROM cuts JOIN events ON ts > cutoff AND ts <= cutoff + INTERVAL 7 DAY
GROUP BY cutoff, user_id
"""


def label_eligible(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return eligible(orders, "o_custkey", "o_orderdate", ORDER_CUTOFFS, DELTA)


_ELIGIBLE_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}
SELECT DISTINCT cutoff, o_custkey FROM cuts JOIN orders
  ON o_orderdate > cutoff - INTERVAL 90 DAY AND o_orderdate <= cutoff
"""


def label_item_ltv(spark: SparkSession, folder: str) -> DataFrame:
    """Future line value per part, only parts that exist and sell in the window."""
    items = table(spark, folder, "lineitem")
    total = window_measures(
        items, "l_partkey", "l_shipdate", ORDER_CUTOFFS, DELTA,
        [Measure("ltv", "sum", F.col("l_extendedprice")), Measure("lines", "count")],
    )
    sellable = table(spark, folder, "part").where(safe_double(F.col("p_retailprice")).isNotNull())
    return drop_dangling(total, "l_partkey", sellable, "p_partkey").withColumn(
        "ltv", amount_target(F.col("ltv"))
    )


_ITEM_LTV_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}
SELECT cutoff, l_partkey, {dsum("l_extendedprice")} AS ltv, count(*) AS lines
FROM cuts, part, lineitem
WHERE l_partkey = p_partkey AND l_shipdate > cutoff AND l_shipdate <= cutoff + INTERVAL 90 DAY
GROUP BY cutoff, l_partkey
"""


def label_ltv_by_price(spark: SparkSession, folder: str) -> DataFrame:
    """Future worth per supplier: a line has no price of its own here, so it is worth its part's."""
    items, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    priced = with_amount(items, parts, "l_partkey", "p_partkey", "worth", None, "p_retailprice")
    total = window_measures(
        priced, "l_suppkey", "l_shipdate", ORDER_CUTOFFS, DELTA, [Measure("ltv", "sum", F.col("worth").cast("decimal(12,2)"))]
    )
    return total.withColumn("ltv", amount_target(F.col("ltv")))


_PRICE_LTV_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)}
SELECT cutoff, l_suppkey, CAST(sum(COALESCE({dec("p_retailprice")}, 0)) AS DOUBLE) AS ltv
FROM cuts JOIN lineitem ON l_shipdate > cutoff AND l_shipdate <= cutoff + INTERVAL 90 DAY
LEFT JOIN part ON l_partkey = p_partkey
GROUP BY cutoff, l_suppkey
"""


def label_distinct_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct parts a supplier ships in 90 days, at 40 overlapping monthly windows."""
    items = table(spark, folder, "lineitem")
    return window_measures(
        items, "l_suppkey", "l_shipdate", MONTHS, DELTA,
        [Measure("n_parts", "nunique", F.col("l_partkey")), Measure("lines", "count")],
    )


def label_distinct_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """The opt-in sketch beside the exact count: within four standard errors (and one) of it."""
    measures = [Measure("n_parts", "nunique", F.col("l_partkey")), Measure("about", "sketch", F.col("l_partkey"))]
    found = window_measures(table(spark, folder, "lineitem"), "l_suppkey", "l_shipdate", MONTHS[:12], 4 * DELTA, measures)
    error = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)
    near = F.abs(F.col("about") - F.col("n_parts")) <= F.col("n_parts") * error + 1
    return found.select("cutoff", "l_suppkey", "n_parts", near.alias("within_bound"))


_DISTINCT_PARTS_SQL = """
WITH {cuts}
SELECT cutoff, l_suppkey, count(DISTINCT l_partkey) AS n_parts, {more}
FROM cuts JOIN lineitem ON l_shipdate > cutoff AND l_shipdate <= cutoff + INTERVAL {days} DAY
GROUP BY cutoff, l_suppkey
"""


def active_any_source(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with an order or an event up to the cutoff."""
    sources = [
        (table(spark, folder, "orders"), "o_custkey", "o_orderdate"),
        (table(spark, folder, "events"), "user_id", "ts"),
    ]
    # Cutoffs early in the history, so that the filter really removes customers.
    moments = (*_EARLY, EVENT_CUTOFFS[0])
    return keep_active(customer_keys(spark, folder, moments), "c_custkey", sources)


_EARLY = tuple(c.replace(year=1995, month=m) for m, c in zip((3, 6), ORDER_CUTOFFS))
_ACTIVE_SQL = f"""
WITH {cuts((*_EARLY, EVENT_CUTOFFS[0]))}
SELECT cutoff, c_custkey FROM cuts, customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= cutoff)
   OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ts <= cutoff)
"""


def active_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Existence filter on one source, strictly before the cutoff."""
    sources = [(table(spark, folder, "orders"), "o_custkey", "o_orderdate")]
    return keep_active(customer_keys(spark, folder, _EARLY), "c_custkey", sources, inclusive=False)


_ACTIVE_ONE_SQL = f"""
WITH {cuts(_EARLY)}
SELECT cutoff, c_custkey FROM cuts, customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate < cutoff)
"""


def asof_click_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases preceded by a click of the same user."""
    events = table(spark, folder, "events").selectExpr(
        "*", "case when event_type = 'click' then 1 else 0 end as is_click"
    )
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = events.where(F.coalesce(is_truthy(F.col("is_click")), F.lit(0)) == 1)
    return asof_flag(purchases, "ts", clicks, "ts", [("user_id", "user_id")], "after_click")


_ASOF_SQL = """
SELECT event_id, user_id, ts, CASE WHEN EXISTS (
  SELECT 1 FROM events s WHERE s.user_id = v.user_id AND s.ts <= v.ts AND s.event_type = 'click')
  THEN 1 ELSE 0 END AS after_click
FROM events v WHERE event_type = 'purchase'
"""


def amount_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Line amount: its own price if present, else the part's price, else 0."""
    items = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "case when l_returnflag = 'R' then 'n/a' else cast(l_extendedprice as string) end as price",
    )
    part = table(spark, folder, "part").selectExpr(
        "p_partkey", "case when p_size > 5 then cast(p_retailprice as string) else 'unknown' end as p_price"
    )
    lines = with_amount(items, part, "l_partkey", "p_partkey", "amount", "price", "p_price")
    lines = lines.withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    late = F.datediff(F.lit("2001-01-01").cast("date"), F.col("l_shipdate").cast("date"))
    return lines.groupBy("l_suppkey").agg(
        F.sum("amount").cast("double").alias("amount"),
        F.count_if(F.col("amount") == 0).alias("without_price"),
        F.max(late).cast("bigint").alias("oldest_days"),
    )


_AMOUNT_SQL = f"""
SELECT l_suppkey, CAST(sum(amount) AS DOUBLE) AS amount, count(*) FILTER (WHERE amount = 0) AS without_price,
  max(date_diff('day', l_shipdate, TIMESTAMP '2001-01-01')) AS oldest_days
FROM (
  SELECT l_suppkey, l_shipdate, CASE WHEN l_returnflag <> 'R' THEN {dec("l_extendedprice")}
    WHEN p_size > 5 THEN {dec("p_retailprice")} ELSE 0 END AS amount
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
GROUP BY l_suppkey
"""

def active_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The same existence as a key set: every (cutoff, customer) seen so far."""
    sources = [(table(spark, folder, "orders"), "o_custkey", "o_orderdate")]
    return active_by(sources, _EARLY, name="c_custkey")


_ACTIVE_KEYS_SQL = f"""
WITH {cuts(_EARLY)}
SELECT DISTINCT cutoff, o_custkey AS c_custkey FROM cuts JOIN orders ON o_orderdate <= cutoff
"""

QUERIES = {
    "label_churn": label_churn,
    "label_ltv": label_ltv,
    "label_distinct": label_distinct,
    "label_conditional": label_conditional,
    "label_active_fraction": label_active_fraction,
    "label_eligible": label_eligible,
    "label_item_ltv": label_item_ltv,
    "label_ltv_by_price": label_ltv_by_price,
    "label_distinct_schedule": label_distinct_schedule,
    "label_distinct_sketch": label_distinct_sketch,
    "active_any_source": active_any_source,
    "active_customers": active_customers,
    "active_keys": active_keys,
    "asof_click_flag": asof_click_flag,
    "amount_fallback": amount_fallback,
}

SQL = {
    "label_churn": _CHURN_SQL,
    "label_ltv": _LTV_SQL,
    "label_distinct": _DISTINCT_SQL,
    "label_conditional": _CONDITIONAL_SQL,
    "label_active_fraction": _FRACTION_SQL,
    "label_eligible": _ELIGIBLE_SQL,
    "label_item_ltv": _ITEM_LTV_SQL,
    "label_ltv_by_price": _PRICE_LTV_SQL,
    "label_distinct_schedule": _DISTINCT_PARTS_SQL.format(cuts=cuts(MONTHS), more="count(*) AS lines", days=90),
    "label_distinct_sketch": _DISTINCT_PARTS_SQL.format(cuts=cuts(MONTHS[:12]), more="TRUE AS within_bound", days=360),
    "active_any_source": _ACTIVE_SQL,
    "active_customers": _ACTIVE_ONE_SQL,
    "active_keys": _ACTIVE_KEYS_SQL,
    "asof_click_flag": _ASOF_SQL,
    "amount_fallback": _AMOUNT_SQL,
}
