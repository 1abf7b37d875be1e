"""Feature families, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relpoint.catalog.common import (
    EVENT_CUTOFFS,
    ORDER_CUTOFFS,
    cuts,
    davg,
    dec,
    dsum,
    numeric_sql,
    rounded,
    table,
    zero,
)
from relpoint.plans.compiler import frame
from relpoint.spec import CompressionGraph, Edge, Relation

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
WINDOWS = (3, 7)


def _users(spark: SparkSession, folder: str) -> Relation:
    return Relation("customer", table(spark, folder, "customer"), "c_custkey", "cus", columns=())


def _event_frame(spark: SparkSession, folder: str, inclusive: bool = True, **options) -> DataFrame:
    events = Relation("events", table(spark, folder, "events"), "event_id", "evt", "ts", **options)
    edge = Edge("customer", "events", "c_custkey", "user_id")
    graph = CompressionGraph(
        "customer", (_users(spark, folder), events), (edge,), EVENT_CUTOFFS, inclusive=inclusive
    )
    return frame(graph)


def _per_user(body: str, columns: str) -> str:
    return f"""
WITH {cuts(EVENT_CUTOFFS)},
vis AS (SELECT cutoff, e.* FROM cuts JOIN events e ON ts <= cutoff),
agg AS ({body})
SELECT c.cutoff, c_custkey AS cus_c_custkey, {columns}
FROM (SELECT cutoff, c_custkey FROM cuts, customer) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = c_custkey
"""


def order_semantic_flags(spark: SparkSession, folder: str) -> DataFrame:
    orders = Relation(
        "orders",
        table(spark, folder, "orders"),
        "o_orderkey",
        "ord",
        "o_orderdate",
        columns=("o_orderpriority",),
        annotations={
            "is_urgent": "{o_orderpriority} IN ('1-URGENT', '2-HIGH')",
            "is_large": "{o_totalprice} >= 100000 AND {o_totalprice} <= 250000",
        },
        families=("base", "semantic"),
        stats=("count",),
    )
    graph = CompressionGraph(
        "customer",
        (_users(spark, folder), orders),
        (Edge("customer", "orders", "c_custkey", "o_custkey"),),
        ORDER_CUTOFFS,
    )
    return frame(graph)


_SEMANTIC_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
agg AS (
  SELECT cutoff, o_custkey AS k, count(*) AS ord_n_rows,
    count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS ord_is_urgent_count,
    count(*) FILTER (WHERE o_totalprice BETWEEN 100000 AND 250000) AS ord_is_large_count
  FROM cuts JOIN orders ON o_orderdate < cutoff GROUP BY cutoff, o_custkey)
SELECT c.cutoff, c_custkey AS cus_c_custkey,
  {zero("ord_n_rows", "ord_is_urgent_count", "ord_is_large_count")},
  CAST(ord_is_urgent_count AS DOUBLE) / ord_n_rows AS ord_is_urgent_share,
  CAST(ord_is_large_count AS DOUBLE) / ord_n_rows AS ord_is_large_share
FROM (SELECT cutoff, c_custkey FROM cuts, customer) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = c_custkey
"""


def event_conditional_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Flag and top category counts and shares per window; categories are profiled."""
    return _event_frame(
        spark,
        folder,
        columns=("event_type",),
        annotations={"is_big": "{value} > 50"},
        families=("conditional",),
        stats=("topk",),
        windows=WINDOWS,
        top_k=5,
    )


def _conditional_sql() -> str:
    tests = {"evt_is_big": "value > 50"}
    tests |= {f"evt_event_type_{t}": f"event_type = '{t}'" for t in EVENT_TYPES}
    inner, outer = [], []
    for w in WINDOWS:
        inside = f"ts > cutoff - INTERVAL {w} DAY"
        inner.append(f"count(*) FILTER (WHERE {inside}) AS evt_n_rows_{w}d")
        outer.append(f"evt_n_rows_{w}d")
        for name, test in tests.items():
            inner.append(f"count(*) FILTER (WHERE {inside} AND {test}) AS {name}_count_{w}d")
            outer.append(f"{name}_count_{w}d")
    shares = ", ".join(
        f"CAST({n}_count_{w}d AS DOUBLE) / NULLIF(evt_n_rows_{w}d, 0) AS {n}_share_{w}d"
        for n in tests
        for w in WINDOWS
    )
    body = (
        f"SELECT cutoff, user_id AS k, count(*) AS evt_n_rows, {', '.join(inner)} "
        "FROM vis GROUP BY cutoff, user_id"
    )
    return _per_user(body, f"{zero('evt_n_rows', *outer, alias='agg.')}, {shares}")


def event_temporal_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _event_frame(
        spark,
        folder,
        columns=("value",),
        families=("base", "temporal"),
        stats=("count", "sum", "avg", "min", "max"),
        windows=WINDOWS,
    )


def _temporal_sql() -> str:
    inner, counts, values = [], ["evt_n_rows"], []
    for w in WINDOWS:
        inside = f"ts > cutoff - INTERVAL {w} DAY"
        inner += [
            f"count(*) FILTER (WHERE {inside}) AS evt_n_rows_{w}d",
            f"count(value) FILTER (WHERE {inside}) AS evt_value_count_{w}d",
            f"{dsum('value', inside)} AS evt_value_sum_{w}d",
            f"{davg('value', inside)} AS evt_value_avg_{w}d",
            f"CAST(min({dec('value')}) FILTER (WHERE {inside}) AS DOUBLE) AS evt_value_min_{w}d",
            f"CAST(max({dec('value')}) FILTER (WHERE {inside}) AS DOUBLE) AS evt_value_max_{w}d",
        ]
        counts += [f"evt_n_rows_{w}d", f"evt_value_count_{w}d"]
        values += [f"evt_value_{s}_{w}d" for s in ("sum", "avg", "min", "max")]
    stats = ("sum", "avg", "min", "max")
    body = (
        f"SELECT cutoff, user_id AS k, count(*) AS evt_n_rows, {numeric_sql('value', 'evt', stats)}, "
        f"{', '.join(inner)} FROM vis GROUP BY cutoff, user_id"
    )
    values += [f"evt_value_{s}" for s in stats]
    return _per_user(body, f"{zero(*counts, alias='agg.')}, {', '.join(values)}")


def event_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps, burstiness and concentration of each user's events."""
    df = _event_frame(
        spark, folder, columns=("event_type",), families=("sequence",), stats=("count",),
    )
    noisy = ["evt_gap_mean", "evt_gap_std", "evt_gap_min", "evt_gap_max", "evt_burstiness"]
    return rounded(df, noisy, 6)


_SEQUENCE_BODY = """
SELECT a.*, gap_mean, gap_std, gap_min, gap_max, q AS evt_event_type_concentration,
  x AS evt_event_type_top_share
FROM (SELECT cutoff, user_id AS k, count(*) AS evt_n_rows,
        count(DISTINCT CAST(ts AS DATE)) AS evt_active_days
      FROM vis GROUP BY cutoff, user_id) a
LEFT JOIN (
  SELECT cutoff, user_id AS k, avg(g) AS gap_mean, stddev_pop(g) AS gap_std, min(g) AS gap_min, max(g) AS gap_max
  FROM (SELECT cutoff, user_id,
          (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY cutoff, user_id ORDER BY ts, event_id)))
            / 86400000000.0 AS g
        FROM vis)
  WHERE g IS NOT NULL GROUP BY cutoff, user_id) b ON b.cutoff = a.cutoff AND b.k = a.k
LEFT JOIN (
  SELECT cutoff, user_id AS k, sum(CAST(n AS DOUBLE) * n) / (CAST(sum(n) AS DOUBLE) * CAST(sum(n) AS DOUBLE)) AS q,
    CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS x
  FROM (SELECT cutoff, user_id, event_type, count(*) AS n FROM vis GROUP BY ALL)
  GROUP BY cutoff, user_id) d ON d.cutoff = a.cutoff AND d.k = a.k
"""
_SEQUENCE_SQL = _per_user(
    _SEQUENCE_BODY,
    f"""{zero("evt_n_rows", "evt_active_days")},
  round(gap_mean, 6) AS evt_gap_mean, round(gap_std, 6) AS evt_gap_std,
  round(gap_min, 6) AS evt_gap_min, round(gap_max, 6) AS evt_gap_max,
  round((gap_std - gap_mean) / NULLIF(gap_std + gap_mean, 0), 6) AS evt_burstiness,
  evt_event_type_concentration, evt_event_type_top_share""",
)


def lineitem_episode(spark: SparkSession, folder: str) -> DataFrame:
    """part <- lineitem: rows versus distinct orders."""
    part = Relation("part", table(spark, folder, "part"), "p_partkey", "prt", columns=("p_brand",))
    items = Relation(
        "lineitem",
        table(spark, folder, "lineitem"),
        "l_linenumber",
        "li",
        "l_shipdate",
        columns=(),
        families=("base", "episode"),
        stats=("count",),
        episode_keys=("l_orderkey",),
    )
    graph = CompressionGraph(
        "part", (part, items), (Edge("part", "lineitem", "p_partkey", "l_partkey"),), ORDER_CUTOFFS
    )
    return frame(graph)


_EPISODE_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
agg AS (
  SELECT cutoff, l_partkey AS k, count(*) AS li_n_rows, count(DISTINCT l_orderkey) AS li_episodes
  FROM cuts JOIN lineitem ON l_shipdate < cutoff GROUP BY cutoff, l_partkey)
SELECT c.cutoff, p_partkey AS prt_p_partkey, p_brand AS prt_p_brand, {zero("li_n_rows", "li_episodes")},
  CAST(li_n_rows AS DOUBLE) / li_episodes AS li_rows_per_episode,
  1.0::DOUBLE - CAST(li_episodes AS DOUBLE) / li_n_rows AS li_repeat_share
FROM (SELECT cutoff, part.* FROM cuts, part) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = p_partkey
"""

_CONTEXT = ("li_l_quantity_peer_diff", "li_l_quantity_peer_ratio", "li_l_quantity_peer_z", "li_l_quantity_peer_rank")


def lineitem_context(spark: SparkSession, folder: str) -> DataFrame:
    """supplier <- lineitem, each line compared with the visible lines of its part."""
    supplier = Relation("supplier", table(spark, folder, "supplier"), "s_suppkey", "sup", columns=())
    items = Relation(
        "lineitem",
        table(spark, folder, "lineitem"),
        "l_linenumber",
        "li",
        "l_shipdate",
        columns=("l_quantity",),
        families=("base", "context"),
        stats=("count",),
        context_keys=("l_partkey",),
        context_rank=True,
    )
    graph = CompressionGraph(
        "supplier", (supplier, items), (Edge("supplier", "lineitem", "s_suppkey", "l_suppkey"),), ORDER_CUTOFFS
    )
    return rounded(frame(graph), _CONTEXT, 5)


_CONTEXT_SQL = f"""
WITH {cuts(ORDER_CUTOFFS)},
peers AS (
  SELECT cutoff, l_suppkey, l_quantity AS x, avg(l_quantity) OVER p AS m, stddev_pop(l_quantity) OVER p AS s,
    cume_dist() OVER (PARTITION BY cutoff, l_partkey ORDER BY l_quantity) AS r
  FROM cuts JOIN lineitem ON l_shipdate < cutoff
  WINDOW p AS (PARTITION BY cutoff, l_partkey)),
agg AS (
  SELECT cutoff, l_suppkey AS k, count(*) AS li_n_rows, avg(x - m) AS d, avg(x / NULLIF(m, 0)) AS q,
    avg(CASE WHEN s > 0 THEN (x - m) / s END) AS z, avg(r) AS r
  FROM peers GROUP BY cutoff, l_suppkey)
SELECT c.cutoff, s_suppkey AS sup_s_suppkey, {zero("li_n_rows")},
  round(d, 5) + 0.0 AS li_l_quantity_peer_diff, round(q, 5) + 0.0 AS li_l_quantity_peer_ratio,
  round(z, 5) + 0.0 AS li_l_quantity_peer_z, round(r, 5) + 0.0 AS li_l_quantity_peer_rank
FROM (SELECT cutoff, s_suppkey FROM cuts, supplier) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = s_suppkey
"""


def lineitem_gated(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities and prices summarized under each return flag."""
    supplier = Relation("supplier", table(spark, folder, "supplier"), "s_suppkey", "sup", columns=())
    items = Relation(
        "lineitem",
        table(spark, folder, "lineitem"),
        "l_linenumber",
        "li",
        "l_shipdate",
        columns=("l_quantity", "l_extendedprice", "l_returnflag"),
        stats=("count",),
        categories={"l_returnflag": ("A", "N", "R")},
        gated=(("l_quantity", "l_returnflag"), ("l_extendedprice", "l_returnflag")),
    )
    graph = CompressionGraph(
        "supplier", (supplier, items), (Edge("supplier", "lineitem", "s_suppkey", "l_suppkey"),), ORDER_CUTOFFS
    )
    return frame(graph)


def _gated_sql() -> str:
    items, names = [], []
    for x in ("l_quantity", "l_extendedprice"):
        for v in "ANR":
            name, test = f"li_{x}_if_li_l_returnflag_{v.lower()}", f"l_returnflag = '{v}'"
            items += [f"{dsum(x, test)} AS {name}_sum", f"{davg(x, test)} AS {name}_avg"]
            names += [f"{name}_sum", f"{name}_avg"]
    return f"""
WITH {cuts(ORDER_CUTOFFS)},
agg AS (
  SELECT cutoff, l_suppkey AS k, count(*) AS li_n_rows, {", ".join(items)}
  FROM cuts JOIN lineitem ON l_shipdate < cutoff GROUP BY cutoff, l_suppkey)
SELECT c.cutoff, s_suppkey AS sup_s_suppkey, {zero("li_n_rows")}, {", ".join(names)}
FROM (SELECT cutoff, s_suppkey FROM cuts, supplier) c
LEFT JOIN agg ON agg.cutoff = c.cutoff AND agg.k = s_suppkey
"""


def document_text_features(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths and word counts of whole document texts per source."""
    documents = table(spark, folder, "documents")
    sources = Relation("source", documents.select("source").distinct(), "source", "src", columns=())
    texts = Relation(
        "documents", documents, "doc_id", "doc", columns=("n_chars",), stats=("count", "max"),
        text_columns=("text",),
    )
    graph = CompressionGraph(
        "source", (sources, texts), (Edge("source", "documents", "source", "source"),), ORDER_CUTOFFS[-1:]
    )
    return frame(graph).drop("cutoff")


_WORDS = "len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))"
_TEXT_SQL = f"""
SELECT source AS src_source, count(*) AS doc_n_rows, max(n_chars) AS doc_n_chars_max,
  CAST(sum(length(text)) AS DOUBLE) / count(text) AS doc_text_len_avg,
  CAST(sum({_WORDS}) AS DOUBLE) / count(text) AS doc_text_words_avg,
  CAST(count(*) FILTER (WHERE COALESCE({_WORDS}, 0) = 0) AS DOUBLE) / count(*) AS doc_text_blank_share
FROM documents WHERE source IS NOT NULL GROUP BY source
"""

QUERIES = {
    "order_semantic_flags": order_semantic_flags,
    "event_conditional_windows": event_conditional_windows,
    "event_temporal_windows": event_temporal_windows,
    "event_sequence": event_sequence,
    "lineitem_episode": lineitem_episode,
    "lineitem_context": lineitem_context,
    "lineitem_gated": lineitem_gated,
    "document_text_features": document_text_features,
}

SQL = {
    "order_semantic_flags": _SEMANTIC_SQL,
    "event_conditional_windows": _conditional_sql(),
    "event_temporal_windows": _temporal_sql(),
    "event_sequence": _SEQUENCE_SQL,
    "lineitem_episode": _EPISODE_SQL,
    "lineitem_context": _CONTEXT_SQL,
    "lineitem_gated": _gated_sql(),
    "document_text_features": _TEXT_SQL,
}
