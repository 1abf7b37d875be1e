"""Boosted trees: a stated ensemble scored on the tables, and fits that have to recover a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.catalog.common import TEST, VALIDATION, dec, rounded, stamp, table
from relpoint.operators.fit import fit_classifier, fit_regressor, score_probability, score_regression
from relpoint.operators.metrics import ranking_scores
from relpoint.operators.trees import NODES, Ensemble, stage_losses, stop_early
from relpoint.session import reliable

# A stated ensemble over orders, as (tree, weight, node, feature, threshold, value).
STATED = (
    (0, 1.0, 1, "o_totalprice", 150000.0, None),
    (0, 1.0, 2, "month", 6.0, None),
    (0, 1.0, 3, None, None, 0.75),
    (0, 1.0, 4, None, None, -0.5),
    (0, 1.0, 5, None, None, 0.125),
    (1, 0.5, 1, "weekday", 3.0, None),
    (1, 0.5, 2, None, None, -0.25),
    (1, 0.5, 3, "o_totalprice", 60000.0, None),
    (1, 0.5, 6, None, None, 0.5),
    (1, 0.5, 7, "balance", 0.0, None),
    (1, 0.5, 14, None, None, -1.0),
    (1, 0.5, 15, None, None, 1.0),
    (2, 0.25, 1, None, None, -0.125),
)


def _order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with calendar columns and the customer's balance, NULL where it is unknown or negative."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance")
    )
    orders = table(spark, folder, "orders").join(customers, "o_custkey", "left")
    return orders.select(
        "o_orderkey", "o_orderdate", "o_totalprice", "balance",
        F.month("o_orderdate").alias("month"),
        F.weekday("o_orderdate").alias("weekday"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
    )


_ROWS = f"""rows AS (SELECT o_orderkey, o_orderdate, CAST({dec("o_totalprice")} AS DOUBLE) AS o_totalprice,
  CASE WHEN c_acctbal >= 0 THEN CAST({dec("c_acctbal")} AS DOUBLE) END AS balance,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(o_orderstatus = 'F' AS INTEGER) AS done
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def _stated(spark: SparkSession) -> Ensemble:
    return Ensemble.read(spark.createDataFrame(STATED, NODES), classify=True)


def tree_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every order scored by the stated ensemble, a projection on the scan and one lookup."""
    rows = _order_rows(spark, folder)
    ensemble = _stated(spark)
    scored = rows.select("o_orderkey", ensemble.margin().alias("margin"), ensemble.score().alias("score"))
    return rounded(scored, ["margin", "score"], 9)


def tree_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Log loss after each tree of the stated ensemble and AUROC of the whole, against finished orders."""
    rows = _order_rows(spark, folder)
    ensemble = _stated(spark)
    losses = stage_losses(ensemble, rows, "done")
    kept = len(stop_early(ensemble, rows, "done").trees())
    ranks = ranking_scores(rows.select("done", ensemble.score().alias("score")), "done", "score").select("auroc")
    staged = [F.lit(loss).alias(f"loss_{k}") for k, loss in enumerate(losses, 1)]
    return rounded(ranks.select("auroc", *staged, F.lit(kept).alias("kept")), ["auroc", "loss_1", "loss_2", "loss_3"], 9)


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)


# The oracle walks the nodes level by level: a join per step, no nested conditions.
_WALK = f"""
nodes(tree, weight, node, feature, threshold, value) AS (VALUES {", ".join(
    "(" + ", ".join(_literal(v) for v in row) + ")" for row in STATED)}),
walk AS (
  SELECT o_orderkey, tree, 1 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT w.o_orderkey, w.tree, 2 * w.node + CASE WHEN CASE n.feature WHEN 'o_totalprice' THEN r.o_totalprice
    WHEN 'month' THEN r.month WHEN 'weekday' THEN r.weekday WHEN 'balance' THEN r.balance END <= n.threshold
    THEN 0 ELSE 1 END
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NOT NULL
  JOIN rows r ON r.o_orderkey = w.o_orderkey
),
answers AS (SELECT o_orderkey, w.tree, n.weight * n.value AS value
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n.feature IS NULL)"""

_SCORES_SQL = f"""
WITH RECURSIVE {_ROWS}, {_WALK}
SELECT o_orderkey, round(sum(value), 9)::DOUBLE AS margin, round(1 / (1 + exp(-2 * sum(value)::DOUBLE)), 9) AS score
FROM answers GROUP BY o_orderkey
"""

_STAGES_SQL = f"""
WITH RECURSIVE {_ROWS}, {_WALK},
staged AS (SELECT o_orderkey, tree,
  CAST(sum(value) OVER (PARTITION BY o_orderkey ORDER BY tree) AS DOUBLE) AS margin FROM answers),
losses AS (SELECT tree, avg(ln(1 + exp(CASE WHEN done = 1 THEN -2 ELSE 2 END * margin))) AS loss
  FROM staged JOIN rows USING (o_orderkey) GROUP BY tree),
counts AS (SELECT margin, count(*) FILTER (WHERE done = 1) AS pos, count(*) FILTER (WHERE done = 0) AS neg
  FROM staged JOIN rows USING (o_orderkey) WHERE tree = 2 GROUP BY margin),
won AS (SELECT sum(x.pos * y.neg * CASE WHEN x.margin > y.margin THEN 1.0 WHEN x.margin = y.margin THEN 0.5 ELSE 0 END)
  AS pairs FROM counts x, counts y)
SELECT round(CAST(pairs AS DOUBLE) / (SELECT sum(pos) * sum(neg) FROM counts), 9) AS auroc,
  (SELECT round(loss, 9) FROM losses WHERE tree = 0) AS loss_1,
  (SELECT round(loss, 9) FROM losses WHERE tree = 1) AS loss_2,
  (SELECT round(loss, 9) FROM losses WHERE tree = 2) AS loss_3,
  CAST((SELECT tree + 1 FROM losses ORDER BY loss, tree LIMIT 1) AS INTEGER) AS kept
FROM won
"""

_FEATURES = ("o_totalprice", "month", "weekday", "priority", "done")
#: Levels of the value rule lie this far apart.
_STEP = 100.0


def gbt_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Both fits on targets that follow a rule of the features: each test order with what was learned.

    The class is 1 for priorities 1 and 2 from April to September, the value one of four levels by weekend
    and half year. Fitted before validation, stopped early on validation, scored after it: by Spark ML and
    by the trees as a table. A wrong split, threshold, leaf or stage gives another class or level.
    """
    season = F.col("month").between(4, 9)
    late, weekend = F.col("month") > 6, F.col("weekday") > 4
    rows = reliable(
        _order_rows(spark, folder).select(
            "o_orderkey", "o_orderdate", *(F.col(c).cast("double").alias(c) for c in _FEATURES),
            (season & (F.col("priority") <= 2)).cast("int").alias("flag"),
            (_STEP * (1 + 2 * late.cast("int") + weekend.cast("int"))).alias("amount"),
        )
    )
    early, last = F.expr(stamp(VALIDATION)), F.expr(stamp(TEST))
    train = rows.where(F.col("o_orderdate") < early)
    validation = rows.where((F.col("o_orderdate") >= early) & (F.col("o_orderdate") < last))
    test = rows.where(F.col("o_orderdate") >= last)
    flags = fit_classifier(train, validation, _FEATURES, "flag")
    amounts = fit_regressor(train, validation, _FEATURES, "amount")
    flag = stop_early(Ensemble.of(flags.model, _FEATURES), validation, "flag")
    amount = stop_early(Ensemble.of(amounts.model, _FEATURES), validation, "amount")
    own = test.withColumns({"by_table": flag.score(), "value_by_table": amount.score()})
    by_model = score_probability(flags.model, own).withColumnRenamed("score", "by_model")
    both = score_regression(amounts.model, by_model).withColumnRenamed("score", "value_by_model")
    return both.select(
        "o_orderkey",
        *((F.col(c) >= 0.5).cast("int").alias(f"flag_{c}") for c in ("by_table", "by_model")),
        *((F.round(F.col(c) / _STEP) * _STEP).alias(c) for c in ("value_by_table", "value_by_model")),
    )


_FLAG = "CAST(month BETWEEN 4 AND 9 AND priority <= 2 AS INTEGER)"
_VALUE = f"{_STEP}::DOUBLE * (1 + 2 * CAST(month > 6 AS INTEGER) + CAST(weekday > 4 AS INTEGER))"
_RULE_SQL = f"""
WITH {_ROWS}
SELECT o_orderkey, {_FLAG} AS flag_by_table, {_FLAG} AS flag_by_model,
  {_VALUE} AS value_by_table, {_VALUE} AS value_by_model
FROM rows WHERE o_orderdate >= {stamp(TEST)}
"""

QUERIES = {"tree_scores": tree_scores, "tree_stages": tree_stages, "gbt_rule": gbt_rule}

SQL = {"tree_scores": _SCORES_SQL, "tree_stages": _STAGES_SQL, "gbt_rule": _RULE_SQL}
