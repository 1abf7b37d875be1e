"""Scores of predictions: ranking, threshold and error metrics, candidate choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relpoint.functions.ordered import running_totals
from relpoint.functions.scalars import amount_target, clip_unit, ratio

#: In order of preference on ties.
CANDIDATES = ("clipped_value", "probability", "mean_of_both")


def ranking_scores(predictions: DataFrame, truth: str, score: str) -> DataFrame:
    """AUROC (ties count half) and average precision in one row.

    Rows are folded to distinct scores first; the running counts over scores are
    taken slice by slice, so no task sorts the whole table.
    """
    y, s = F.col(truth), F.col(score).cast("double")
    folded = predictions.groupBy(s.alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    ordered = running_totals(folded, [], "s", ["pos", "neg"])
    pos, neg = F.col("pos"), F.col("neg")
    p, n = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    won = pos.cast("double") * (F.col("neg_before") + neg / F.lit(2.0))
    above = F.col("pos_total") - F.col("pos_before")
    at_or_above = above + F.col("neg_total") - F.col("neg_before")
    return ordered.agg(
        F.try_divide(F.sum(won), F.max(p * n)).alias("auroc"),
        F.try_divide(F.sum(pos * ratio(above, at_or_above)), F.max(p)).alias("average_precision"),
    )


def threshold_scores(predictions: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy and F1 of the positive class at a threshold."""
    y, hit = F.col(truth), F.col(score).cast("double") >= threshold
    tp, fp = F.count_if(hit & (y == 1)), F.count_if(hit & (y == 0))
    fn, tn = F.count_if(~hit & (y == 1)), F.count_if(~hit & (y == 0))
    return predictions.agg(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), F.lit(0.0)).alias("f1"),
    )


def absolute_error(truth: str, prediction: str) -> Column:
    return F.avg(F.abs(amount_target(F.col(truth)) - amount_target(F.col(prediction))))


def error_scores(predictions: DataFrame, truth: str, prediction: str, train: DataFrame, target: str) -> DataFrame:
    """MAE and MAE over the population deviation of the train target.

    A zero, missing or non-finite deviation raises instead of giving a number.
    """
    deviation = train.agg(F.stddev_pop(amount_target(F.col(target)))).scalar()
    scored = predictions.agg(absolute_error(truth, prediction).alias("mae")).withColumn("std", deviation)
    std = F.col("std")
    broken = std.isNull() | F.isnan(std) | (std <= 0) | (std == F.lit(float("inf")))
    guarded = F.when(broken, F.raise_error(F.lit("train target deviation is zero or not finite")).cast("double"))
    return scored.select("mae", (F.col("mae") / guarded.otherwise(std)).alias("nmae"))


def candidates(predictions: DataFrame, regression: str, probability: str) -> DataFrame:
    """Long form (…, candidate, prediction): both bounded predictions and their blend."""
    r, p = clip_unit(F.col(regression)), clip_unit(F.col(probability))
    values = (r, p, F.lit(0.5) * (r + p))
    pairs = F.array(
        *(F.struct(F.lit(n).alias("candidate"), v.alias("prediction")) for n, v in zip(CANDIDATES, values))
    )
    return predictions.select("*", F.inline(pairs))


def candidate_scores(validation: DataFrame, truth: str, regression: str, probability: str) -> DataFrame:
    """Validation MAE of every candidate."""
    long = candidates(validation, regression, probability)
    return long.groupBy("candidate").agg(absolute_error(truth, "prediction").alias("mae"))


def choose_candidate(scores: DataFrame) -> DataFrame:
    """Candidate with the smallest MAE; ties go to the earlier name (three rows at most)."""
    order = F.array_position(F.array(*(F.lit(c) for c in CANDIDATES)), F.col("candidate"))
    best = F.min(F.struct(F.col("mae"), order.alias("o"), F.col("candidate"))).alias("b")
    return scores.agg(best).select(F.col("b.candidate").alias("candidate"), F.col("b.mae").alias("mae"))


def apply_candidate(test: DataFrame, chosen: DataFrame, regression: str, probability: str) -> DataFrame:
    """Predictions of the chosen candidate on another split."""
    name = chosen.select("candidate").scalar()
    long = candidates(test, regression, probability).withColumn("__chosen", name)
    return long.where(F.col("candidate") == F.col("__chosen")).drop("__chosen")
