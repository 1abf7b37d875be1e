"""Model fitting on Spark ML: a small grid, the best model by validation score.

Gradient-boosted trees stand in for the boosting library of the usual stack;
scores are therefore comparable in kind, not digit for digit.

Trees only see the bin of a value, so features are cut into bins first. Rows equal in all bins and in the
target are one row with their weights summed up: every row counts, and a fit's passes read distinct rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from itertools import pairwise

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.operators.metrics import absolute_error, ranking_scores
from relpoint.session import reliable

# Fixed value: seed of every fit.
SEED = 42
#: Bins of a feature (as many as Spark ML makes by itself), and distinct rows of one task of a fit.
BINS, TASK_ROWS = 32, 1 << 20
GRID = ({"maxDepth": 4, "maxIter": 20, "stepSize": 0.1}, {"maxDepth": 5, "maxIter": 20, "stepSize": 0.05})


@dataclass(frozen=True)
class Fitted:
    model: PipelineModel
    config: dict
    score: float
    #: Validation score of each configuration of the grid, in its order.
    scores: tuple[float | None, ...] = ()


def bin_edges(train: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Inner edges of each feature's bins: between all values where they are few, else at quantiles of all rows."""
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    counted = train.agg(*(F.approx_count_distinct(x, 0.02).alias(c) for c, x in known.items())).first()
    shares = [i / bins for i in range(1, bins)]
    found = train.agg(
        *(
            F.collect_set(x).alias(c) if counted[c] <= 2 * bins else F.percentile_approx(x, shares, 10_000).alias(c)
            for c, x in known.items()
        )
    ).first()
    edges = []
    for c in features:
        values = sorted(set(found[c] or ()))
        if counted[c] > 2 * bins:
            edges.append(values)
        elif len(values) <= bins:
            edges.append(sorted({low / 2 + high / 2 for low, high in pairwise(values)}))
        else:
            edges.append(sorted({values[i * len(values) // bins] for i in range(1, bins)}))
    return edges


@dataclass(frozen=True)
class TrainingRows:
    """Distinct binned rows with their target and weight, and the stages that bin and gather a row."""

    rows: DataFrame
    target: str
    stages: tuple[Bucketizer | VectorAssembler, ...]

    @classmethod
    def of(cls, train: DataFrame, features: Sequence[str], target: str, weight: str | None = None) -> TrainingRows:
        """``train`` collapsed and stored. Features that aren't numbers are gathered as they are."""
        numbers = [c for c in features if isinstance(train.schema[c].dataType, T.NumericType)]
        binned = {c: f"__bin{i}" for i, c in enumerate(numbers)}
        ends = float("-inf"), float("inf")
        # A feature of one value has no edge, but a bucketizer needs one.
        splits = [[ends[0], *(e for e in found or [0.0] if abs(e) != ends[1]), ends[1]] for found in bin_edges(train, numbers)]
        splits = [own if len(own) > 2 else [ends[0], 0.0, ends[1]] for own in splits]
        cut = Bucketizer(
            splitsArray=splits, inputCols=numbers, outputCols=list(binned.values()), handleInvalid="keep"
        )
        columns = [binned.get(c, c) for c in features]
        gather = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
        stages = (cut, gather) if numbers else (gather,)
        rows = cut.transform(train) if numbers else train
        # NULL shares NaN's bin, the last. Bins are in order, which their metadata (categories) denies.
        missing = {c: F.lit(float(len(own) - 1)) for c, own in zip(binned.values(), splits)}
        rows = rows.withColumns({c: F.coalesce(c, last).alias(c, metadata={}) for c, last in missing.items()})
        total = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
        rows = reliable(rows.groupBy(*dict.fromkeys(columns), target).agg(total.alias("__rows")))
        cores = train.sparkSession.sparkContext.defaultParallelism
        most = -(-rows.count() // TASK_ROWS)
        return cls(rows.repartition(cores * max(1, -(-most // cores))), target, stages)

    def fit(self, estimator: type, config: dict, **fixed) -> PipelineModel:
        # One bin more for missing values.
        params = {"maxBins": BINS + 1, **config, **fixed}
        tree = estimator(labelCol=self.target, weightCol="__rows", seed=SEED, **params)
        gather = self.stages[-1]
        model = Pipeline(stages=[gather, tree]).fit(self.rows)
        return PipelineModel([*self.stages[:-1], *model.stages])


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    bins = [c for stage in model.stages if isinstance(stage, Bucketizer) for c in stage.getOutputCols()]
    return model.transform(df).drop(*bins, "features")


def score_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = _scored(model, df)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


def score_regression(model: PipelineModel, df: DataFrame) -> DataFrame:
    return _scored(model, df).withColumnRenamed("prediction", "score")


def fit_classifier(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    grid: Sequence[dict] = GRID,
) -> Fitted:
    """Best model of the grid by validation AUROC; the first one wins a tie."""
    best: Fitted | None = None
    scores: list[float | None] = []
    rows = TrainingRows.of(train, features, target, weight)
    for config in grid:
        model = rows.fit(GBTClassifier, config)
        auroc = ranking_scores(score_probability(model, validation), target, "score").first()["auroc"]
        scores.append(auroc)
        if auroc is not None and (best is None or auroc > best.score):
            best = Fitted(model, dict(config), auroc)
    if best is None:
        raise RuntimeError("no configuration gave a validation score")
    return replace(best, scores=tuple(scores))


def fit_regressor(
    train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, grid: Sequence[dict] = GRID
) -> Fitted:
    """Best model of the grid by validation MAE; the first one wins a tie."""
    best: Fitted | None = None
    scores: list[float | None] = []
    rows = TrainingRows.of(train, features, target)
    for config in grid:
        model = rows.fit(GBTRegressor, config, lossType="absolute")
        mae = score_regression(model, validation).agg(absolute_error(target, "score")).first()[0]
        scores.append(mae)
        if mae is not None and (best is None or mae < best.score):
            best = Fitted(model, dict(config), mae)
    if best is None:
        raise RuntimeError("no configuration gave a validation score")
    return replace(best, scores=tuple(scores))


def soft_label_rows(train: DataFrame, target: str, label: str = "__label", weight: str = "__weight") -> DataFrame:
    """Fractional targets as weighted 0/1 rows, which makes log loss the cross entropy."""
    y = F.col(target).cast("double")
    bad = y.isNull() | F.isnan(y) | (y < 0) | (y > 1)
    checked = F.when(bad, F.raise_error(F.lit("targets must lie in [0, 1]")).cast("double")).otherwise(y)
    sides = F.array(
        F.struct(F.lit(1.0).alias(label), F.col("__y").alias(weight)),
        F.struct(F.lit(0.0).alias(label), (1.0 - F.col("__y")).alias(weight)),
    )
    rows = train.withColumn("__y", checked).select("*", F.inline(sides)).drop("__y")
    return rows.where(F.col(weight) > 0)


def fit_fractional(
    train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, grid: Sequence[dict] = GRID
) -> Fitted:
    """Probability model for a target in [0, 1], chosen by validation MAE."""
    rows = TrainingRows.of(soft_label_rows(train, target), features, "__label", "__weight")
    best: Fitted | None = None
    scores: list[float | None] = []
    for config in grid:
        model = rows.fit(GBTClassifier, config)
        mae = score_probability(model, validation).agg(absolute_error(target, "score")).first()[0]
        scores.append(mae)
        if mae is not None and (best is None or mae < best.score):
            best = Fitted(model, dict(config), mae)
    if best is None:
        raise RuntimeError("no configuration gave a validation score")
    return replace(best, scores=tuple(scores))
