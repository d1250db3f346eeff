"""Models with Spark ML: ensembles, folds, calibration, bands, scoring, training frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapewright.functions.checks import require
from tapewright.operators.features import require_no_labels


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def filled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing features as 0 beside a fixed contract of names."""
    return require(rows, features).fillna(0.0, subset=list(features))


def seed_ensemble(train: DataFrame, features: Sequence[str], label: str, seeds: Sequence[int] = (1, 2), trees: int = 8, depth: int = 3) -> list[PipelineModel]:
    """M1: boosted trees on absolute loss, one for each seed (subsampled, so that seeds differ)."""
    require_no_labels(features, [label, "net", "gross"])
    rows = filled(train.where(F.col(label).isNotNull()), features)
    return [Pipeline(stages=[_assembler(features), GBTRegressor(labelCol=label, lossType="absolute", maxIter=trees, maxDepth=depth, seed=s, subsamplingRate=0.8)]).fit(rows) for s in seeds]


def score(rows: DataFrame, models: Sequence[PipelineModel], features: Sequence[str], out: str = "pred") -> DataFrame:
    """M5: the mean prediction of the models for every row."""
    scored = filled(rows, features)
    for k, m in enumerate(models):
        scored = m.transform(scored).withColumnRenamed("prediction", f"_p{k}").drop("features")
    mean = sum((F.col(f"_p{k}") for k in range(len(models))), F.lit(0.0)) / len(models)
    return scored.withColumn(out, mean).drop(*(f"_p{k}" for k in range(len(models))))


def oof_predictions(rows: DataFrame, folds: DataFrame, n_folds: int, features: Sequence[str], label: str, seeds: Sequence[int] = (1,), trees: int = 5) -> DataFrame:
    """M2: M1's ensemble fitted on each fold's training dates, predictions of its test dates; each fit is a Spark job.

    folds: date, fold, role. Folds without training rows give nothing; with none at all the result is empty.
    """
    joined = filled(rows, features).join(folds, "date")
    out = joined.drop("role").withColumn("pred", F.lit(None).cast("double")).where(F.lit(False))
    for k in range(n_folds):
        fold = joined.where(F.col("fold") == k)
        train = fold.where("role = 'train'").where(F.col(label).isNotNull())
        if not train.isEmpty():
            models = seed_ensemble(train, features, label, seeds, trees)
            out = out.unionByName(score(fold.where("role = 'test'").drop("role"), models, features))
    return out


def platt(rows: DataFrame, features: Sequence[str], outcome: str, split: str, embargo_days: int = 5) -> DataFrame:
    """M3: a classifier fitted on the dates before the split, and on those from the end of the embargo a logistic curve from its score to the outcome.

    Rows get `raw` (the classifier's log odds) and `probability`. Rows inside the embargo teach neither.
    """
    known = filled(rows, features).where(F.col(outcome).isNotNull())
    cut = F.lit(split).cast("date")
    early, late = known.where(F.col("date") < cut), known.where(F.col("date") >= F.date_add(cut, embargo_days))
    first = Pipeline(stages=[_assembler(features), LogisticRegression(labelCol=outcome, regParam=0.01)]).fit(early)
    raw = lambda df: first.transform(df).withColumn("raw", F.element_at(_to_array("rawPrediction"), 2)).drop("features", "rawPrediction", "prediction", "probability")
    second = Pipeline(stages=[VectorAssembler(inputCols=["raw"], outputCol="features"), LogisticRegression(labelCol=outcome)]).fit(raw(late))
    scored = second.transform(raw(filled(rows, features)))
    return scored.withColumn("probability", F.element_at(_to_array("probability"), 2)).drop("features", "rawPrediction", "prediction")


def _to_array(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)


def quantile_bands(rows: DataFrame, label: str, pred: str = "pred") -> DataFrame:
    """M4: the prediction plus residual quantiles, in order: q10 <= q50 <= q90."""
    res = rows.where(F.col(label).isNotNull()).agg(*(F.percentile(F.col(label) - F.col(pred), F.lit(q / 100)).alias(f"_r{q}") for q in (10, 50, 90)))
    j = rows.crossJoin(F.broadcast(res))
    q = {k: F.col(pred) + F.col(f"_r{k}") for k in (10, 50, 90)}
    return j.withColumn("q50", q[50]).withColumn("q10", F.least(q[10], q[50])).withColumn("q90", F.greatest(q[90], q[50])).drop("_r10", "_r50", "_r90")


def training_frame(before: DataFrame, store: DataFrame, store_from: str) -> DataFrame:
    """M6: rows before the store begins and labelled rows of the store, with their tier."""
    first = F.lit(store_from).cast("date")
    return before.where(F.col("date") < first).withColumn("tier", F.lit("eod")).unionByName(store.where(F.col("date") >= first).where("net is not null").withColumn("tier", F.lit("store")))


def tiered_dataset(tiers: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("date", "symbol")) -> DataFrame:
    """M8: the rows of all tiers, each key from the first tier that has it, with its tier."""
    rows = None
    for k, (name, df) in enumerate(tiers):
        named = df.withColumn("tier", F.lit(name)).withColumn("_tier", F.lit(k))
        rows = named if rows is None else rows.unionByName(named)
    best = F.min("_tier").over(W.partitionBy(*keys))
    return rows.withColumn("_best", best).where("_tier = _best").drop("_tier", "_best")
