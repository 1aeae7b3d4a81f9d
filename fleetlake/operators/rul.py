"""Remaining-life models: split by unit, train, evaluate, score."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.operators.features import sequences
from fleetlake.schemas import ENGINE, KEPT, NORMS, ROLLING, TABLES

FEATURES = ["cycle", "op_condition_cluster", *NORMS, *ROLLING, "health_index"]
#: Per step of a sequence; cycles are scaled by about the longest life.
STEP_FEATURES, LONGEST = [*NORMS, *ROLLING, "health_index", "cycle_norm"], 300.0
CAP = 130
SPLITS = ("train", "holdout", "nasa_test", "operational")
assert len(FEATURES) == 6 + len(KEPT)


def prepared(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Null and NaN deviations and slopes become 0; rul_capped is the label up to the cap (the cap for a null label)."""
    capped = F.least(F.col("rul_label").cast("double"), F.lit(float(cap)))
    return rows.withColumns({c: expr.filled(c) for c in ROLLING[1:]}).withColumn("rul_capped", capped)


def split(rows: DataFrame, ratio: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and holdout rows; an engine is on one side only."""
    side = expr.split_of([F.col(c) for c in ENGINE], ratio, seed)
    return rows.where(side), rows.where(~side)


def fit(rows: DataFrame, max_iter: int = 50, max_depth: int = 5, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="skip")
    trees = GBTRegressor(featuresCol="features", labelCol="rul_capped", predictionCol="prediction", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(rows)


def sequence_vectors(rows: DataFrame, window: int = 30) -> DataFrame:
    """Prepared rows with ``features``: the engine's last ``window`` steps side by side, padded with the earliest."""
    steps = sequences(rows.withColumn("cycle_norm", F.col("cycle") / LONGEST), STEP_FEATURES, window)
    return steps.withColumn("features", array_to_vector(F.flatten("sequence"))).drop("sequence")


def fit_sequences(rows: DataFrame, window: int = 30, max_iter: int = 20, max_depth: int = 5, seed: int = 42) -> PipelineModel:
    """A model over sequences; score with transform(sequence_vectors(rows, window))."""
    trees = GBTRegressor(featuresCol="features", labelCol="rul_capped", predictionCol="prediction", maxIter=max_iter, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[trees]).fit(sequence_vectors(rows, window))


def residual_sigma(scored: DataFrame) -> float:
    """Sample deviation of capped label minus prediction, 0 where there are too few rows."""
    return scored.agg(F.stddev_samp(F.col("rul_capped") - F.col("prediction"))).first()[0] or 0.0


def prediction_columns(prediction: Column, actual: Column, sigma: float) -> dict[str, Column]:
    """Bounds, errors against the uncapped label, score and tier of a prediction."""
    difference = prediction - actual
    return {
        "rul_pred": prediction,
        "rul_pred_lower": F.greatest(prediction - expr.Z90 * sigma, F.lit(0.0)),
        "rul_pred_upper": prediction + expr.Z90 * sigma,
        "rul_actual": actual.cast("int"),
        "abs_error": F.abs(difference),
        "phm08_score": expr.phm08(difference),
        "risk_tier": expr.risk_tier(prediction),
    }


def predictions(scored: DataFrame, version: str, sigma: float, snapshot_id: int | None, now: Column | None = None) -> DataFrame:
    """Rows of the prediction table from scored rows."""
    more = prediction_columns(F.col("prediction"), F.col("rul_label"), sigma)
    stamp = {"model_version": F.lit(version), "predict_ts": now if now is not None else F.current_timestamp(), "silver_snapshot_id": F.lit(snapshot_id).cast("bigint")}
    return scored.withColumns(more | stamp).select(*TABLES["gold.rul_prediction"].schema.names)


def metrics(scored: DataFrame, version: str, split_name: str, snapshot_id: int | None = None, row_count: int | None = None, window: tuple[str | None, str | None] = (None, None), accuracy: int = 100_000) -> DataFrame:
    """Rows of the metrics table, one per dataset, against the capped label; missing window dates are today."""
    if split_name not in SPLITS:
        raise ValueError(f"unknown split {split_name!r}")
    d = F.col("prediction") - F.col("rul_capped")
    found = scored.where(F.col("prediction").isNotNull()).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.sum(expr.phm08(d)).alias("phm08_score"),
        F.avg("prediction").alias("pred_mean"),
        F.stddev_samp("prediction").alias("pred_std"),
        F.percentile_approx("prediction", 0.5, accuracy).alias("pred_p50"),
    )
    dates = {f"eval_window_{k}": F.coalesce(F.lit(v).cast("date"), F.current_date()) for k, v in zip(("start", "end"), window, strict=True)}
    stamp = {"model_version": F.lit(version), "eval_split": F.lit(split_name), "silver_snapshot_id": F.lit(snapshot_id).cast("bigint"), "silver_row_count": F.lit(row_count).cast("bigint"), "computed_ts": F.current_timestamp()}
    return found.withColumns(dates | stamp).select(*TABLES["gold.model_metrics"].schema.names)


def latest_per_engine(rows: DataFrame, *order: str) -> DataFrame:
    """The row with the greatest cycle of each engine."""
    w = Window.partitionBy(*ENGINE).orderBy(F.col("cycle").desc(), *order)
    return rows.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def standard_test(health: DataFrame, truth: DataFrame, model: PipelineModel, version: str, cap: int = CAP) -> DataFrame | None:
    """Metrics over the last cycle of each test engine against the ground truth; None where an input is empty."""
    test = health.where("is_test")
    if test.isEmpty() or truth.isEmpty():
        return None
    last = latest_per_engine(test).drop("rul_label").join(truth.select(*ENGINE, F.col("true_rul").alias("rul_label")), ENGINE)
    return metrics(model.transform(prepared(last, cap)), version, "nasa_test")


def save(model: PipelineModel, base: str, version: str) -> str:
    path = f"{base.rstrip('/')}/{version}/{int(time.time())}"
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
