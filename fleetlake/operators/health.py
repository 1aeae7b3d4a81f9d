"""Health, business and operations reports, as frames over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.sources.table import SnapshotTable

SMALL_BYTES = 128 << 20
MB = 1024.0 * 1024.0


def _now(now: Column | None) -> Column:
    return F.current_timestamp() if now is None else now


def sensor_dropout(raw: DataFrame, now: Column | None = None, minutes: int = 30) -> DataFrame:
    """Engines from which nothing has come for more than ``minutes``."""
    found = raw.groupBy("dataset_id", "unit_id").agg(F.max("cycle").alias("last_cycle"), F.max("ingest_ts").alias("last_ingest_ts"))
    found = found.withColumn("gap_minutes", expr.minutes_between(F.col("last_ingest_ts"), _now(now)))
    return found.where(F.col("gap_minutes") > minutes).orderBy(F.col("gap_minutes").desc(), "dataset_id", "unit_id")


def freshness(raw: DataFrame, now: Column | None = None) -> DataFrame:
    found = raw.groupBy("dataset_id").agg(F.max("ingest_ts").alias("last_ingest_ts"))
    return found.withColumn("gap_minutes", expr.minutes_between(F.col("last_ingest_ts"), _now(now)))


def daily_volume(health: DataFrame) -> DataFrame:
    found = health.groupBy(F.to_date("event_ts").alias("event_date"), "dataset_id", "op_condition_cluster").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("unit_id").alias("units"))
    return found.orderBy(F.col("event_date").desc(), "dataset_id", "op_condition_cluster")


def daily_rows(raw: DataFrame) -> DataFrame:
    return raw.groupBy(F.to_date("ingest_ts").alias("d"), "dataset_id").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("d").desc(), "dataset_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def file_stats(tables: dict[str, SnapshotTable]) -> DataFrame:
    """Small files, their share and sizes of each table."""
    size = F.col("file_size_in_bytes")
    parts = []
    for name, table in tables.items():
        small = F.count_if(size < SMALL_BYTES)
        parts.append(table.files().agg(small.alias("small_files"), F.count(F.lit(1)).alias("total_files"), F.round(100.0 * expr.ratio(small, F.count(F.lit(1))), 2).alias("small_pct"), F.round(F.avg(size) / MB, 2).alias("avg_mb"), F.round(F.sum(size) / MB, 2).alias("total_mb")).withColumn("table_name", F.lit(name)))
    return _union(parts).select("table_name", "small_files", "total_files", "small_pct", "avg_mb", "total_mb")


def small_ratio(tables: dict[str, SnapshotTable]) -> DataFrame:
    found = file_stats(tables)
    return found.select(F.col("table_name").alias("tbl"), F.col("total_files").alias("files"), F.round("avg_mb", 1).alias("avg_mb"), F.round(expr.ratio(F.col("small_files"), F.col("total_files")), 4).alias("small_ratio"))


def snapshot_growth(tables: dict[str, SnapshotTable]) -> DataFrame:
    at = F.col("committed_at")
    parts = [t.snapshots().agg(F.count(F.lit(1)).alias("snapshot_count"), F.min(at).alias("oldest_snapshot"), F.max(at).alias("latest_snapshot")).withColumn("table_name", F.lit(n)) for n, t in tables.items()]
    found = _union(parts).withColumn("span_days", F.timestamp_diff("DAY", F.col("oldest_snapshot"), F.col("latest_snapshot")))
    return found.select("table_name", "snapshot_count", "oldest_snapshot", "latest_snapshot", "span_days")


def snapshot_timeline(tables: dict[str, SnapshotTable]) -> DataFrame:
    return _union([t.snapshots().select(F.lit(n).alias("tbl"), "committed_at", "snapshot_id", "operation") for n, t in tables.items()]).orderBy("committed_at")


def merge_operations(table: SnapshotTable, last: int = 200) -> DataFrame:
    """The last commits with what they added and removed; what a commit doesn't tell is null."""
    told = {"added_rows": "added-records", "deleted_rows": "deleted-records", "total_rows": "total-records", "added_files": "added-data-files", "removed_files": "removed-data-files"}
    values = [F.element_at("summary", F.lit(k)).cast("bigint").alias(c) for c, k in told.items()]
    return table.snapshots().select("snapshot_id", "committed_at", "operation", *values).orderBy(F.col("committed_at").desc()).limit(last)


def error_drift(predicted: DataFrame) -> DataFrame:
    """Errors per day of prediction, model and dataset, where the truth is known."""
    rows = predicted.where(F.col("rul_actual").isNotNull())
    found = rows.groupBy(F.to_date("predict_ts").alias("predict_date"), "model_version", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("abs_error"), 2).alias("mae"), F.round(F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))), 2).alias("rmse"), F.round(F.sum("phm08_score"), 2).alias("phm08_total"))
    return found.orderBy(F.col("predict_date").desc(), "model_version", "dataset_id")


def rolling_error(predicted: DataFrame, days: int = 7) -> DataFrame:
    """Mean absolute error per day, and its mean over the last ``days`` days."""
    daily = predicted.where(F.col("abs_error").isNotNull()).groupBy(F.to_date("predict_ts").alias("predict_date"), "model_version", "dataset_id").agg(F.avg("abs_error").alias("mae"))
    w = Window.partitionBy("model_version", "dataset_id").orderBy(F.datediff("predict_date", F.lit("1970-01-01"))).rangeBetween(1 - days, 0)
    return daily.withColumn("mae_rolling", F.avg("mae").over(w))


def condition_drift(health: DataFrame) -> DataFrame:
    """Share of each condition on the latest day against seven days before."""
    day = F.to_date("event_ts")
    today = F.lit(health.agg(F.max(day)).first()[0]).cast("date")  # a literal, so that the filter reaches the scan
    rows = health.where(F.col("event_ts") >= F.date_sub(today, 8).cast("timestamp"))
    daily = rows.groupBy(day.alias("d"), "dataset_id", "op_condition_cluster").agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows").cast("double") / F.sum("rows").over(Window.partitionBy("d", "dataset_id"))
    ratios = daily.withColumn("pct", share)
    now, then = ratios.where(F.col("d") == today), ratios.where(F.col("d") == F.date_sub(today, 7)).select("dataset_id", "op_condition_cluster", F.col("pct").alias("old"))
    met = now.join(then, ["dataset_id", "op_condition_cluster"], "left")
    order = F.abs(F.coalesce("pct", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    return met.orderBy(order.desc(), "dataset_id", "op_condition_cluster").select("dataset_id", "op_condition_cluster", F.round("pct", 4).alias("today_pct"), F.round("old", 4).alias("week_ago_pct"), F.round(F.col("pct") - F.col("old"), 4).alias("delta"))


def version_agreement(predicted: DataFrame) -> DataFrame:
    """How far the predictions of each two model versions for the same cycles lie apart."""
    keys = [c for c in ("dataset_id", "unit_id", "cycle", "is_test") if c in predicted.columns]
    a = predicted.select(*keys, F.col("model_version").alias("v_a"), F.col("rul_pred").alias("pa"))
    b = predicted.select(*keys, F.col("model_version").alias("v_b"), F.col("rul_pred").alias("pb"))
    met = a.join(b, keys).where("v_a < v_b")
    gap = F.abs(F.col("pa") - F.col("pb"))
    return met.groupBy("v_a", "v_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gap), 2).alias("mean_abs_diff"), F.round(F.max(gap), 2).alias("max_abs_diff"), F.round(F.corr("pa", "pb"), 4).alias("correlation")).orderBy("v_a", "v_b")


def rul_distribution(predicted: DataFrame) -> DataFrame:
    return predicted.where(F.col("rul_pred").isNotNull()).select("predict_ts", F.to_date("predict_ts").alias("predict_date"), "dataset_id", "model_version", "rul_pred", "risk_tier")


def _latest(predicted: DataFrame, version: str) -> DataFrame:
    engine = [c for c in ("dataset_id", "unit_id", "is_test") if c in predicted.columns]
    w = Window.partitionBy(*engine).orderBy(F.col("cycle").desc())
    return predicted.where(F.col("model_version") == version).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top_risk(predicted: DataFrame, version: str, n: int = 10) -> DataFrame:
    """The engines, training and test ones, with the fewest cycles left."""
    order = [c for c in ("rul_pred", "dataset_id", "unit_id", "is_test") if c in predicted.columns]
    return _latest(predicted, version).orderBy(*order).limit(n).select("dataset_id", "unit_id", "cycle", "rul_pred", "risk_tier", "predict_ts")


def degradation(kpi: DataFrame) -> DataFrame:
    return kpi.select("kpi_date", "dataset_id", "op_condition_cluster", "avg_health_index", "health_index_p10", "health_index_p50", "health_index_p90", "avg_degradation_rate", "critical_count", "high_count", "risk_ratio_critical").orderBy("kpi_date", "dataset_id", "op_condition_cluster")


# What the queue says per tier (inspect at once, inspect within 7 days, watch).
ACTIONS = {"CRITICAL": "즉시 점검", "HIGH": "7일 내 점검"}
WATCH = "관찰"


def maintenance_queue(predicted: DataFrame, version: str, actions: dict[str, str] | None = None) -> DataFrame:
    actions = actions or ACTIONS
    action = F.coalesce(*[F.when(F.col("risk_tier") == t, a) for t, a in actions.items()], F.lit(WATCH))
    rows = _latest(predicted, version).where(F.col("risk_tier").isin("CRITICAL", "HIGH"))
    return rows.select("dataset_id", "unit_id", "cycle", "predict_ts", "rul_pred", "rul_pred_lower", "rul_pred_upper", "risk_tier", action.alias("action")).orderBy("rul_pred", "dataset_id", "unit_id")


def ingest_check(raw: DataFrame) -> DataFrame:
    return raw.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("unit_id").alias("units"), F.max("cycle").alias("max_cycle"), F.min("event_ts").alias("first_event"), F.max("event_ts").alias("last_event"), F.count_distinct(F.to_date("event_ts")).alias("days_span")).orderBy("dataset_id")


def layer_counts(layers: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "n") for name, df in layers.items()])


def test_metrics(metrics: DataFrame) -> DataFrame:
    rows = metrics.where("eval_split = 'nasa_test'")
    return rows.select("model_version", "dataset_id", "sample_count", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("phm08_score", 2).alias("phm08")).orderBy("model_version", "dataset_id")


def truth_summary(truth: DataFrame) -> DataFrame:
    return truth.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_units"), F.min("true_rul").alias("min_rul"), F.max("true_rul").alias("max_rul"), F.avg("true_rul").alias("avg_rul")).orderBy("dataset_id")
