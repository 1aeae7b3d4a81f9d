"""Columns, partition columns and keys of the tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names, and the sensors that carry a signal.
SETTINGS = [f"op_setting_{k}" for k in range(1, 4)]
SENSORS = [f"sensor_{k}" for k in range(1, 22)]
KEPT = [2, 3, 4, 7, 8, 9, 11, 12, 13, 14, 15, 17, 20, 21]
KEPT_SENSORS = [f"sensor_{k}" for k in KEPT]
NORMS = [f"s{k}_norm" for k in KEPT]
ROLLING = ["s_avg_w5", "s_std_w5", "s_trend_w5"]
ENGINE = ["dataset_id", "unit_id"]
KEYS = [*ENGINE, "cycle"]


KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType()}


def ddl(*columns: str) -> T.StructType:
    """A schema from "name type" pairs."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (c.split() for c in columns)])


MESSAGE = ddl("dataset_id string", "unit_id int", "cycle int", *(f"{c} double" for c in SETTINGS + SENSORS), "event_ts timestamp", "source_file string", "line_no bigint")


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    keys: list[str] = field(default_factory=list)
    partitions: dict[str, str] = field(default_factory=dict)  # column of the layout: SQL that derives it
    retain: int = 20


TABLES = {
    t.name: t
    for t in [
        Table("bronze.engine_sensor_raw", ddl("dataset_id string", "unit_id int", "cycle int", *(f"{c} double" for c in SETTINGS + SENSORS), "event_ts timestamp", "ingest_ts timestamp", "source_file string", "line_no bigint"), [], {"p_dataset": "dataset_id", "p_day": "to_date(ingest_ts)"}),
        Table("silver.engine_health", ddl("dataset_id string", "unit_id int", "cycle int", *(f"{c} double" for c in SETTINGS), "op_condition_cluster int", *(f"{c} double" for c in NORMS + ROLLING), "health_index double", "rul_label int", "is_test boolean", "event_ts timestamp", "ingest_ts timestamp", "silver_ts timestamp", "silver_version string"), [*KEYS, "is_test"], {"p_dataset": "dataset_id", "p_day": "to_date(event_ts)"}),
        Table("silver.feat_stats", ddl("stats_version string", "fit_snapshot_id bigint", "cluster_id int", *(f"center_{c} double" for c in SETTINGS), "dataset_id string", "n_samples bigint", *(f"{c}_{m} double" for c in KEPT_SENSORS for m in ("mean", "std")), "fit_ts timestamp"), ["stats_version", "dataset_id", "cluster_id"], {"p_version": "stats_version"}),
        Table("silver.pipeline_state", ddl("pipeline_name string", "last_snapshot_id bigint", "last_run_ts timestamp", "rows_processed bigint", "active_stats_version string"), ["pipeline_name"], retain=10),
        Table("silver.rul_ground_truth", ddl("dataset_id string", "unit_id int", "true_rul int", "loaded_ts timestamp"), ENGINE, {"p_dataset": "dataset_id"}),
        Table("gold.rul_prediction", ddl("model_version string", "dataset_id string", "unit_id int", "cycle int", "is_test boolean", "rul_pred double", "rul_pred_lower double", "rul_pred_upper double", "rul_actual int", "abs_error double", "phm08_score double", "risk_tier string", "predict_ts timestamp", "silver_snapshot_id bigint"), ["model_version", *KEYS, "is_test"], {"p_version": "model_version", "p_dataset": "dataset_id", "p_day": "to_date(predict_ts)"}),
        Table("gold.fleet_kpi_daily", ddl("kpi_date date", "dataset_id string", "op_condition_cluster int", "engine_count int", "active_engine_count int", "critical_count int", "high_count int", "medium_count int", "risk_ratio_critical double", "avg_health_index double", "health_index_p10 double", "health_index_p50 double", "health_index_p90 double", "avg_degradation_rate double", "kpi_ts timestamp", "source_model_version string"), ["kpi_date", "dataset_id", "op_condition_cluster"], {"p_month": "date_format(kpi_date, 'yyyy-MM')", "p_dataset": "dataset_id"}),
        Table("gold.model_metrics", ddl("model_version string", "dataset_id string", "eval_window_start date", "eval_window_end date", "eval_split string", "sample_count bigint", "mae double", "rmse double", "phm08_score double", "pred_mean double", "pred_std double", "pred_p50 double", "silver_snapshot_id bigint", "silver_row_count bigint", "computed_ts timestamp"), ["model_version", "dataset_id", "eval_window_end", "eval_split"], {"p_version": "model_version"}),
        Table("gold.dq_results", ddl("rule_name string", "layer string", "dataset_id string", "measured_value double", "threshold double", "operator string", "status string", "sample_size bigint", "description string", "run_ts timestamp", "run_date date"), ["rule_name", "layer", "dataset_id", "run_date"], {"p_date": "run_date"}),
        Table("gold.pipeline_state", ddl("pipeline_name string", "last_snapshot_id bigint", "last_run_ts timestamp", "rows_processed bigint", "active_model_version string", "active_model_path string", "active_model_trained_ts timestamp", "residual_sigma double"), ["pipeline_name"], retain=10),
    ]
}
