"""Registered queries: the engine's operators over the driver's tables, each with DuckDB SQL that states its result.

Line items stand for readings (dataset: return flag, unit: supplier, settings: quantity, discount, tax, sensors: price
and tax times quantity), events for a stream of messages. Doubles are rounded to six places, counts are bigint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.operators import features, health, kpi, quality, rul
from fleetlake.schemas import Table, ddl
from fleetlake.session import prepared
from fleetlake.sources import readings
from fleetlake.sources.table import SnapshotTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
UNIT = ["dataset_id", "unit_id", "is_test"]
SENSORS = ["sensor_1", "sensor_2"]
Z = ["z1", "z2"]
CENTERS = [(5.0, 0.02, 0.02), (15.0, 0.08, 0.06), (25.0, 0.05, 0.04), (35.0, 0.02, 0.07), (42.0, 0.09, 0.01), (48.0, 0.04, 0.08)]
VERSION = "a"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepared(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes, gone when the driver ends: in the shared folder of a cluster, on one machine else
    a temporary one."""
    shared, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    shared = shared or (held.get() if held.isDefined() else None)
    if shared:
        folder = f"{shared.rstrip('/')}/fleetlake-{name}-{uuid.uuid4().hex[:12]}"
    elif spark.sparkContext.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix=f"fleetlake-{name}-")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    atexit.register(_removed, spark, folder)
    return folder


def _removed(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for results that a query needs more than once."""
    folder = _scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


# --- readings ----------------------------------------------------------------------------------------------------


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_linestatus") == "F", "train_items").otherwise("test_items")
    ts = F.col("l_shipdate").cast("timestamp")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset_id"), F.col("l_suppkey").cast("int").alias("unit_id"), side.alias("source_file"),
        F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_no"),
        F.col("l_quantity").alias("op_setting_1"), F.col("l_discount").alias("op_setting_2"), F.col("l_tax").alias("op_setting_3"),
        F.col("l_extendedprice").alias("sensor_1"), (F.col("l_quantity") * F.col("l_tax")).alias("sensor_2"), ts.alias("event_ts"), ts.alias("ingest_ts"),
    )


TIES = ["event_ts", "part_no", "unit_id", "sensor_1", "op_setting_1", "op_setting_2", "op_setting_3", "dataset_id", "source_file"]

RAW = """raw AS (
  SELECT l_returnflag AS dataset_id, l_suppkey::INT AS unit_id, CASE WHEN l_linestatus = 'F' THEN 'train_items' ELSE 'test_items' END AS source_file,
         l_orderkey AS order_no, l_linenumber AS line_no, l_partkey AS part_no, l_quantity AS op_setting_1, l_discount AS op_setting_2,
         l_tax AS op_setting_3, l_extendedprice AS sensor_1, l_quantity * l_tax AS sensor_2, l_shipdate AS event_ts
  FROM lineitem)"""
DEDUP = RAW + f""", dedup AS (
  SELECT *, source_file LIKE 'test\\_%' ESCAPE '\\' AS is_test FROM raw
  QUALIFY row_number() OVER (PARTITION BY order_no, line_no ORDER BY {", ".join(TIES)}) = 1)"""
READ = DEDUP + """, readings AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, unit_id, is_test ORDER BY event_ts, order_no, line_no)::INT AS cycle FROM dedup)"""
_DISTANCE = [f"power(op_setting_1 - {a}, 2) + power(op_setting_2 - {b}, 2) + power(op_setting_3 - {c}, 2)" for a, b, c in CENTERS]
COND = READ + f""", cond AS (
  SELECT *, (list_position(ds, list_min(ds)) - 1)::INT AS op_condition_cluster FROM (SELECT *, [{", ".join(_DISTANCE)}] AS ds FROM readings))"""
STATS = COND + """, stats AS (
  SELECT dataset_id, op_condition_cluster, count(*)::BIGINT AS n_samples, avg(sensor_1) AS m1, stddev_pop(sensor_1) AS d1, avg(sensor_2) AS m2, stddev_pop(sensor_2) AS d2
  FROM cond GROUP BY ALL)"""
SCALED = STATS + """, scaled AS (
  SELECT c.*, CASE WHEN d1 > 0 THEN (sensor_1 - m1) / d1 ELSE 0.0 END AS z1, CASE WHEN d2 > 0 THEN (sensor_2 - m2) / d2 ELSE 0.0 END AS z2
  FROM cond c LEFT JOIN stats s USING (dataset_id, op_condition_cluster))"""
SILVER = SCALED + """, silver AS (
  SELECT *, avg(x) OVER w AS s_avg_w5, stddev_samp(x) OVER w AS s_std_w5, (x - first_value(x) OVER w) / 4.0 AS s_trend_w5,
         1 - least(abs(avg(x) OVER w), 3.0) / 3.0 AS health_index,
         CASE WHEN NOT is_test THEN max(cycle) OVER (PARTITION BY dataset_id, unit_id, is_test) - cycle END::INT AS rul_label
  FROM (SELECT *, (z1 + z2) / 2.0 AS x FROM scaled)
  WINDOW w AS (PARTITION BY dataset_id, unit_id, is_test ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
_PHM = "CASE WHEN rul_pred - rul_label >= 0 THEN exp((rul_pred - rul_label) / 13.0) - 1 ELSE exp(-(rul_pred - rul_label) / 10.0) - 1 END"
_TIER = "CASE WHEN rul_pred <= 10 THEN 'CRITICAL' WHEN rul_pred <= 30 THEN 'HIGH' WHEN rul_pred <= 80 THEN 'MED' ELSE 'LOW' END"
PRED = SILVER + f""", predicted AS (
  SELECT dataset_id, unit_id, is_test, cycle, event_ts AS predict_ts, model_version, rul_pred, greatest(rul_pred - 1.6449 * 12.5, 0.0) AS rul_pred_lower,
         rul_pred + 1.6449 * 12.5 AS rul_pred_upper, rul_label AS rul_actual, abs(rul_pred - rul_label) AS abs_error, {_PHM} AS phm08_score, {_TIER} AS risk_tier
  FROM (SELECT *, 'a' AS model_version, op_setting_1 AS rul_pred FROM silver
        UNION ALL SELECT *, 'b' AS model_version, op_setting_1 * 0.75 + op_setting_2 * 100 AS rul_pred FROM silver))"""


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.Deduplicate(["order_no", "line_no"], TIES).transform(raw(spark, sf_dir))
    return rows.withColumn("is_test", features.test_flag(rows))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, sf_dir).withColumn("cycle", F.row_number().over(Window.partitionBy(*UNIT).orderBy("event_ts", "order_no", "line_no")))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ConditionModel(CENTERS).transform(cycles(spark, sf_dir))


def scaler() -> features.GroupScaler:
    return features.GroupScaler(SENSORS, ["dataset_id", "op_condition_cluster"], Z)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conditions(spark, sf_dir)
    rows = features.RollingFeatures(Z).transform(scaler().fit(rows).transform(rows))
    return rows.withColumns({"health_index": expr.health_index(F.col("s_avg_w5")), "rul_label": expr.rul_label(UNIT)})


def predicted(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = (silver(spark, sf_dir) if rows is None else rows).withColumn("v", F.explode(F.array(F.lit("a"), F.lit("b"))))
    guess = F.when(F.col("v") == "a", F.col("op_setting_1")).otherwise(F.col("op_setting_1") * 0.75 + F.col("op_setting_2") * 100)
    rows = rows.withColumns({"prediction": guess, "model_version": F.col("v"), "predict_ts": F.col("event_ts")})
    return rows.withColumns(rul.prediction_columns(F.col("prediction"), F.col("rul_label"), 12.5))


@query("dedup_first_write", f"WITH {DEDUP} SELECT dataset_id, unit_id, order_no, line_no, sensor_1, is_test FROM dedup")
def _(spark, sf_dir):
    return dedup(spark, sf_dir).select("dataset_id", "unit_id", "order_no", "line_no", "sensor_1", "is_test")


@query("assign_condition", f"WITH {COND} SELECT order_no, line_no, cycle, op_condition_cluster FROM cond")
def _(spark, sf_dir):
    return conditions(spark, sf_dir).select("order_no", "line_no", "cycle", "op_condition_cluster")


@query("feature_stats", f"WITH {STATS} SELECT dataset_id, op_condition_cluster, n_samples, round(m1, 6) AS sensor_1_mean, round(d1, 6) AS sensor_1_std, round(m2, 6) AS sensor_2_mean, round(d2, 6) AS sensor_2_std FROM stats")
def _(spark, sf_dir):
    return _rounded(scaler().fit(conditions(spark, sf_dir)).stats, *[f"{s}_{m}" for s in SENSORS for m in ("mean", "std")])


_ZS = f"WITH {SCALED} SELECT order_no, line_no, round(z1, 6) AS z1, round(z2, 6) AS z2 FROM scaled"


@query("zscore_from_stats", _ZS)
def _(spark, sf_dir):
    rows = conditions(spark, sf_dir)
    stats = _stored(scaler().fit(rows).stats, "stats")  # a later run scales by what an earlier one has stored
    return _rounded(features.GroupScalerModel(scaler(), stats).transform(rows).select("order_no", "line_no", *Z), *Z)


@query("zscore_inline", _ZS)
def _(spark, sf_dir):
    rows = conditions(spark, sf_dir)  # few groups hold all rows: their statistics are joined, no window gathers them
    return _rounded(scaler().fit(rows).transform(rows).select("order_no", "line_no", *Z), *Z)


_SILVER = ["dataset_id", "unit_id", "is_test", "cycle", "op_condition_cluster", "rul_label"]
_ROUND = [*Z, "s_avg_w5", "s_std_w5", "s_trend_w5", "health_index"]


@query("silver_full", f"WITH {SILVER} SELECT {', '.join(_SILVER)}, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUND)} FROM silver")
def _(spark, sf_dir):
    return _rounded(silver(spark, sf_dir).select(*_SILVER, *_ROUND), *_ROUND)


@query("health_index", f"WITH {SILVER} SELECT dataset_id, unit_id, is_test, cycle, round(health_index, 6) AS health_index FROM silver")
def _(spark, sf_dir):
    return _rounded(silver(spark, sf_dir).select(*UNIT, "cycle", "health_index"), "health_index")


@query("rul_label", f"WITH {READ} SELECT dataset_id, unit_id, is_test, cycle, CASE WHEN NOT is_test THEN max(cycle) OVER (PARTITION BY dataset_id, unit_id, is_test) - cycle END::INT AS rul_label FROM readings")
def _(spark, sf_dir):
    return cycles(spark, sf_dir).withColumn("rul_label", expr.rul_label(UNIT)).select(*UNIT, "cycle", "rul_label")


@query("unit_split", f"WITH {READ} SELECT dataset_id, unit_id, count(*)::BIGINT AS n, ('0x' || substr(md5(dataset_id || ':' || unit_id), 1, 8))::BIGINT % 100 < 80 AS train FROM readings GROUP BY dataset_id, unit_id")
def _(spark, sf_dir):
    key = F.concat_ws(":", "dataset_id", F.col("unit_id").cast("string"))
    return cycles(spark, sf_dir).groupBy("dataset_id", "unit_id").agg(F.count(F.lit(1)).alias("n")).withColumn("train", expr.portable_split(key))


# --- predictions, indicators -------------------------------------------------------------------------------------

_PRED = ["rul_pred", "rul_pred_lower", "rul_pred_upper", "abs_error", "phm08_score"]


@query("prediction_target", f"WITH {PRED} SELECT model_version, dataset_id, unit_id, is_test, cycle, rul_actual, risk_tier, {', '.join(f'round({c}, 6) AS {c}' for c in _PRED)} FROM predicted")
def _(spark, sf_dir):
    return _rounded(predicted(spark, sf_dir).select("model_version", *UNIT, "cycle", "rul_actual", "risk_tier", *_PRED), *_PRED)


@query("risk_tiers", f"WITH {PRED} SELECT model_version, risk_tier, count(*)::BIGINT AS n FROM predicted GROUP BY ALL")
def _(spark, sf_dir):
    return predicted(spark, sf_dir).groupBy("model_version", "risk_tier").agg(F.count(F.lit(1)).alias("n"))


_D = "(op_setting_1 - least(rul_label, 130))"


@query("model_metrics", f"""WITH {SILVER} SELECT dataset_id, 'holdout' AS eval_split, count(*)::BIGINT AS sample_count, round(avg(abs({_D})), 6) AS mae, round(sqrt(avg({_D} * {_D})), 6) AS rmse,
  round(sum(CASE WHEN {_D} >= 0 THEN exp({_D} / 13.0) - 1 ELSE exp(-{_D} / 10.0) - 1 END), 2) AS phm08_score, round(avg(op_setting_1), 6) AS pred_mean, round(stddev_samp(op_setting_1), 6) AS pred_std,
  quantile_disc(op_setting_1, 0.5) AS pred_p50 FROM silver WHERE NOT is_test GROUP BY dataset_id""")
def _(spark, sf_dir):
    rows = silver(spark, sf_dir).where("NOT is_test").withColumns({"prediction": F.col("op_setting_1"), "rul_capped": F.least(F.col("rul_label").cast("double"), F.lit(130.0))})
    found = rul.metrics(rows, "v", "holdout").withColumn("phm08_score", F.round("phm08_score", 2))
    return _rounded(found.select("dataset_id", "eval_split", "sample_count", "mae", "rmse", "phm08_score", "pred_mean", "pred_std", "pred_p50"), "mae", "rmse", "pred_mean", "pred_std")


@query("last_reading_eval", f"""WITH {SILVER} SELECT dataset_id, unit_id, cycle, round(s_acctbal, 2) AS truth, round(op_setting_1 - s_acctbal, 6) AS difference
  FROM (SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY dataset_id, unit_id ORDER BY cycle DESC, is_test) = 1) JOIN supplier ON unit_id = s_suppkey""")
def _(spark, sf_dir):
    truth = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("unit_id"), F.col("s_acctbal").alias("truth"))
    rows = rul.latest_per_engine(silver(spark, sf_dir), "is_test").join(truth, "unit_id")
    return rows.select("dataset_id", "unit_id", "cycle", F.round("truth", 2).alias("truth"), F.round(F.col("op_setting_1") - F.col("truth"), 6).alias("difference"))


_TRUE = "CAST(floor(abs(s_acctbal)) AS BIGINT) % 200"
_TESTED = f"""WITH {SILVER}, tested AS (SELECT s.dataset_id, op_setting_1 AS p, op_setting_1 - least({_TRUE}, 130) AS d FROM (
    SELECT * FROM silver WHERE is_test QUALIFY row_number() OVER (PARTITION BY dataset_id, unit_id ORDER BY cycle DESC) = 1) s JOIN supplier ON unit_id = s_suppkey)"""
_SCORED = "sum(CASE WHEN d >= 0 THEN exp(d / 13.0) - 1 ELSE exp(-d / 10.0) - 1 END)"


class _FirstSetting:
    """A model whose prediction SQL can state."""

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", F.col("op_setting_1"))


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = silver(spark, sf_dir)
    lives = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("unit_id"), (F.floor(F.abs("s_acctbal")).cast("long") % 200).cast("int").alias("true_rul"))
    truth = rows.select("dataset_id", "unit_id").distinct().join(lives, "unit_id")
    return rul.standard_test(rows, truth, _FirstSetting(), "v")


@query("standard_test", f"{_TESTED} SELECT dataset_id, 'nasa_test' AS eval_split, count(*)::BIGINT AS sample_count, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round({_SCORED}, 2) AS phm08_score, round(avg(p), 6) AS pred_mean FROM tested GROUP BY dataset_id")
def _(spark, sf_dir):
    found = tested(spark, sf_dir).withColumn("phm08_score", F.round("phm08_score", 2))
    return _rounded(found.select("dataset_id", "eval_split", "sample_count", "mae", "rmse", "phm08_score", "pred_mean"), "mae", "rmse", "pred_mean")


@query("test_metrics", f"{_TESTED} SELECT 'v' AS model_version, dataset_id, count(*)::BIGINT AS sample_count, round(avg(abs(d)), 2) AS mae, round(sqrt(avg(d * d)), 2) AS rmse, round({_SCORED}, 2) AS phm08 FROM tested GROUP BY dataset_id")
def _(spark, sf_dir):
    return health.test_metrics(tested(spark, sf_dir))


_KPI = PRED + """, steps AS (
  SELECT s.*, event_ts::DATE AS kpi_date, health_index - lag(health_index) OVER (PARTITION BY dataset_id, unit_id, is_test ORDER BY cycle) AS step FROM silver s
), met AS (SELECT s.*, p.risk_tier FROM steps s LEFT JOIN predicted p ON p.model_version = 'a' AND s.dataset_id = p.dataset_id AND s.unit_id = p.unit_id AND s.cycle = p.cycle AND s.is_test = p.is_test
), daily AS (
  SELECT kpi_date, dataset_id, op_condition_cluster, count(DISTINCT unit_id)::INT AS active_engine_count, count(*) FILTER (risk_tier = 'CRITICAL')::INT AS critical_count,
         count(*) FILTER (risk_tier IN ('CRITICAL', 'HIGH'))::INT AS high_count, count(*) FILTER (risk_tier IN ('CRITICAL', 'HIGH', 'MED'))::INT AS medium_count, count(*) AS n,
         round(avg(health_index), 6) AS avg_health_index, round(quantile_disc(health_index, 0.1), 6) AS health_index_p10, round(quantile_disc(health_index, 0.5), 6) AS health_index_p50,
         round(quantile_disc(health_index, 0.9), 6) AS health_index_p90, round(avg(step), 6) AS avg_degradation_rate
  FROM met GROUP BY ALL
), ever AS (SELECT dataset_id, op_condition_cluster, count(DISTINCT unit_id)::INT AS engine_count FROM silver GROUP BY ALL)"""
_KPI_COLUMNS = ["kpi_date", "dataset_id", "op_condition_cluster", "engine_count", "active_engine_count", "critical_count", "high_count", "medium_count"]
_KPI_ROUND = ["avg_health_index", "health_index_p10", "health_index_p50", "health_index_p90", "avg_degradation_rate"]


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stored(silver(spark, sf_dir), "silver")
    return kpi.fleet_daily(rows, predicted(spark, sf_dir, rows), VERSION)


@query("fleet_kpi_daily", f"WITH {_KPI} SELECT {', '.join(_KPI_COLUMNS + _KPI_ROUND)}, round(critical_count::DOUBLE / n, 6) AS risk_ratio_critical FROM daily LEFT JOIN ever USING (dataset_id, op_condition_cluster)")
def _(spark, sf_dir):
    return _rounded(fleet(spark, sf_dir).select(*_KPI_COLUMNS, *_KPI_ROUND, "risk_ratio_critical"), *_KPI_ROUND, "risk_ratio_critical")


@query("degradation_by_cluster", f"WITH {_KPI} SELECT kpi_date, dataset_id, op_condition_cluster, {', '.join(_KPI_ROUND)}, critical_count, high_count, round(critical_count::DOUBLE / n, 6) AS risk_ratio_critical FROM daily")
def _(spark, sf_dir):
    return _rounded(health.degradation(fleet(spark, sf_dir)), *_KPI_ROUND, "risk_ratio_critical")


@query("hi_percentiles", f"WITH {SILVER} SELECT dataset_id, {', '.join(f'round(quantile_disc(health_index, {p / 100}), 6) AS p{p}' for p in (10, 50, 90))} FROM silver GROUP BY dataset_id")
def _(spark, sf_dir):
    found = silver(spark, sf_dir).groupBy("dataset_id").agg(*[F.percentile_approx("health_index", p / 100, 100_000).alias(f"p{p}") for p in (10, 50, 90)])
    return _rounded(found, "p10", "p50", "p90")


@query("error_drift", f"WITH {PRED} SELECT predict_ts::DATE AS predict_date, model_version, dataset_id, count(*)::BIGINT AS n, round(avg(abs_error), 2) AS mae, round(sqrt(avg(abs_error * abs_error)), 2) AS rmse, round(sum(phm08_score), 2) AS phm08_total FROM predicted WHERE rul_actual IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    return health.error_drift(predicted(spark, sf_dir))


@query("rolling_mae_7d", f"""WITH {PRED}, d AS (SELECT predict_ts::DATE AS predict_date, model_version, dataset_id, avg(abs_error) AS mae FROM predicted WHERE abs_error IS NOT NULL GROUP BY ALL)
  SELECT predict_date, model_version, dataset_id, round(mae, 6) AS mae, round(avg(mae) OVER (PARTITION BY model_version, dataset_id ORDER BY predict_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 6) AS mae_rolling FROM d""")
def _(spark, sf_dir):
    return _rounded(health.rolling_error(predicted(spark, sf_dir)), "mae", "mae_rolling")


@query("version_agreement", f"""WITH {PRED} SELECT a.model_version AS v_a, b.model_version AS v_b, count(*)::BIGINT AS n, round(avg(abs(a.rul_pred - b.rul_pred)), 2) AS mean_abs_diff,
  round(max(abs(a.rul_pred - b.rul_pred)), 2) AS max_abs_diff, round(corr(a.rul_pred, b.rul_pred), 4) AS correlation
  FROM predicted a JOIN predicted b USING (dataset_id, unit_id, cycle, is_test) WHERE a.model_version < b.model_version GROUP BY ALL""")
def _(spark, sf_dir):
    return health.version_agreement(predicted(spark, sf_dir, _stored(silver(spark, sf_dir), "silver")))


_LATEST = f"WITH {PRED}, latest AS (SELECT * FROM predicted WHERE model_version = 'a' QUALIFY row_number() OVER (PARTITION BY dataset_id, unit_id, is_test ORDER BY cycle DESC) = 1)"


@query("top_risk", f"{_LATEST} SELECT dataset_id, unit_id, cycle, rul_pred, risk_tier FROM latest ORDER BY rul_pred, dataset_id, unit_id, is_test LIMIT 10")
def _(spark, sf_dir):
    return health.top_risk(predicted(spark, sf_dir), VERSION).drop("predict_ts")


@query("maintenance_queue", f"{_LATEST} SELECT dataset_id, unit_id, cycle, rul_pred, risk_tier, CASE risk_tier WHEN 'CRITICAL' THEN '즉시 점검' ELSE '7일 내 점검' END AS action FROM latest WHERE risk_tier IN ('CRITICAL', 'HIGH')")
def _(spark, sf_dir):
    return health.maintenance_queue(predicted(spark, sf_dir), VERSION).select("dataset_id", "unit_id", "cycle", "rul_pred", "risk_tier", "action")


@query("rul_distribution", f"WITH {PRED} SELECT predict_ts::DATE AS predict_date, dataset_id, model_version, round(rul_pred, 6) AS rul_pred, risk_tier FROM predicted WHERE rul_pred IS NOT NULL")
def _(spark, sf_dir):
    return _rounded(health.rul_distribution(predicted(spark, sf_dir)).drop("predict_ts"), "rul_pred")


# --- quality -----------------------------------------------------------------------------------------------------

_STATUS = "CASE WHEN measured_value <= threshold THEN 'PASS' WHEN measured_value <= threshold * 1.5 + 1e-9 THEN 'WARN' ELSE 'FAIL' END AS status"


def _judged(rows: str, names: dict[str, tuple[str, float]]) -> str:
    """SQL of the long form over a relation ``m`` with dataset_id, sample_size and a column per rule."""
    parts = [f"SELECT '{rule}' AS rule_name, dataset_id, sample_size, {c}::DOUBLE AS measured_value, {t}::DOUBLE AS threshold FROM m" for c, (rule, t) in names.items()]
    return f"{rows}, long AS ({' UNION ALL '.join(parts)}) SELECT rule_name, dataset_id, sample_size, round(measured_value, 6) AS measured_value, threshold, {_STATUS} FROM long"


def _results(df: DataFrame) -> DataFrame:
    return _rounded(df.select("rule_name", "dataset_id", "sample_size", "measured_value", "threshold", "status"), "measured_value")


_SETS = "GROUP BY GROUPING SETS ((dataset_id), ())"
_ID = "CASE WHEN grouping(dataset_id) = 1 THEN '__ALL__' ELSE dataset_id END AS dataset_id"


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows in which some keys and sensors are broken on purpose."""
    gone = F.col("order_no") % 97 == 0
    bad = F.when(F.col("order_no") % 89 == 0, F.lit(float("nan"))).when(F.col("order_no") % 83 == 0, F.lit(float("inf"))).when(F.col("order_no") % 79 == 0, None).otherwise(F.col("sensor_1"))
    return raw(spark, sf_dir).withColumns({"cycle": F.when(gone, None).otherwise(F.col("line_no")), "sensor_1": bad})


_FAULTY = RAW + """, faulty AS (SELECT * REPLACE (CASE WHEN order_no % 89 = 0 THEN 'nan'::DOUBLE WHEN order_no % 83 = 0 THEN 'inf'::DOUBLE WHEN order_no % 79 = 0 THEN NULL ELSE sensor_1 END AS sensor_1),
  CASE WHEN order_no % 97 <> 0 THEN line_no END AS cycle FROM raw)"""


@query("dq_raw_rows", _judged(f"WITH {_FAULTY}, m AS (SELECT {_ID}, count(*)::BIGINT AS sample_size, count(*) FILTER (unit_id IS NULL OR cycle IS NULL) AS keys, count(*) FILTER (sensor_1 IS NULL OR isnan(sensor_1) OR isinf(sensor_1) OR sensor_2 IS NULL) AS finite FROM faulty {_SETS})", {"keys": ("bronze_null_key_columns", 0), "finite": ("bronze_finite_sensors", 0)}))
def _(spark, sf_dir):
    return _results(quality.raw_row_rules(faulty(spark, sf_dir)))


@query("dq_dup_ratio", _judged(f"WITH {RAW}, l AS (SELECT dataset_id, order_no, line_no, count(*) AS n FROM raw GROUP BY ALL), m AS (SELECT {_ID}, sum(n)::BIGINT AS sample_size, sum(n - 1)::DOUBLE / sum(n) AS share FROM l {_SETS})", {"share": ("bronze_dup_ratio", 0.01)}))
def _(spark, sf_dir):
    return _results(quality.duplicate_rule(raw(spark, sf_dir).withColumn("source_file", F.col("order_no").cast("string"))))


@query("dq_cycle_gap", _judged(f"WITH {RAW}, u AS (SELECT dataset_id, order_no AS unit_id, count(DISTINCT line_no) AS n, min(line_no) AS low, max(line_no) AS high FROM raw GROUP BY ALL), m AS (SELECT {_ID}, count(*)::BIGINT AS sample_size, count(*) FILTER (n <> high - low + 1) AS gaps, count(*) FILTER (low <> 1) AS late FROM u {_SETS})", {"gaps": ("bronze_cycle_monotonic", 0), "late": ("bronze_cycle_starts_at_one", 0)}))
def _(spark, sf_dir):
    rows = raw(spark, sf_dir).select("dataset_id", F.col("order_no").alias("unit_id"), F.col("line_no").alias("cycle"))
    return _results(quality.cycle_rules(rows, strict=True))


def _full_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health rows with all feature columns; the norms repeat the two there are."""
    rows = silver(spark, sf_dir)
    return rows.withColumns({n: F.col(Z[k % 2]) for k, n in enumerate(quality.NORMS)} | {"silver_ts": F.col("event_ts")})


@query("dq_health_rows", _judged(f"""WITH {SILVER}, m AS (SELECT {_ID}, count(*)::BIGINT AS sample_size, count(*) FILTER ((rul_label IS NULL OR rul_label < 0) AND NOT is_test) AS labels,
  count(*) FILTER (rul_label IS NULL OR rul_label < 0) AS strict, count(*) FILTER (op_condition_cluster NOT BETWEEN 0 AND 5) AS clusters, count(*) FILTER (s_std_w5 IS NULL)::DOUBLE / count(*) AS missing FROM silver {_SETS})""",
  {"labels": ("silver_rul_label_nonneg", 0), "strict": ("silver_rul_label_nonneg_strict", 0), "clusters": ("silver_cluster_in_range", 0), "missing": ("silver_nan_feature_ratio", 0.05)}))
def _(spark, sf_dir):
    return _results(quality.health_row_rules(_full_health(spark, sf_dir), F.lit("2030-01-01").cast("timestamp"), strict=True).where("rule_name <> 'silver_freshness_minutes'"))


@query("dq_freshness", f"WITH {RAW} SELECT 'silver_freshness_minutes' AS rule_name, '__ALL__' AS dataset_id, count(DISTINCT (order_no, line_no))::BIGINT AS sample_size, round((epoch(TIMESTAMP '2030-01-01') - epoch(max(event_ts))) / 60.0, 6) AS measured_value, 120.0::DOUBLE AS threshold, 'FAIL' AS status FROM raw WHERE true")
def _(spark, sf_dir):
    rows = _full_health(spark, sf_dir)
    last = raw(spark, sf_dir).agg(F.max("event_ts").alias("silver_ts"))
    rows = rows.drop("silver_ts").crossJoin(F.broadcast(last))  # one row
    return _results(quality.health_row_rules(rows, F.lit("2030-01-01").cast("timestamp")).where("rule_name = 'silver_freshness_minutes'"))


@query("dq_count_match", _judged(f"""WITH {RAW}, a AS (SELECT dataset_id, count(*) AS a FROM (SELECT DISTINCT dataset_id, order_no, line_no FROM raw) GROUP BY ALL), b AS (SELECT dataset_id, count(*) AS b FROM raw WHERE dataset_id <> 'R' GROUP BY ALL),
  f AS (SELECT dataset_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (dataset_id)), m AS (SELECT {_ID}, sum(b)::BIGINT AS sample_size, sum(abs(a - b)) AS difference FROM f {_SETS})""", {"difference": ("silver_count_matches_bronze", 0)}))
def _(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("source_file", F.col("order_no").cast("string"))
    return _results(quality.count_rule(rows, rows.where("dataset_id <> 'R'")))


@query("dq_status", "SELECT v::DOUBLE AS measured, t::DOUBLE AS threshold, CASE WHEN v <= t THEN 'PASS' WHEN v <= t * 1.5 + 1e-9 THEN 'WARN' ELSE 'FAIL' END AS at_most, CASE WHEN v < t THEN 'PASS' WHEN v <= t * 1.5 + 1e-9 THEN 'WARN' ELSE 'FAIL' END AS below, CASE WHEN abs(v - t) <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS same FROM (SELECT DISTINCT l_quantity AS v, 20 AS t FROM lineitem)")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("measured"), F.lit(20.0).alias("threshold")).distinct()
    return rows.withColumns({n: expr.rule_status(F.col("measured"), F.col("threshold"), o) for n, o in (("at_most", "<="), ("below", "<"), ("same", "=="))})


@query("dq_status_counts", _judged(f"WITH {RAW}, l AS (SELECT dataset_id, order_no, line_no, count(*) AS n FROM raw GROUP BY ALL), m AS (SELECT {_ID}, sum(n)::BIGINT AS sample_size, sum(n - 1)::DOUBLE / sum(n) AS share FROM l {_SETS})", {"share": ("bronze_dup_ratio", 0.01)}).replace("SELECT rule_name, dataset_id", "SELECT status, count(*)::BIGINT AS n FROM (SELECT rule_name, dataset_id") + ") GROUP BY status")
def _(spark, sf_dir):
    rows = quality.duplicate_rule(raw(spark, sf_dir).withColumn("source_file", F.col("order_no").cast("string")))
    return quality.status_counts(rows.withColumn("run_date", F.lit("2024-01-01").cast("date")), F.lit("2024-01-01").cast("date"))


# --- events: reports on arrival, drift, sequences ----------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset_id"), F.col("user_id").cast("int").alias("unit_id"), ts.alias("event_ts"), ts.alias("ingest_ts"), F.col("event_id").alias("line_no"), "value", "props",
        F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")).alias("cycle"), F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("op_condition_cluster"),
    )


_EVENTS = """ev AS (SELECT event_type AS dataset_id, user_id::INT AS unit_id, ts AS event_ts, event_id AS line_no, value, props,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id)::INT AS cycle, (user_id % 4)::INT AS op_condition_cluster FROM events)"""


def _anchor(spark: SparkSession, sf_dir: str) -> Column:
    return F.lit(_table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0])


@query("sensor_dropout", f"WITH {_EVENTS} SELECT dataset_id, unit_id, max(cycle) AS last_cycle, max(event_ts)::DATE AS last_day, date_sub('minute', max(event_ts), (SELECT max(ts) FROM events))::BIGINT AS gap_minutes FROM ev GROUP BY ALL HAVING date_sub('minute', max(event_ts), (SELECT max(ts) FROM events)) > 30")
def _(spark, sf_dir):
    return health.sensor_dropout(events(spark, sf_dir), _anchor(spark, sf_dir)).withColumn("last_day", F.to_date("last_ingest_ts")).drop("last_ingest_ts")


@query("freshness", f"WITH {_EVENTS} SELECT dataset_id, date_sub('minute', max(event_ts), (SELECT max(ts) FROM events))::BIGINT AS gap_minutes FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return health.freshness(events(spark, sf_dir), _anchor(spark, sf_dir)).drop("last_ingest_ts")


@query("daily_volume", f"WITH {_EVENTS} SELECT event_ts::DATE AS event_date, dataset_id, op_condition_cluster, count(*)::BIGINT AS rows, count(DISTINCT unit_id)::BIGINT AS units FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return health.daily_volume(events(spark, sf_dir))


@query("daily_rows", f"WITH {_EVENTS} SELECT event_ts::DATE AS d, dataset_id, count(*)::BIGINT AS rows FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return health.daily_rows(events(spark, sf_dir))


@query("condition_drift", f"""WITH {_EVENTS}, a AS (SELECT max(event_ts)::DATE AS today FROM ev), daily AS (
  SELECT event_ts::DATE AS d, dataset_id, op_condition_cluster, count(*) AS n FROM ev, a WHERE event_ts >= (today - INTERVAL 8 DAYS)::TIMESTAMP GROUP BY ALL),
  r AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY d, dataset_id) AS pct FROM daily)
  SELECT t.dataset_id, t.op_condition_cluster, round(t.pct, 4) AS today_pct, round(w.pct, 4) AS week_ago_pct, round(t.pct - w.pct, 4) AS delta
  FROM r t CROSS JOIN a LEFT JOIN r w ON w.dataset_id = t.dataset_id AND w.op_condition_cluster = t.op_condition_cluster AND w.d = a.today - INTERVAL 7 DAYS WHERE t.d = a.today""")
def _(spark, sf_dir):
    return health.condition_drift(events(spark, sf_dir))


@query("ingest_check", f"WITH {_EVENTS} SELECT dataset_id, count(*)::BIGINT AS rows, count(DISTINCT unit_id)::BIGINT AS units, max(cycle) AS max_cycle, min(event_ts)::DATE AS first_event, max(event_ts)::DATE AS last_event, count(DISTINCT event_ts::DATE)::BIGINT AS days_span FROM ev GROUP BY ALL")
def _(spark, sf_dir):
    return health.ingest_check(events(spark, sf_dir)).withColumns({c: F.to_date(c) for c in ("first_event", "last_event")})


@query("rolling_features", f"WITH {_EVENTS} SELECT dataset_id, unit_id, cycle, round(avg(value) OVER w, 6) AS s_avg_w5, round(stddev_samp(value) OVER w, 6) AS s_std_w5, round((value - first_value(value) OVER w) / 4.0, 6) AS s_trend_w5 FROM ev WINDOW w AS (PARTITION BY dataset_id, unit_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, sf_dir):
    rows = features.RollingFeatures(["value"], unit=["dataset_id", "unit_id"]).transform(events(spark, sf_dir))
    return _rounded(rows.select("dataset_id", "unit_id", "cycle", "s_avg_w5", "s_std_w5", "s_trend_w5"), "s_avg_w5", "s_std_w5", "s_trend_w5")


@query("sequence_window", f"""WITH {_EVENTS}, s AS (SELECT *, list(value) OVER w AS l, first_value(value) OVER w AS f FROM ev WINDOW w AS (PARTITION BY dataset_id, unit_id ORDER BY cycle ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  SELECT dataset_id, unit_id, cycle, 30::INT AS length, round(list_sum(l) + (30 - len(l)) * f, 4) AS total, round(f, 6) AS oldest,
         round(list_sum(list_transform(l, lambda x, i: (30 - len(l) + i) * x)) + f * (30 - len(l)) * (31 - len(l)) / 2, 3) AS weighed FROM s""")
def _(spark, sf_dir):
    rows = features.sequences(events(spark, sf_dir), ["value"], 30, ["dataset_id", "unit_id"])
    flat = F.transform("sequence", lambda x: F.element_at(x, 1))
    total = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform(flat, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)  # tells the order
    return rows.select("dataset_id", "unit_id", "cycle", F.size("sequence").alias("length"), F.round(total, 4).alias("total"), F.round(F.element_at(flat, 1), 6).alias("oldest"), F.round(weighed, 3).alias("weighed"))


@query("affected_units", f"WITH {_EVENTS}, a AS (SELECT max(event_ts) - INTERVAL 2 DAYS AS since FROM ev) SELECT dataset_id, unit_id, cycle, line_no FROM ev e WHERE EXISTS (SELECT 1 FROM ev n, a WHERE n.event_ts > a.since AND n.dataset_id = e.dataset_id AND n.unit_id = e.unit_id)")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    new = rows.where(F.col("event_ts") > _anchor(spark, sf_dir) - F.expr("INTERVAL 2 DAYS"))
    return rows.join(new.select("dataset_id", "unit_id").distinct(), ["dataset_id", "unit_id"], "left_semi").select("dataset_id", "unit_id", "cycle", "line_no")


@query("json_parse", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def _(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("m")).select("event_id", "m.k")


@query("layer_counts", "SELECT 'bronze' AS layer, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'silver', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'truth', count(*) FROM supplier")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    return health.layer_counts({"bronze": rows, "silver": rows.select("l_orderkey", "l_linenumber").distinct(), "events": _table(spark, sf_dir, "events"), "truth": _table(spark, sf_dir, "supplier")})


@query("truth_summary", "SELECT n_name AS dataset_id, count(*)::BIGINT AS n_units, min(floor(s_acctbal))::INT AS min_rul, max(floor(s_acctbal))::INT AS max_rul, round(avg(floor(s_acctbal)), 6) AS avg_rul FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return _rounded(health.truth_summary(rows.select(F.col("n_name").alias("dataset_id"), F.floor("s_acctbal").cast("int").alias("true_rul"))), "avg_rul")


@query("event_time_synth", "SELECT l_suppkey AS unit_id, l_linenumber AS cycle, strftime(TIMESTAMP '2025-08-01' + to_seconds(3600 * l_suppkey + 1800 * (l_linenumber - 1)), '%Y-%m-%dT%H:%M:%S.000Z') AS event_ts FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem)")
def _(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.col("l_linenumber").alias("cycle")).distinct()
    ts = expr.event_time(F.lit("2025-08-01 00:00:00").cast("timestamp"), F.col("unit_id"), F.col("cycle"), expr.seconds_of("30m"), expr.seconds_of("1h"))
    return rows.withColumn("event_ts", expr.event_text(ts))


@query("replay_order", "SELECT event_type AS dataset_id, event_id AS line_no, row_number() OVER (PARTITION BY event_type ORDER BY event_id)::INT AS tick FROM events")
def _(spark, sf_dir):
    return readings.replay_order(events(spark, sf_dir).withColumn("source_file", F.lit("train_events"))).select("dataset_id", "line_no", "tick")


@query("message_format", "SELECT event_type || ':' || user_id AS key, event_id AS line_no, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS second FROM events")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("source_file", F.lit("train_events"))
    rows = rows.withColumns({f"op_setting_{k}": F.lit(0.0) for k in (1, 2, 3)} | {f"sensor_{k}": F.col("value") for k in range(1, 22)})
    found = readings.messages(rows)
    return found.select("key", F.get_json_object("value", "$.line_no").cast("bigint").alias("line_no"), F.substring(F.get_json_object("value", "$.event_ts"), 1, 19).alias("second"))


# --- text sources ------------------------------------------------------------------------------------------------


@query("parse_lines", f"WITH {READ} SELECT dataset_id, unit_id, cycle, round(sensor_1, 4) AS sensor_1, round(sensor_2, 4) AS sensor_21 FROM readings")
def _(spark, sf_dir):
    rows = _stored(cycles(spark, sf_dir), "cycles")
    number = lambda c: F.format_string("%.6f", F.col(c))
    tokens = [F.col("unit_id").cast("string"), F.col("cycle").cast("string"), *[number(f"op_setting_{k}") for k in (1, 2, 3)], number("sensor_1"), *[F.lit("0.0")] * 19, number("sensor_2"), F.lit("extra")]
    folder = _scratch(spark, "lines")
    parts = []
    for (dataset,) in rows.select("dataset_id").distinct().orderBy("dataset_id").collect():  # a file for each of the few datasets
        rows.where(F.col("dataset_id") == dataset).select(F.concat(F.lit(" "), F.concat_ws("  ", *tokens))).write.mode("overwrite").text(f"{folder}/train_{dataset}.txt")
        parts.append(readings.sensor_records(spark, folder, dataset))
    return reduce(DataFrame.unionByName, parts).select("dataset_id", "unit_id", "cycle", F.round("sensor_1", 4).alias("sensor_1"), F.round("sensor_21", 4).alias("sensor_21"))


@query("ground_truth_file", "SELECT row_number() OVER (ORDER BY s_suppkey)::INT AS unit_id, trunc(abs(s_acctbal))::INT AS true_rul FROM supplier")
def _(spark, sf_dir):
    folder = _scratch(spark, "truth")
    rows = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.format_string("%.2f", F.abs("s_acctbal")))
    rows.coalesce(1).write.mode("overwrite").text(f"{folder}/RUL_S.txt")
    return readings.ground_truth(spark, f"{folder}/RUL_S.txt", "S").drop("dataset_id")


# --- versioned tables --------------------------------------------------------------------------------------------

ITEMS = Table("items", ddl("order_no bigint", "line_no int", "flag string", "price double"), ["order_no", "line_no"], {"p_flag": "flag"})
_ITEM = "SELECT l_orderkey AS order_no, l_linenumber AS line_no, max(l_returnflag) AS flag, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL"
_OLD, _NEW, _LATE = "order_no % 3 <> 0", "order_no % 5 = 0", "order_no % 3 = 0"


def _items(spark: SparkSession, sf_dir: str) -> tuple[SnapshotTable, list[int]]:
    """A table after an append (two orders of three), a tag, an upsert of each fifth order at ten times its price,
    and an append of the third that was left out unless upserted."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no")).agg(F.max("l_returnflag").alias("flag"), F.max("l_extendedprice").alias("price"))
    table = SnapshotTable.create(spark, _scratch(spark, "items"), ITEMS, replace=True)
    ids = [table.append(rows.where(_OLD)).snapshot_id]
    table.tag("first")
    ids.append(table.upsert(rows.where(_NEW).withColumn("price", F.col("price") * 10)).snapshot_id)
    ids.append(table.append(rows.where(f"{_LATE} AND NOT ({_NEW})")).snapshot_id)
    return table, ids


def _sql(where: str, price: str = "price") -> str:
    return f"SELECT order_no, line_no, flag, round({price}, 2) AS price FROM ({_ITEM}) WHERE {where}"


_STATE = _sql("true", f"CASE WHEN {_NEW} THEN price * 10 ELSE price END")


@query("upsert_result", _STATE)
def _(spark, sf_dir):
    return _items(spark, sf_dir)[0].read().withColumn("price", F.round("price", 2))


@query("compaction_result", _STATE)
def _(spark, sf_dir):
    table, _ = _items(spark, sf_dir)
    table.compact()
    return table.read().withColumn("price", F.round("price", 2))


@query("changes_range", _sql(f"{_LATE} AND NOT ({_NEW})"))
def _(spark, sf_dir):
    table, ids = _items(spark, sf_dir)
    return table.changes(ids[1], ids[2]).withColumn("price", F.round("price", 2))


@query("time_travel", _sql(_OLD))
def _(spark, sf_dir):
    table, ids = _items(spark, sf_dir)
    return table.read(version_as_of=ids[0]).withColumn("price", F.round("price", 2))


@query("tag_read", _sql(_OLD))
def _(spark, sf_dir):
    return _items(spark, sf_dir)[0].read(tag="first").withColumn("price", F.round("price", 2))


@query("rollback_result", _sql(_OLD))
def _(spark, sf_dir):
    table, ids = _items(spark, sf_dir)
    table.rollback_to(ids[0])
    return table.read().withColumn("price", F.round("price", 2))


@query("partition_pruned", _sql(f"flag = 'A' AND ({_LATE} OR {_OLD})", f"CASE WHEN {_NEW} THEN price * 10 ELSE price END"))
def _(spark, sf_dir):
    return _items(spark, sf_dir)[0].read(where="flag = 'A'").withColumn("price", F.round("price", 2))


@query("table_files")
def _(spark, sf_dir):
    return health.file_stats({"items": _items(spark, sf_dir)[0]})


@query("small_ratio")
def _(spark, sf_dir):
    return health.small_ratio({"items": _items(spark, sf_dir)[0]})


def _two(spark: SparkSession, sf_dir: str) -> dict[str, SnapshotTable]:
    """The table above, and one with two appends and a compaction."""
    other = SnapshotTable.create(spark, _scratch(spark, "other"), ITEMS, replace=True)
    for k in range(2):
        other.append(spark.createDataFrame([(k, 1, "A", 1.0)], ITEMS.schema))
    other.compact()
    return {"items": _items(spark, sf_dir)[0], "other": other}


@query("changed_rows", _sql(_NEW, "price * 10"))
def _(spark, sf_dir):
    table, ids = _items(spark, sf_dir)  # what the upsert was given, without the rows that moved along
    return table.changes(ids[0], ids[1]).withColumn("price", F.round("price", 2))


_TOTALS = Table("totals", ddl("order_no bigint", "n bigint", "total double"), ["order_no"])


def _incremental(spark: SparkSession, sf_dir: str) -> tuple[SnapshotTable, list[int]]:
    """Totals per order by three incremental runs: over the first three lines of all orders, over the rest, which
    recomputes the orders that it touches, and over nothing. The table, and the rows that each run wrote."""
    from fleetlake.plans.incremental import STATE, IncrementalJob
    from fleetlake.schemas import TABLES

    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no")).agg(F.max("l_returnflag").alias("flag"), F.max("l_extendedprice").alias("price"))
    folder = _scratch(spark, "incremental")
    source, sink, state = (SnapshotTable.create(spark, f"{folder}/{t.name}", t) for t in (ITEMS, _TOTALS, TABLES[STATE]))
    job = IncrementalJob("totals", source, sink, state, ["order_no"], lambda x: x.groupBy("order_no").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")))
    written = []
    for part in ("line_no <= 3", "line_no > 3", None):
        if part:
            source.append(rows.where(part))
        written.append(job.run())
    return sink, written


@query("incremental_result", f"SELECT order_no, count(*)::BIGINT AS n, round(sum(price), 2) AS total FROM ({_ITEM}) GROUP BY order_no")
def _(spark, sf_dir):
    return _incremental(spark, sf_dir)[0].read().withColumn("total", F.round("total", 2))


@query("incremental_runs", f"SELECT 1::INT AS run, count(DISTINCT order_no)::BIGINT AS written FROM ({_ITEM}) WHERE line_no <= 3 UNION ALL SELECT 2, count(DISTINCT order_no) FROM ({_ITEM}) WHERE line_no > 3 UNION ALL SELECT 3, 0")
def _(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_incremental(spark, sf_dir)[1], 1)), "run int, written bigint")


@query("snapshot_growth", "SELECT * FROM (VALUES ('items', 3::BIGINT, 0::BIGINT), ('other', 3, 0)) t(table_name, snapshot_count, span_days)")
def _(spark, sf_dir):
    return health.snapshot_growth(_two(spark, sf_dir)).drop("oldest_snapshot", "latest_snapshot")


@query("snapshot_timeline", "SELECT * FROM (VALUES ('items', 'append', 1::BIGINT), ('items', 'append', 3), ('items', 'overwrite', 2), ('other', 'append', 1), ('other', 'append', 2), ('other', 'replace', 3)) t(tbl, operation, place)")
def _(spark, sf_dir):
    found = health.snapshot_timeline(_two(spark, sf_dir))
    return found.select("tbl", "operation", F.row_number().over(Window.partitionBy("tbl").orderBy("committed_at")).cast("bigint").alias("place"))


@query("merge_operations", f"""WITH i AS ({_ITEM}), c AS (SELECT count(*) AS n, count(*) FILTER ({_OLD}) AS old, count(*) FILTER ({_LATE} AND NOT ({_NEW})) AS late, count(*) FILTER ({_OLD} OR {_NEW}) AS then_ FROM i)
  SELECT 'overwrite' AS operation, then_::BIGINT AS total_rows FROM c UNION ALL SELECT 'append', old FROM c UNION ALL SELECT 'append', n FROM c""")
def _(spark, sf_dir):
    return health.merge_operations(_items(spark, sf_dir)[0]).select("operation", "total_rows")


# --- stream, models ----------------------------------------------------------------------------------------------

_STREAM = "SELECT event_type AS dataset_id, user_id::INT AS unit_id, event_id AS line_no, round(value, 6) AS sensor_1 FROM events"


@query("stream_ingest", _STREAM)
def _(spark, sf_dir):
    from fleetlake.schemas import TABLES
    from fleetlake.streaming.ingest import RAW as TARGET
    from fleetlake.streaming.ingest import ingest

    rows = events(spark, sf_dir).withColumn("source_file", F.lit("train_events"))
    rows = rows.withColumns({f"op_setting_{k}": F.lit(0.0) for k in (1, 2, 3)} | {f"sensor_{k}": F.col("value") for k in range(1, 22)})
    folder = _scratch(spark, "stream")
    readings.publish(rows, "file", f"{folder}/messages")
    table = SnapshotTable.create(spark, f"{folder}/raw", TABLES[TARGET])
    stream = readings.message_stream(spark, "file", f"{folder}/messages")
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, table, f"{folder}/checkpoint", trigger=None).awaitTermination()
    return table.read().select("dataset_id", "unit_id", "line_no", F.round("sensor_1", 6).alias("sensor_1"))


@query("kmeans_conditions")
def _(spark, sf_dir):
    rows = dedup(spark, sf_dir)
    model = features.ConditionClusterer(k=6, seed=42).fit(rows)
    return model.transform(rows).groupBy("op_condition_cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("op_setting_1"), 6).alias("center"))


@query("gbt_train_predict")
def _(spark, sf_dir):
    rows = rul.prepared(_full_health(spark, sf_dir).where("NOT is_test"))
    fitting, held = rul.split(rows)
    model = rul.fit(fitting)
    scored = model.transform(held)
    return _rounded(rul.metrics(scored, "gbt", "holdout").select("dataset_id", "sample_count", "mae", "rmse"), "mae", "rmse")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: raw readings to the daily indicators of the fleet."""
    return QUERIES["fleet_kpi_daily"](spark, sf_dir)


