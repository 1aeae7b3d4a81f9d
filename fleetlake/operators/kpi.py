"""Daily indicators of the fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.schemas import KEYS, TABLES

GROUP = ["kpi_date", "dataset_id", "op_condition_cluster"]
# The indicators' names for the tiers of expr.TIERS, and the percentiles.
COUNTS = ["critical_count", "high_count", "medium_count"]
PERCENTILES = [10, 50, 90]


def fleet_daily(health: DataFrame, predicted: DataFrame, version: str, ts_col: str = "event_ts", accuracy: int = 100_000) -> DataFrame:
    """Rows of the indicator table. Tier counts are cumulative (HIGH holds CRITICAL, MED both); the change of the
    health index is taken over an engine's whole history before days are formed; engine_count is of all time."""
    unit = [c for c in ("dataset_id", "unit_id", "is_test") if c in health.columns]
    keys = [c for c in (*KEYS, "is_test") if c in health.columns and c in predicted.columns]
    step = F.col("health_index") - F.lag("health_index").over(Window.partitionBy(*unit).orderBy("cycle"))
    rows = health.withColumns({"kpi_date": F.to_date(ts_col), "step": step})
    tiers = predicted.where(F.col("model_version") == version).select(*keys, "risk_tier")
    met = rows.join(tiers, keys, "left")
    rank = F.array_position(F.array(*[F.lit(name) for _, name in expr.TIERS]), F.col("risk_tier"))  # 0 for lower risks, null without a prediction
    measures = {name: F.count_if((rank >= 1) & (rank <= k)).cast("int") for k, name in enumerate(COUNTS, 1)}
    spread = F.percentile_approx("health_index", [p / 100 for p in PERCENTILES], accuracy)
    measures |= {"active_engine_count": F.count_distinct("unit_id").cast("int"), "active_cycles": F.count(F.lit(1)), "spread": spread}
    measures |= {f"avg_{name}": F.avg(c) for name, c in (("health_index", "health_index"), ("degradation_rate", "step"))}
    daily = met.groupBy(*GROUP).agg(*[m.alias(name) for name, m in measures.items()])
    daily = daily.withColumns({f"health_index_p{p}": F.element_at("spread", k) for k, p in enumerate(PERCENTILES, 1)})
    # a second, narrow pass: engines of all time can't be told from the days' counts
    ever = health.groupBy("dataset_id", "op_condition_cluster").agg(F.count_distinct("unit_id").cast("int").alias("engine_count"))
    out = daily.join(ever, ["dataset_id", "op_condition_cluster"], "left")
    stamp = {"risk_ratio_critical": expr.ratio(F.col("critical_count"), F.col("active_cycles")), "kpi_ts": F.current_timestamp(), "source_model_version": F.lit(version)}
    return out.withColumns(stamp).select(*TABLES["gold.fleet_kpi_daily"].schema.names)
