"""Generators of raw and health rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake.schemas import KEPT, NORMS, SENSORS, SETTINGS, TABLES

# Six operating conditions.
CENTERS = [(0.0, 0.0, 100.0), (10.0, 0.25, 100.0), (20.0, 0.5, 100.0), (25.0, 0.62, 60.0), (35.0, 0.84, 60.0), (42.0, 0.84, 40.0)]


def raw_rows(spark, units, cycles, base="2025-08-01 00:00:00", dataset="FD001", source="train", offset=0, flat=False):
    """Raw rows of units and cycles (both as ranges); settings move through six conditions unless flat."""
    rows = spark.range(units.start, units.stop).select(F.col("id").cast("int").alias("unit_id")).crossJoin(spark.range(cycles.start, cycles.stop).select(F.col("id").cast("int").alias("cycle")))
    cond = F.lit(0) if flat else F.pmod(F.col("unit_id") + F.col("cycle"), F.lit(6))
    rows = rows.withColumn("cond", cond)
    noise = [F.lit(0.0) if flat else (F.col("cycle") % 3 - 1) * x for x in (0.01, 0.005, 0.0)]
    for k, name in enumerate(SETTINGS):
        rows = rows.withColumn(name, F.element_at(F.array(*[F.lit(c[k]) for c in CENTERS]), F.col("cond") + 1) + noise[k])
    rows = rows.withColumns({s: 500.0 + 10 * (k + 1) + 0.1 * F.col("cycle") + 5.0 * F.col("cond") for k, s in enumerate(SENSORS)})
    ts = F.lit(base).cast("timestamp") + F.make_interval(hours=F.col("unit_id") + F.col("cycle"))
    rows = rows.withColumns({"dataset_id": F.lit(dataset), "event_ts": ts, "ingest_ts": ts, "source_file": F.lit(f"{source}_{dataset}.txt"), "line_no": (10000 * F.col("unit_id") + F.col("cycle") + offset).cast("long")})
    return rows.select(*TABLES["bronze.engine_sensor_raw"].schema.names)


def health_rows(spark, units, cycles, test=False, offset=0, dataset="FD001"):
    """Health rows whose index falls from 1 as the last cycle comes near."""
    rows = spark.range(units).select((F.col("id") + 1 + offset).cast("int").alias("unit_id")).crossJoin(spark.range(1, cycles + 1).select(F.col("id").cast("int").alias("cycle")))
    h = 1.0 - (cycles - F.col("cycle")) / F.lit(float(cycles))
    now = F.current_timestamp()
    fill = {s: F.lit(0.0) for s in SETTINGS} | {n: 0.5 * h + 0.01 * (k % 3) for n, k in zip(NORMS, KEPT)}
    fill |= {"s_avg_w5": h, "s_std_w5": F.lit(0.1), "s_trend_w5": F.lit(-0.05), "health_index": h, "dataset_id": F.lit(dataset), "op_condition_cluster": F.lit(0), "rul_label": F.lit(None).cast("int") if test else (cycles - F.col("cycle")).cast("int"), "is_test": F.lit(test), "event_ts": now, "ingest_ts": now, "silver_ts": now, "silver_version": F.lit("v")}
    return rows.withColumns(fill).select(*TABLES["silver.engine_health"].schema.names)
