"""Command line: python -m fleetlake.plans.cli VERB --root WAREHOUSE [options]"""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame

from fleetlake.operators import health
from fleetlake.plans import incremental, maintenance
from fleetlake.plans.jobs import JOBS
from fleetlake.session import session
from fleetlake.sources import readings
from fleetlake.streaming.ingest import ingest, keep_running

VERBS = ["create", "publish", "ensure-stream", "load-truth", "fit-stats", "silver-full", "silver-incremental", "train", "train-sequences", "predict", "full", "kpi", "quality", "health", *maintenance.ORDER, "maintain", "jobs"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fleetlake", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("--root")
    p.add_argument("--folder", help="folder of sensor and ground-truth files")
    p.add_argument("--datasets", default="FD001")
    p.add_argument("--source", default="train")
    p.add_argument("--max-units", type=int, default=0)
    p.add_argument("--base", default="2025-08-01 00:00:00")
    p.add_argument("--cycle-interval", default="1h")
    p.add_argument("--unit-jitter", default="1h")
    p.add_argument("--include-test", action="store_true")
    p.add_argument("--pace", type=float, default=0.0, help="seconds between the cycles that are published, before --speedup; 0: all at once")
    p.add_argument("--speedup", type=float, default=600.0)
    p.add_argument("--stream", default="file", choices=["file", "kafka"])
    p.add_argument("--stream-at", help="folder of messages, or the broker")
    p.add_argument("--checkpoint")
    p.add_argument("--model-version", default="gbt-v0")
    p.add_argument("--stats-version")
    p.add_argument("--rul-cap", type=int, default=130)
    p.add_argument("--ts-col", default="event_ts")
    p.add_argument("--replace", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--fail-on-fail", action="store_true")
    return p


def reports(lake: incremental.Lake, version: str) -> dict[str, DataFrame]:
    """All health, business and operations reports."""
    raw, silver, predicted, kpi = (lake.table(t).read() for t in (incremental.RAW, incremental.HEALTH, incremental.PREDICTED, incremental.KPI))
    tables = {t: lake.table(t) for t in (incremental.RAW, incremental.HEALTH, incremental.PREDICTED)}
    return {
        "sensor_dropout": health.sensor_dropout(raw),
        "daily_volume": health.daily_volume(silver),
        "file_stats": health.file_stats(tables),
        "snapshot_growth": health.snapshot_growth(tables),
        "error_drift": health.error_drift(predicted),
        "merge_operations": health.merge_operations(lake.table(incremental.HEALTH), 50),
        "condition_drift": health.condition_drift(silver),
        "version_agreement": health.version_agreement(predicted),
        "rul_distribution": health.rul_distribution(predicted),
        "top_risk": health.top_risk(predicted, version),
        "degradation": health.degradation(kpi),
        "maintenance_queue": health.maintenance_queue(predicted, version),
        "freshness": health.freshness(raw),
        "daily_rows": health.daily_rows(raw),
        "small_ratio": health.small_ratio(tables),
        "snapshot_timeline": health.snapshot_timeline(tables),
        "rolling_error": health.rolling_error(predicted),
        "ingest_check": health.ingest_check(raw),
        "test_metrics": health.test_metrics(lake.table(incremental.METRICS).read()),
        "truth_summary": health.truth_summary(lake.table(incremental.TRUTH).read()),
    }


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "jobs":
        for job in JOBS:
            print(f"{job.cron:16} {job.name:20} {' '.join(job.verbs)}")
        return 0
    if not a.root:
        raise SystemExit("--root is needed")
    spark = session()
    lake = incremental.Lake(spark, a.root)
    datasets = [d.strip() for d in a.datasets.split(",") if d.strip()]
    if a.verb == "create":
        lake.catalog.create_all(a.replace)
    elif a.verb == "publish":
        from fleetlake.functions.expr import seconds_of

        sources = [a.source, "test"] if a.include_test and a.source != "test" else [a.source]
        rows = reduce(DataFrame.unionByName, [readings.sensor_records(spark, a.folder, d, s, a.max_units) for d in datasets for s in sources])
        rows = readings.with_event_time(rows, a.base, seconds_of(a.cycle_interval), seconds_of(a.unit_jitter))
        print(readings.replay(rows, a.stream, a.stream_at, pace=a.pace, speedup=a.speedup, report=print, dry_run=a.dry_run))
    elif a.verb == "ensure-stream":
        stream = readings.message_stream(spark, a.stream, a.stream_at)
        keep_running(lambda: ingest(stream, lake.table(incremental.RAW), a.checkpoint or f"{a.root}/_checkpoints/raw"))
    elif a.verb == "load-truth":
        for d in datasets:
            lake.load_truth(readings.ground_truth(spark, f"{a.folder}/RUL_{d}.txt", d))
    elif a.verb == "fit-stats":
        lake.fit_stats(a.stats_version)
    elif a.verb == "silver-full":
        print(lake.silver_full(a.stats_version))
    elif a.verb == "silver-incremental":
        print(lake.silver_incremental(a.stats_version))
    elif a.verb == "train":
        print(lake.train(a.model_version, a.rul_cap))
    elif a.verb == "train-sequences":
        print(lake.train_sequences(a.model_version, a.rul_cap))
    elif a.verb == "predict":
        print(lake.predict())
    elif a.verb == "full":
        print(lake.full(a.model_version, cap=a.rul_cap))
    elif a.verb == "kpi":
        lake.kpi(a.model_version, a.ts_col)
    elif a.verb == "quality":
        return lake.quality(a.fail_on_fail)
    elif a.verb == "health":
        for name, report in reports(lake, a.model_version).items():
            print(name)
            report.show(50, truncate=False)
    else:
        print(maintenance.run(lake.catalog, None if a.verb == "maintain" else a.verb, a.dry_run))
    return 0


if __name__ == "__main__":
    sys.exit(main())
