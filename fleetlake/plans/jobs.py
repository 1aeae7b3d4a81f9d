"""The schedule: a row per job, for whatever scheduler runs it."""

from __future__ import annotations

from dataclasses import dataclass

# What all jobs have.
DEFAULTS = {"owner": "fleet", "retries": 2, "retry_delay_minutes": 5, "catchup": False, "depends_on_past": False}
BACKFILL_DAYS, TRAINING_MARGIN_DAYS, EXPIRE_DAYS, ORPHAN_DAYS = 90, 7, 100, 7
RETAIN = {"bronze.engine_sensor_raw": 20, "silver.engine_health": 20, "gold.rul_prediction": 20, "silver.pipeline_state": 10, "gold.pipeline_state": 10}


@dataclass(frozen=True)
class Job:
    name: str
    cron: str
    verbs: tuple[str, ...]
    tags: tuple[str, ...]


JOBS = [
    Job("ingest_streaming", "*/5 * * * *", ("ensure-stream",), ("ingest", "streaming")),
    Job("silver_merge", "0 * * * *", ("silver-incremental",), ("silver",)),
    Job("gold_rul_predict", "15 * * * *", ("predict",), ("gold", "rul")),
    Job("health_check", "30 * * * *", ("health",), ("health",)),
    Job("gold_kpi", "30 0 * * *", ("kpi",), ("gold", "kpi")),
    Job("dq_check", "0 1 * * *", ("quality",), ("quality",)),
    Job("compaction", "0 3 * * *", ("compact", "checkpoint-log"), ("maintenance",)),
    Job("expire", "0 4 * * *", ("expire",), ("maintenance",)),
    Job("orphan_cleanup", "0 5 * * 0", ("remove-orphans",), ("maintenance",)),
    Job("silver_fit_stats", "0 6 * * 1", ("fit-stats",), ("silver",)),
    Job("gold_train", "0 7 * * 1", ("train",), ("gold", "rul")),
]


def minute_of_day(cron: str) -> int:
    """Minute and hour of a cron line as minutes (a hour of * counts as 0)."""
    minute, hour = cron.split()[:2]
    return (0 if hour == "*" else int(hour)) * 60 + (0 if minute.startswith("*") else int(minute))
