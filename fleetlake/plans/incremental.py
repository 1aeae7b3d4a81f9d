"""Jobs that move what has changed from one table to the next, and the verbs built on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.operators import features, kpi, quality, rul
from fleetlake.schemas import ENGINE, TABLES
from fleetlake.sources.table import Catalog, ExpiredSnapshot, SnapshotTable

RAW, HEALTH, STATS, STATE, TRUTH = "bronze.engine_sensor_raw", "silver.engine_health", "silver.feat_stats", "silver.pipeline_state", "silver.rul_ground_truth"
PREDICTED, KPI, METRICS, QUALITY, GOLD_STATE = "gold.rul_prediction", "gold.fleet_kpi_daily", "gold.model_metrics", "gold.dq_results", "gold.pipeline_state"


@dataclass
class IncrementalJob:
    """Reads what was added to ``source`` since the state's watermark, recomputes whole units that it touches, upserts
    into ``sink``, then moves the watermark. Doing a step twice changes nothing. Where the watermark has expired,
    the whole source is read."""

    name: str
    source: SnapshotTable
    sink: SnapshotTable
    state: SnapshotTable
    unit: list[str]
    transform: Callable[[DataFrame], DataFrame]

    def watermark(self) -> int | None:
        row = self.state.read().where(F.col("pipeline_name") == self.name).select("last_snapshot_id").first()
        return row[0] if row else None

    def affected(self, start: int | None, end: int) -> DataFrame:
        """All rows, as of ``end``, of units with a row added after ``start``."""
        now = self.source.read(version_as_of=end)
        if start is None:
            return now
        try:
            units = self.source.changes(start, end).select(*self.unit).distinct()
        except ExpiredSnapshot:
            return now
        return now.join(units, self.unit, "left_semi")

    def run(self, **state) -> int:
        """Rows written. 0 where the source has nothing new; the watermark moves all the same."""
        end, start = self.source.current_id(), self.watermark()
        rows = 0
        if end is not None and end != start:
            done = self.sink.upsert(self.transform(self.affected(start, end)))
            rows = written_rows(done)
        record_state(self.state, self.name, end, rows, **state)
        return rows


def written_rows(commit) -> int:
    """Rows that an upsert was given."""
    return int(commit.summary["source-records"]) if commit else 0


def record_state(table: SnapshotTable, name: str, snapshot_id: int | None, rows: int, **more) -> None:
    """Upserts the pipeline's row; columns that aren't given keep their values."""
    old = table.read().where(F.col("pipeline_name") == name).first()
    known = {"pipeline_name": name, "last_snapshot_id": snapshot_id, "rows_processed": rows, **more}
    columns = []
    for c in table.spec.schema:
        if c.name == "last_run_ts":
            value = F.current_timestamp()
        else:
            value = F.lit(known[c.name] if c.name in known else old[c.name] if old else None)
        columns.append(value.cast(c.dataType).alias(c.name))
    table.upsert(table.spark.range(1).select(*columns))


class Lake:
    """The warehouse's jobs, one method per verb."""

    def __init__(self, spark: SparkSession, root: str, models: str | None = None):
        self.spark, self.catalog = spark, Catalog(spark, root)
        self.models = models or f"{root.rstrip('/')}/_models"

    def table(self, name: str) -> SnapshotTable:
        return self.catalog.table(name)

    # --- health table --------------------------------------------------------------------------------------------

    def _health_rows(self, model: features.FeatureModel) -> Callable[[DataFrame], DataFrame]:
        return lambda raw: model.transform(raw).withColumn("silver_ts", F.current_timestamp()).select(*TABLES[HEALTH].schema.names)

    def fit_stats(self, version: str | None = None, k: int = 6, seed: int = 42) -> features.FeatureModel:
        raw = self.table(RAW)
        if raw.current_id() is None:
            raise SystemExit("the raw table is empty")
        version = version or f"fs-{int(time.time() * 1000)}"
        model = features.fit_features(raw.read(), version, k, seed, raw.current_id())
        model.save(self.table(STATS))
        return features.FeatureModel.load(self.table(STATS), version)

    def _silver_job(self, model: features.FeatureModel) -> IncrementalJob:
        return IncrementalJob("silver_transform", self.table(RAW), self.table(HEALTH), self.table(STATE), ENGINE, self._health_rows(model))

    def silver_full(self, version: str | None = None, k: int = 6) -> int:
        model = self.fit_stats(version, k)
        raw = self.table(RAW)
        done = self.table(HEALTH).upsert(self._health_rows(model)(raw.read()))
        rows = written_rows(done)
        record_state(self.table(STATE), "silver_transform", raw.current_id(), rows, active_stats_version=model.version)
        return rows

    def silver_incremental(self, version: str | None = None) -> int:
        model = features.FeatureModel.load(self.table(STATS), version)
        if model is None:
            raise SystemExit("no statistics yet: run fit-stats first")
        return self._silver_job(model).run(active_stats_version=model.version)

    # --- remaining life ------------------------------------------------------------------------------------------

    def train(self, version: str, cap: int = rul.CAP, max_iter: int = 50, max_depth: int = 5) -> str:
        health = self.table(HEALTH)
        rows = rul.prepared(health.read().where("NOT is_test AND rul_label IS NOT NULL"), cap)
        if rows.isEmpty():
            raise SystemExit("the health table has no training rows")
        fitting, held = rul.split(rows)
        model = rul.fit(fitting, max_iter, max_depth)
        path = rul.save(model, self.models, version)
        snapshot, count, scored = health.current_id(), rows.count(), model.transform(held)
        found = rul.metrics(model.transform(fitting), version, "train", snapshot, count).unionByName(rul.metrics(scored, version, "holdout", snapshot, count))
        test = rul.standard_test(health.read(), self.table(TRUTH).read(), model, version, cap)
        self.table(METRICS).upsert(found.unionByName(test) if test is not None else found)
        sigma = rul.residual_sigma(scored)
        old = self._gold_state()
        record_state(self.table(GOLD_STATE), "gold_rul_predict", old["last_snapshot_id"] if old else None, 0, active_model_version=version, active_model_path=path, active_model_trained_ts=_now(self.spark), residual_sigma=sigma)
        return path

    def train_sequences(self, version: str, cap: int = rul.CAP, window: int = 30, max_iter: int = 20, max_depth: int = 5) -> str:
        """Trains the model over sequences, upserts its metrics and its predictions for all training engines, and saves it.
        The model that ``predict`` uses stays the same."""
        health = self.table(HEALTH)
        rows = rul.prepared(health.read().where("NOT is_test AND rul_label IS NOT NULL"), cap)
        if rows.isEmpty():
            raise SystemExit("the health table has no training rows")
        fitting, held = rul.split(rows)
        model = rul.fit_sequences(fitting, window, max_iter, max_depth)
        path = rul.save(model, self.models, version)
        snapshot, count = health.current_id(), rows.count()
        # an engine is on one side, so its steps are the same whether the sides are scored together or apart
        known, fresh = (model.transform(rul.sequence_vectors(side, window)) for side in (fitting, held))
        found = rul.metrics(known, version, "train", snapshot, count).unionByName(rul.metrics(fresh, version, "holdout", snapshot, count))
        self.table(METRICS).upsert(found)
        self.table(PREDICTED).upsert(rul.predictions(known.unionByName(fresh), version, rul.residual_sigma(fresh), snapshot))
        return path

    def _gold_state(self):
        return self.table(GOLD_STATE).read().where("pipeline_name = 'gold_rul_predict'").first()

    def predict(self, full: bool = False) -> int:
        state = self._gold_state()
        if state is None or not state["active_model_path"]:
            raise SystemExit("no model yet: run train first")
        model, health = rul.load(state["active_model_path"]), self.table(HEALTH)

        def scored(rows: DataFrame) -> DataFrame:
            return rul.predictions(model.transform(rul.prepared(rows)), state["active_model_version"], state["residual_sigma"] or 0.0, health.current_id())

        job = IncrementalJob("gold_rul_predict", health, self.table(PREDICTED), self.table(GOLD_STATE), [*ENGINE, "is_test"], scored)
        if full:
            done = job.sink.upsert(scored(health.read()))
            rows = written_rows(done)
            record_state(job.state, job.name, health.current_id(), rows)
            return rows
        return job.run()

    def full(self, version: str, **options) -> int:
        self.train(version, **options)
        return self.predict(full=True)

    # --- indicators, quality, ground truth -----------------------------------------------------------------------

    def kpi(self, version: str, ts_col: str = "event_ts") -> None:
        self.table(KPI).upsert(kpi.fleet_daily(self.table(HEALTH).read(), self.table(PREDICTED).read(), version, ts_col))

    def quality(self, fail_on_fail: bool = False) -> int:
        found = quality.run_all(self.table(RAW).read(), self.table(HEALTH).read())
        self.table(QUALITY).upsert(found)
        return quality.exit_code(self.table(QUALITY).read().where("run_date = current_date()"), fail_on_fail)

    def load_truth(self, rows: DataFrame) -> None:
        self.table(TRUTH).upsert(rows.withColumn("loaded_ts", F.current_timestamp()))


def _now(spark: SparkSession):
    return spark.range(1).select(F.current_timestamp()).first()[0]
