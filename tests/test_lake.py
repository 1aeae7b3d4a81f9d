"""The lake end to end: versioned tables, incremental health rows, models, indicators, quality, maintenance."""

import time

import pytest
from pyspark.sql import functions as F

from fleetlake.plans import incremental, maintenance
from fleetlake.plans.cli import reports
from fleetlake.schemas import NORMS
from fleetlake.sources.table import CommitConflict, ExpiredSnapshot, SnapshotTable
from tests.helpers import health_rows, raw_rows


@pytest.fixture()
def lake(spark, tmp_path):
    return incremental.Lake(spark, f"file://{tmp_path}/lake")


def keyed(df, *columns):
    return {(r["dataset_id"], r["unit_id"], r["cycle"], r["is_test"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_append_keeps_duplicates_and_skips_empty(spark, lake):
    raw = lake.table(incremental.RAW)
    rows = raw_rows(spark, range(1, 3), range(1, 6))
    one, two = raw.append(rows), raw.append(rows)
    assert one.snapshot_id != two.snapshot_id and raw.read().count() == 20
    assert raw.append(rows.limit(0)) is None and raw.current_id() == two.snapshot_id
    assert raw.append(rows, ("q", 3)) and raw.append(rows, ("q", 3)) is None and raw.append(rows, ("q", 2)) is None


def test_upsert_changes_time_travel_tags(spark, lake):
    truth = lake.table(incremental.TRUTH)
    row = lambda *x: spark.createDataFrame(list(x), "dataset_id string, unit_id int, true_rul int").withColumn("loaded_ts", F.current_timestamp())
    first = truth.upsert(row(("A", 1, 10), ("B", 1, 20), ("A", 2, 30)))
    truth.tag("start")
    second = truth.upsert(row(("A", 1, 11), ("A", 3, 40)))
    got = {(r.dataset_id, r.unit_id): r.true_rul for r in truth.read().collect()}
    assert got == {("A", 1): 11, ("A", 2): 30, ("A", 3): 40, ("B", 1): 20}
    assert second.operation == "overwrite" and second.summary["total-records"] == "4"
    assert all("p_dataset=B" not in f for f in second.removed)  # files without a match stay
    assert truth.read(version_as_of=first.snapshot_id).count() == 3 == truth.read(tag="start").count()
    assert truth.read(timestamp_as_of=int(time.time() * 1000) + 1000).count() == 4
    assert truth.changes(first.snapshot_id).where("true_rul in (11, 40)").count() == 2
    with pytest.raises(ValueError):
        truth.upsert(row(("A", 9, 1), ("A", 9, 2)))
    assert truth.read().count() == 4
    assert {(r.name, r.type) for r in truth.refs().collect()} == {("main", "BRANCH"), ("start", "TAG")}
    truth.rollback_to(first.snapshot_id)
    assert truth.read().count() == 3
    with pytest.raises(ExpiredSnapshot):
        truth.read(version_as_of=1)


def test_null_keys_and_conflicts(spark, lake):
    truth = lake.table(incremental.TRUTH)
    row = lambda *x: spark.createDataFrame(list(x), "dataset_id string, unit_id int, true_rul int, loaded_ts timestamp")
    truth.upsert(row((None, 1, 10, None)))
    truth.upsert(row((None, 1, 12, None)))
    assert [r.true_rul for r in truth.read().collect()] == [12]
    last = truth._last()
    truth.append(row(("A", 5, 1, None)))
    with pytest.raises(CommitConflict):
        truth._put("overwrite", [], ["data/x"], {}, last.version)


def test_compact_expire_orphans(spark, lake):
    raw = lake.table(incremental.RAW)
    ids = [raw.append(raw_rows(spark, range(1, 2), range(k, k + 1))).snapshot_id for k in range(1, 13)]
    before = raw.files().count()
    assert raw.compact().operation == "replace" and raw.files().count() < before
    assert raw.read().count() == 12 == raw.changes(None).count() and raw.compact() is None
    now = int(time.time() * 1000) + 60_000
    assert raw.remove_orphans(now, dry_run=True) == []
    raw.tag("keep", ids[8])
    gone = raw.expire(now, retain_last=1)
    assert gone == 8 and raw.read().count() == 12 and raw.read(tag="keep").count() == 9
    with pytest.raises(ExpiredSnapshot):
        raw.changes(None)
    raw.store.create("data/stray.parquet", "x")
    assert raw.remove_orphans(now) == ["data/stray.parquet"] and raw.read().count() == 12


def test_full_equals_incremental(spark, lake, tmp_path):
    other = incremental.Lake(spark, f"file://{tmp_path}/other")
    whole = raw_rows(spark, range(1, 7), range(1, 31))
    lake.table(incremental.RAW).append(whole)
    lake.silver_full("v1")
    other.table(incremental.RAW).append(whole)
    with pytest.raises(SystemExit):
        other.silver_incremental()
    other.fit_stats("v1")
    assert other.silver_incremental() == 180
    columns = ("op_condition_cluster", "rul_label", "health_index", *NORMS)
    a, b = (keyed(x.table(incremental.HEALTH).read(), *columns) for x in (lake, other))
    assert a.keys() == b.keys() and len(a) == 180
    for k, x in a.items():
        assert x[:2] == b[k][:2] and x[2:] == pytest.approx(b[k][2:], abs=1e-9)
    assert {x[0] for x in a.values()} == set(range(6))


def test_new_cycles_relabel_and_watermark(spark, lake):
    raw, health = lake.table(incremental.RAW), lake.table(incremental.HEALTH)
    raw.append(raw_rows(spark, range(1, 3), range(1, 11)))
    lake.fit_stats("v1", k=2)
    lake.silver_incremental()
    assert keyed(health.read(), "rul_label")["FD001", 1, 1, False] == (9,)
    raw.append(raw_rows(spark, range(1, 3), range(11, 16)))
    lake.silver_incremental()
    assert keyed(health.read(), "rul_label")["FD001", 1, 1, False] == (14,) and health.read().count() == 30
    state = lake.table(incremental.STATE).read().first()
    assert state.last_snapshot_id == raw.current_id() and state.active_stats_version == "v1"
    assert lake.silver_incremental() == 0
    assert lake.table(incremental.STATE).read().first().rows_processed == 0
    raw.append(raw_rows(spark, range(1, 3), range(11, 16)))  # replayed lines change nothing
    lake.silver_incremental()
    assert health.read().count() == 30


def test_train_and_test_engines_stay_apart(spark, lake):
    raw = lake.table(incremental.RAW)
    raw.append(raw_rows(spark, range(1, 3), range(1, 21)))
    raw.append(raw_rows(spark, range(1, 3), range(1, 6), source="test"))
    lake.silver_full("v1", k=2)
    rows = lake.table(incremental.HEALTH).read()
    assert rows.count() == 50 and rows.where("is_test AND rul_label IS NULL").count() == 10
    assert keyed(rows, "rul_label")["FD001", 1, 1, False] == (19,)


def test_sequence_model_writes_its_rows(spark, lake):
    with pytest.raises(SystemExit):
        lake.train_sequences("s1")
    lake.table(incremental.HEALTH).append(health_rows(spark, 10, 20).unionByName(health_rows(spark, 2, 15, test=True, offset=10)))
    for _ in range(2):  # again: the same keys
        lake.train_sequences("s1", window=5, max_iter=3, max_depth=3)
    found = {r.eval_split: r for r in lake.table(incremental.METRICS).read().collect()}
    predicted = lake.table(incremental.PREDICTED).read()
    assert set(found) == {"train", "holdout"} and found["train"].sample_count + found["holdout"].sample_count == 200 == predicted.count()
    assert predicted.where("is_test OR model_version <> 's1' OR rul_pred_lower > rul_pred OR rul_actual <> 20 - cycle").count() == 0
    assert lake.table(incremental.GOLD_STATE).read().count() == 0


def test_model_lifecycle(spark, lake):
    with pytest.raises(SystemExit):
        lake.predict()
    health = lake.table(incremental.HEALTH)
    health.append(health_rows(spark, 10, 20).unionByName(health_rows(spark, 3, 15, test=True, offset=10)))
    lake.load_truth(spark.createDataFrame([("FD001", 11, 30), ("FD001", 12, 50), ("FD001", 13, 70)], "dataset_id string, unit_id int, true_rul int"))
    path = lake.train("m1", max_iter=5, max_depth=3)
    found = {r.eval_split: r for r in lake.table(incremental.METRICS).read().collect()}
    assert set(found) == {"train", "holdout", "nasa_test"} and found["nasa_test"].sample_count == 3
    assert lake.predict(full=True) == 245
    predicted = lake.table(incremental.PREDICTED)
    assert predicted.read().where("rul_pred_lower > rul_pred OR rul_pred > rul_pred_upper").count() == 0
    assert lake.predict() == 0
    state = lake.table(incremental.GOLD_STATE).read().first()
    assert state.active_model_path == path and state.last_snapshot_id == health.current_id()
    health.append(health_rows(spark, 1, 25, offset=50))
    assert lake.predict() == 25 and predicted.read().count() == 270
    lake.kpi("m1")
    lake.kpi("m1")
    kpi = lake.table(incremental.KPI).read().collect()
    assert len(kpi) == 1 and kpi[0].engine_count == 14 and kpi[0].critical_count <= kpi[0].high_count <= kpi[0].medium_count
    for name, report in reports(lake, "m1").items():
        report.collect()
        assert report.columns, name


def test_quality_and_maintenance_run(spark, lake):
    lake.table(incremental.RAW).append(raw_rows(spark, range(1, 4), range(1, 41)))
    lake.silver_full("v1", k=3)
    assert lake.quality(fail_on_fail=True) == 0
    n = lake.table(incremental.QUALITY).read().count()
    lake.quality()
    assert lake.table(incremental.QUALITY).read().count() == n == 17
    done = maintenance.run(lake.catalog)
    assert list(done) == maintenance.ORDER and done["verify"][incremental.RAW] == 120
    with pytest.raises(ValueError):
        maintenance.run(lake.catalog, "defragment")


def test_create_and_drop(spark, tmp_path):
    lake = incremental.Lake(spark, f"file://{tmp_path}/c")
    lake.catalog.create_all()
    lake.catalog.register_views()
    assert spark.sql("SELECT count(*) FROM silver_engine_health").first()[0] == 0
    table = lake.table(incremental.TRUTH)
    table.append(spark.createDataFrame([("A", 1, 1, None)], table.spec.schema))
    assert table.delete_all().operation == "delete" and table.read().isEmpty()
    assert isinstance(SnapshotTable.create(spark, table.path, table.spec, replace=True), SnapshotTable) and table.current_id() is None
