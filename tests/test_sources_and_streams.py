import json

import pytest
from pyspark.sql import functions as F

from fleetlake.plans.cli import main, parser
from fleetlake.plans.jobs import BACKFILL_DAYS, DEFAULTS, EXPIRE_DAYS, JOBS, ORPHAN_DAYS, RETAIN, TRAINING_MARGIN_DAYS, minute_of_day
from fleetlake.schemas import TABLES
from fleetlake.sources import readings
from fleetlake.sources.table import SnapshotTable
from fleetlake.streaming.ingest import RAW, ensure_running, ingest
from tests.helpers import raw_rows


def sensor_line(unit, cycle, extra=""):
    return " ".join([str(unit), str(cycle), "0.5", "0.5", "0.5", *["10.0"] * 21]) + extra


def test_sensor_files(spark, tmp_path):
    lines = [sensor_line(u, c, "  9 9" if c == 1 else "  ") for u in (1, 2) for c in (1, 2, 3)]
    (tmp_path / "train_FD001.txt").write_text("\n".join([lines[0], "", "1 2 3", *lines[1:]]) + "\n")
    rows = readings.sensor_records(spark, str(tmp_path), "FD001").orderBy("line_no").collect()
    assert [(r.unit_id, r.cycle) for r in rows] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert [r.line_no for r in rows] == [1, 4, 5, 6, 7, 8] and rows[0].source_file == "train_FD001.txt" and rows[0].sensor_21 == 10.0
    assert readings.sensor_records(spark, str(tmp_path), "FD001", max_units=1).count() == 3
    assert readings.sensor_records(spark, str(tmp_path), "FD001", max_units=0).count() == 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readings.sensor_records(spark, str(tmp_path), "FD009").count()


def test_lines_of_split_files_are_numbered_through(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k}\n" for k in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readings.numbered_lines(spark, str(tmp_path / "a.txt"))
        assert rows.where(F.col("value").cast("long") + 1 != F.col("line_no")).count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("lines", "want"), [(["100", "50", "200"], {1: 100, 2: 50, 3: 200}), (["112.0", "98.9"], {1: 112, 2: 98}), (["100", "", "200", "   ", "300"], {1: 100, 3: 200, 5: 300})])
def test_ground_truth(spark, tmp_path, lines, want):
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    assert {r.unit_id: r.true_rul for r in readings.ground_truth(spark, str(tmp_path / "t.txt"), "FD001").collect()} == want


def test_bad_ground_truth(spark, tmp_path):
    (tmp_path / "t.txt").write_text("100\nabc\n")
    with pytest.raises(Exception, match="line 2"):
        readings.ground_truth(spark, str(tmp_path / "t.txt"), "FD001").collect()


def test_replay_takes_turns(spark):
    rows = raw_rows(spark, range(1, 3), range(1, 4)).unionByName(raw_rows(spark, range(1, 2), range(1, 3), source="test"))
    got = readings.replay_order(rows).orderBy("tick", "dataset_id", "source_file").collect()
    assert [r.source_file[:4] for r in got[:4]] == ["test", "trai", "test", "trai"]
    sent = readings.messages(readings.replay_order(rows)).collect()
    assert sent[0].key == "FD001:1" and json.loads(sent[0].value)["event_ts"].endswith("Z")


def test_replay_keeps_its_pace(spark, tmp_path):
    folder, now, told = f"file://{tmp_path}/in", [0.0], []
    rows = raw_rows(spark, range(1, 3), range(1, 4)).unionByName(raw_rows(spark, range(1, 2), range(1, 3), source="test"))
    clock, wait = lambda: now[0], lambda s: now.__setitem__(0, now[0] + s)
    done = readings.replay(rows, "file", folder, pace=60, speedup=30, report=told.append, clock=clock, wait=wait)
    assert [t["ticks"] for t in told] == [1, 2, 3, 4, 5, 6] and [t["records"] for t in told] == [2, 4, 5, 6, 7, 8]
    assert [t["seconds"] for t in told] == [0, 2, 4, 6, 8, 10] and told[2]["sources"] == 1 and done == told[-1]
    sent = [json.loads(r.value) for r in spark.read.text(folder).collect()]
    assert len(sent) == 8 and done["first_ts"] < done["last_ts"]
    late = iter([0.0, 0.0, 0.0, 5.0, 5.0, 99.0, 99.0])  # start, due, seconds after each sending
    told.clear()
    readings.replay(rows, "file", folder, pace=60, speedup=30, report=told.append, dry_run=True, clock=lambda: next(late), wait=wait)
    assert [t["ticks"] for t in told] == [1, 3, 6]  # what came due meanwhile goes together
    assert readings.replay(rows, "file", folder, pace=0, dry_run=True)["records"] == 8
    assert readings.replay(rows.limit(0), "file", folder)["ticks"] == 0


def test_engines_messages_stay_in_order(spark, tmp_path):
    rows = readings.replay_order(raw_rows(spark, range(1, 6), range(1, 30))).repartition(7)
    readings.publish(rows, "file", f"file://{tmp_path}/in")
    seen = {}
    for file in (tmp_path / "in").glob("part-*"):
        for m in map(json.loads, file.read_text().splitlines()):
            seen.setdefault(m["unit_id"], []).append((file.name, m["cycle"]))
    assert {k: [c for _, c in v] for k, v in seen.items()} == {k: list(range(1, 30)) for k in range(1, 6)}
    assert all(len({f for f, _ in v}) == 1 for v in seen.values())


def test_stream_to_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = raw_rows(spark, range(1, 3), range(1, 6))
    readings.publish(rows, "file", f"{folder}/in")
    spark.createDataFrame([("not json",), ('{"unit_id": 7, "dataset_id": "X"}',)], "value string").write.mode("append").text(f"{folder}/in")
    table = SnapshotTable.create(spark, f"{folder}/raw", TABLES[RAW])
    run = lambda: ingest(readings.message_stream(spark, "file", f"{folder}/in"), table, f"{folder}/check", trigger=None)
    run().awaitTermination()
    got = table.read()
    assert got.count() == 12 and got.where("unit_id = 7 AND event_ts = ingest_ts").count() == 1
    assert got.where("dataset_id IS NULL").count() == 1 and got.where("unit_id = 1").agg(F.sum("sensor_3")).first()[0] == rows.where("unit_id = 1").agg(F.sum("sensor_3")).first()[0]
    before = table.current_id()
    run().awaitTermination()
    assert table.current_id() == before
    query = ensure_running(None, run)
    query.awaitTermination()
    assert ensure_running(query, lambda: "restarted") == "restarted"


def test_unknown_kinds(spark):
    with pytest.raises(ValueError):
        readings.message_stream(spark, "pigeon", "x")
    with pytest.raises(ValueError):
        readings.publish(raw_rows(spark, range(1, 2), range(1, 2)), "pigeon", "x")
    readings.publish(raw_rows(spark, range(1, 2), range(1, 2)), "file", "/nowhere", dry_run=True)


def test_schedule():
    jobs = {j.name: j for j in JOBS}
    assert len(jobs) == 11 and DEFAULTS["retries"] == 2 and not DEFAULTS["catchup"] and not DEFAULTS["depends_on_past"] and DEFAULTS["owner"]
    assert all(len(j.cron.split()) == 5 and j.tags for j in JOBS)
    assert int(jobs["gold_rul_predict"].cron.split()[0]) - int(jobs["silver_merge"].cron.split()[0]) >= 5
    assert minute_of_day(jobs["expire"].cron) - minute_of_day(jobs["compaction"].cron) >= 60
    assert jobs["ingest_streaming"].cron.startswith("*/5 ")
    assert EXPIRE_DAYS >= BACKFILL_DAYS + TRAINING_MARGIN_DAYS and ORPHAN_DAYS >= 7
    assert all(TABLES[t].retain == n for t, n in RETAIN.items())
    verbs = set(parser()._actions[1].choices)
    assert all(v in verbs for j in JOBS for v in j.verbs)


def test_command_line(capsys):
    assert main(["jobs"]) == 0 and "silver_merge" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["kpi"])
