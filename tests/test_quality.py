import pytest
from pyspark.sql import functions as F

from fleetlake.operators import quality
from fleetlake.schemas import TABLES
from tests.helpers import health_rows, raw_rows


def values(df):
    return {(r.rule_name, r.dataset_id): (r.measured_value, r.status) for r in df.collect()}


@pytest.fixture(scope="module")
def raw(spark):
    return raw_rows(spark, range(1, 3), range(1, 11), flat=True).cache()


def test_clean(spark, raw):
    got = values(quality.run_all(raw, health_rows(spark, 2, 10)))
    assert len(got) == 17 and {s for _, s in got.values()} == {"PASS"}


def test_faults(spark, raw):
    assert values(quality.duplicate_rule(raw.unionByName(raw)))["bronze_dup_ratio", "__ALL__"] == (0.5, "FAIL")
    assert values(quality.cycle_rules(raw.where("cycle <> 5")))["bronze_cycle_monotonic", "FD001"] == (2.0, "FAIL")
    assert values(quality.cycle_rules(raw.where("cycle > 1"), strict=True))["bronze_cycle_starts_at_one", "FD001"] == (2.0, "FAIL")
    health = health_rows(spark, 2, 10)
    one = (F.col("unit_id") == 1) & (F.col("cycle") == 1)
    broken = health.withColumns({"rul_label": F.when(one, -1).otherwise(F.col("rul_label")), "op_condition_cluster": F.when(one, 99).otherwise(0)})
    got = values(quality.health_row_rules(broken))
    assert got["silver_rul_label_nonneg", "FD001"] == (1.0, "FAIL") and got["silver_cluster_in_range", "FD001"] == (1.0, "FAIL")
    tests = values(quality.health_row_rules(health_rows(spark, 1, 5, test=True), strict=True))
    assert tests["silver_rul_label_nonneg", "FD001"][1] == "PASS" and tests["silver_rul_label_nonneg_strict", "FD001"] == (5.0, "FAIL")
    nan = raw.withColumn("sensor_4", F.when(F.col("cycle") == 3, float("nan")).when(F.col("cycle") == 4, float("-inf")).otherwise(F.col("sensor_4")))
    assert values(quality.raw_row_rules(nan))["bronze_finite_sensors", "FD001"] == (4.0, "FAIL")
    assert values(quality.raw_row_rules(raw.withColumn("unit_id", F.when(F.col("cycle") > 8, None).otherwise(F.col("unit_id")))))["bronze_null_key_columns", "__ALL__"] == (4.0, "FAIL")
    assert values(quality.count_rule(raw, health.limit(15)))["silver_count_matches_bronze", "__ALL__"] == (5.0, "FAIL")


def test_null_dataset_isnt_the_total(raw):
    rows = raw.withColumn("dataset_id", F.when(F.col("cycle") > 2, F.col("dataset_id")))
    got = {r.dataset_id: r.sample_size for r in quality.raw_row_rules(rows).where("rule_name = 'bronze_finite_sensors'").collect()}
    assert got == {"FD001": 16, None: 4, "__ALL__": 20}


def test_freshness(spark):
    rows = health_rows(spark, 1, 5)
    now = F.lit(rows.agg(F.max("silver_ts")).first()[0])
    at = {m: values(quality.health_row_rules(rows.withColumn("silver_ts", now), now + F.make_interval(mins=F.lit(m))))["silver_freshness_minutes", "__ALL__"] for m in (0, 150, 500)}
    assert at[0] == (0.0, "PASS") and at[150][1] == "WARN" and at[500][1] == "FAIL"
    empty = spark.createDataFrame([], TABLES["silver.engine_health"].schema)
    assert values(quality.health_row_rules(empty))["silver_freshness_minutes", "__ALL__"][1] == "FAIL"


def test_exit_code_and_counts(raw):
    found = quality.run_all(raw.unionByName(raw), health_rows(raw.sparkSession, 2, 10))
    assert quality.exit_code(found) == 1 and quality.exit_code(found, fail_on_fail=False) == 0
    assert {r.status for r in quality.status_counts(found).collect()} == {"PASS", "FAIL"}


def test_one_scan_for_all_row_rules(raw):
    plan = quality.raw_row_rules(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") == 1
