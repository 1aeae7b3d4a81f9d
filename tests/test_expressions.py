import math

import pytest
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.operators import features, rul
from fleetlake.schemas import KEPT_SENSORS, NORMS
from tests.helpers import CENTERS, health_rows, raw_rows


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column).first()[0]


@pytest.mark.parametrize(("text", "seconds"), [("30s", 30), ("5m", 300), ("1h", 3600), ("1d", 86400), ("12h", 43200), ("  2d  ", 172800)])
def test_durations(text, seconds):
    assert expr.seconds_of(text) == seconds


@pytest.mark.parametrize("text", ["", "1", "h", "1x", "abc", "-1h", "1.5h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        expr.seconds_of(text)


@pytest.mark.parametrize(("unit", "cycle", "interval", "jitter", "want"), [(1, 1, 3600, 3600, "2025-08-01T01:00:00.000Z"), (5, 10, 3600, 3600, "2025-08-01T14:00:00.000Z"), (99, 1, 3600, 0, "2025-08-01T00:00:00.000Z"), (0, 13, 300, 0, "2025-08-01T01:00:00.000Z")])
def test_event_time(spark, unit, cycle, interval, jitter, want):
    ts = expr.event_time(F.lit("2025-08-01").cast("timestamp"), F.col("u"), F.col("c"), interval, jitter)
    assert one(spark, expr.event_text(ts), u=unit, c=cycle) == want


@pytest.mark.parametrize(("average", "want"), [(0.0, 1.0), (1.5, 0.5), (-1.5, 0.5), (3.0, 0.0), (5.0, 0.0), (-100.0, 0.0)])
def test_health_index(spark, average, want):
    assert one(spark, expr.health_index(F.col("a")), a=average) == want


def test_null_average_is_worst(spark):
    assert spark.range(1).select(expr.health_index(F.lit(None).cast("double"))).first()[0] == 0.0


@pytest.mark.parametrize(("measured", "threshold", "operator", "want"), [(0, 0, "<=", "PASS"), (0, 0, "<", "WARN"), (0.5, 1, "<=", "PASS"), (1, 1, "<=", "PASS"), (1.4, 1, "<=", "WARN"), (1.5, 1, "<=", "WARN"), (1.6, 1, "<=", "FAIL"), (5, 5, "==", "PASS"), (5.0001, 5, "==", "FAIL"), (1, 0, "<=", "FAIL")])
def test_rule_status(spark, measured, threshold, operator, want):
    assert one(spark, expr.rule_status(F.col("m"), F.col("t"), operator), m=float(measured), t=float(threshold)) == want


def test_unknown_operator():
    with pytest.raises(ValueError):
        expr.rule_status(F, F, "?")


def test_scores_and_tiers(spark):
    assert one(spark, expr.phm08(F.col("d")), d=13.0) == pytest.approx(math.e - 1)
    assert one(spark, expr.phm08(F.col("d")), d=-10.0) == pytest.approx(math.e - 1)
    assert [one(spark, expr.risk_tier(F.col("x")), x=float(x)) for x in (10, 10.1, 30, 80, 81)] == ["CRITICAL", "HIGH", "HIGH", "MED", "LOW"]
    assert spark.range(1).select(expr.risk_tier(F.lit(None).cast("double"))).first()[0] == "LOW"


def test_nearest_center(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (9.0, 0.0), (0.0, 9.0), (5.0, 0.0)], "a double, b double")
    got = [r[0] for r in rows.select(expr.nearest([F.col("a"), F.col("b")], [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)])).collect()]
    assert got == [0, 1, 2, 0]


def test_split_keeps_units_whole(spark):
    rows = spark.range(4 * 100 * 3).select(F.concat(F.lit("FD00"), (F.col("id") % 4).cast("string")).alias("dataset_id"), (F.col("id") / 12).cast("int").alias("unit_id"))
    train, held = rul.split(rows)
    a, b = ({(r.dataset_id, r.unit_id) for r in x.distinct().collect()} for x in (train, held))
    assert not a & b and train.count() + held.count() == 1200 and 0.7 <= len(a) / (len(a) + len(b)) <= 0.9
    assert {d for d, _ in a} == {d for d, _ in b} and a == {(r.dataset_id, r.unit_id) for r in rul.split(rows)[0].distinct().collect()}


def test_rolling(spark):
    rows = spark.createDataFrame([("A", 1, k, x) for k, x in enumerate((1.0, 3.0, 5.0, 7.0))] + [("A", 2, 0, 100.0)], "dataset_id string, unit_id int, cycle int, x double")
    out = features.RollingFeatures(["x"], 3, ["dataset_id", "unit_id"]).transform(rows).orderBy("unit_id", "cycle").collect()
    assert [r.s_avg_w5 for r in out] == [1, 2, 3, 5, 100] and [r.s_trend_w5 for r in out] == [0, 1, 2, 2, 0]
    assert out[0].s_std_w5 is None and [round(r.s_std_w5, 6) for r in out[1:4]] == [1.414214, 2, 2]


def test_conditions_dont_depend_on_layout(spark):
    rows = raw_rows(spark, range(1, 5), range(1, 40))
    a, b = (features.ConditionClusterer(6).fit(x).centers for x in (rows, rows.repartition(7)))
    assert a == b and [tuple(round(x, 1) for x in c) for c in a] == [tuple(round(x, 1) for x in c) for c in CENTERS]


def test_scaling_with_and_without_deviation(spark):
    rows = spark.createDataFrame([("A", 0, 1.0), ("A", 0, 3.0), ("A", 1, 5.0)], "dataset_id string, g int, x double")
    model = features.GroupScaler(["x"], ["dataset_id", "g"], ["z"]).fit(rows)
    assert sorted(r.z for r in model.transform(rows).collect()) == [-1.0, 0.0, 1.0]
    other = spark.createDataFrame([("A", 9, 1.0)], "dataset_id string, g int, x double")
    assert model.transform(other).first().z == 0.0


def test_flags_without_source(spark):
    assert spark.range(1).select(features.test_flag(spark.range(1)).alias("t")).first().t is False
    rows = spark.createDataFrame([("test_a",), ("train_a",), (None,)], "source_file string")
    assert [r.t for r in rows.select(features.test_flag(rows).alias("t")).collect()] == [True, False, False]


def test_prepared_and_sequences(spark):
    rows = spark.createDataFrame([(None, float("nan"), None), (1.0, 2.0, 500)], "s_std_w5 double, s_trend_w5 double, rul_label int")
    got = rul.prepared(rows).collect()
    assert [(r.s_std_w5, r.s_trend_w5, r.rul_capped) for r in got] == [(0.0, 0.0, 130.0), (1.0, 2.0, 130.0)]
    rows = health_rows(spark, 1, 4)
    got = features.sequences(rows, ["cycle"], 3).orderBy("cycle").collect()
    assert [[x[0] for x in r.sequence] for r in got] == [[1, 1, 1], [1, 1, 2], [1, 2, 3], [2, 3, 4]]


def test_feature_columns():
    assert len(rul.FEATURES) == 20 and len(KEPT_SENSORS) == len(NORMS) == 14


def test_sequence_model(spark):
    rows = rul.prepared(health_rows(spark, 6, 20))
    model = rul.fit_sequences(rows, window=5, max_iter=3, max_depth=3)
    scored = model.transform(rul.sequence_vectors(rows, 5))
    assert len(scored.first().features) == 5 * 19 and scored.count() == 120 and rul.residual_sigma(scored) < 3
