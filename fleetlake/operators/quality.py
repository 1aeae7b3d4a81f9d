"""Quality rules: declared once, compiled so that a layer is read once for all its row rules.

A row rule counts bad rows or measures their share; all row rules of a layer are one aggregate over the grouping sets
(dataset) and (), turned into a row per rule. Rules over groups share a pre-aggregate of their groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.operators.features import Deduplicate
from fleetlake.schemas import NORMS, ROLLING, SENSORS, TABLES

ALL = "__ALL__"


@dataclass(frozen=True)
class Rule:
    name: str
    layer: str
    threshold: float
    description: str
    operator: str = "<="


# Names and thresholds of the rules.
NULL_KEYS = Rule("bronze_null_key_columns", "bronze", 0, "rows without unit or cycle")
FINITE = Rule("bronze_finite_sensors", "bronze", 0, "rows with a null, NaN or infinite sensor")
DUPLICATES = Rule("bronze_dup_ratio", "bronze", 0.01, "share of rows that repeat a line of a file")
MONOTONIC = Rule("bronze_cycle_monotonic", "bronze", 0, "units with gaps in their cycles")
LABELS = Rule("silver_rul_label_nonneg", "silver", 0, "training rows whose label is missing or negative")
LABELS_STRICT = Rule("silver_rul_label_nonneg_strict", "silver", 0, "rows whose label is missing or negative")
CLUSTERS = Rule("silver_cluster_in_range", "silver", 0, "rows whose condition isn't 0 to 5")
FRESH = Rule("silver_freshness_minutes", "silver", 120, "minutes since the last write")
COUNTS = Rule("silver_count_matches_bronze", "silver", 0, "difference of rows to the raw table's distinct lines")
NAN_RATIO = Rule("silver_nan_feature_ratio", "silver", 0.05, "share of rows with a missing feature")
START = Rule("bronze_cycle_starts_at_one", "bronze", 0, "units whose first cycle isn't 1")

RESULT = ["rule_name", "layer", "dataset_id", "measured_value", "threshold", "operator", "status", "sample_size", "description"]


def dataset_or_all(sets: DataFrame, flag: str = "__all") -> Column:
    """The dataset's name, ``__ALL__`` for the row over all; a null name stays null."""
    return F.when(F.col(flag) == 1, F.lit(ALL)).otherwise(F.col("dataset_id"))


def grouped(rows: DataFrame, *measures: Column) -> DataFrame:
    """Aggregates per dataset and over all rows."""
    sets = rows.groupingSets([["dataset_id"], []], "dataset_id").agg(F.grouping_id().alias("__all"), *measures)
    return sets.withColumn("dataset_id", dataset_or_all(sets)).drop("__all")


def judged(found: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Long form: a row per rule and dataset from columns named by ``rules`` and a column ``sample_size``."""
    rows = []
    for column, rule in rules.items():
        measured = F.col(column).cast("double")
        rows.append(F.struct(F.lit(rule.name).alias("rule_name"), F.lit(rule.layer).alias("layer"), measured.alias("measured_value"), F.lit(float(rule.threshold)).alias("threshold"), F.lit(rule.operator).alias("operator"), expr.rule_status(measured, F.lit(float(rule.threshold)), rule.operator).alias("status"), F.lit(rule.description).alias("description")))
    return found.select("dataset_id", "sample_size", F.explode(F.array(*rows)).alias("r")).select("dataset_id", "sample_size", "r.*").select(*RESULT)


def bad(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def raw_row_rules(raw: DataFrame) -> DataFrame:
    keys = F.col("unit_id").isNull() | F.col("cycle").isNull()
    found = grouped(raw, F.count(F.lit(1)).alias("sample_size"), bad(keys).alias("keys"), bad(expr.not_finite([c for c in SENSORS if c in raw.columns])).alias("finite"))
    return judged(found, {"keys": NULL_KEYS, "finite": FINITE})


def duplicate_rule(raw: DataFrame) -> DataFrame:
    lines = raw.groupBy("dataset_id", "source_file", "line_no").agg(F.count(F.lit(1)).alias("n"))
    found = grouped(lines, F.sum("n").alias("sample_size"), expr.ratio(F.sum(F.col("n") - 1), F.sum("n")).alias("share"))
    return judged(found, {"share": DUPLICATES})


def cycle_rules(raw: DataFrame, strict: bool = False) -> DataFrame:
    rows = Deduplicate().transform(raw) if {"source_file", "line_no", "ingest_ts"} <= set(raw.columns) else raw
    units = rows.groupBy("dataset_id", "unit_id").agg(F.count_distinct("cycle").alias("n"), F.min("cycle").alias("low"), F.max("cycle").alias("high"))
    found = grouped(units, F.count(F.lit(1)).alias("sample_size"), bad(F.col("n") != F.col("high") - F.col("low") + 1).alias("gaps"), bad(F.col("low") != 1).alias("late"))
    return judged(found, {"gaps": MONOTONIC} | ({"late": START} if strict else {}))


def health_row_rules(health: DataFrame, now: Column | None = None, strict: bool = False) -> DataFrame:
    wrong = F.col("rul_label").isNull() | (F.col("rul_label") < 0)
    cluster = F.col("op_condition_cluster")
    now = F.current_timestamp() if now is None else now
    gap = (F.unix_timestamp(now) - F.unix_timestamp(F.max("silver_ts"))) / 60.0
    found = grouped(
        health,
        F.count(F.lit(1)).alias("sample_size"),
        bad(wrong & ~F.coalesce(F.col("is_test"), F.lit(False))).alias("labels"),
        bad(wrong).alias("strict"),
        bad(cluster.isNull() | ~cluster.between(0, 5)).alias("clusters"),
        expr.ratio(bad(expr.unknown(NORMS + ROLLING)), F.count(F.lit(1))).alias("missing"),
    )
    # of its own, since an empty table has no grouping set; only one column is read
    last = health.agg(F.count(F.lit(1)).alias("sample_size"), F.coalesce(gap, F.lit(1e9)).alias("gap")).withColumn("dataset_id", F.lit(ALL))
    rules = {"labels": LABELS, "clusters": CLUSTERS, "missing": NAN_RATIO} | ({"strict": LABELS_STRICT} if strict else {})
    return judged(found, rules).unionByName(judged(last, {"gap": FRESH}))


def count_rule(raw: DataFrame, health: DataFrame) -> DataFrame:
    lines = raw.select("dataset_id", "source_file", "line_no").distinct().groupBy("dataset_id").agg(F.count(F.lit(1)).alias("a"))
    rows = health.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("b"))
    both = lines.join(rows, "dataset_id", "full").select("dataset_id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    found = grouped(both, F.sum("b").alias("sample_size"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("difference"))
    return judged(found, {"difference": COUNTS})


def run_all(raw: DataFrame, health: DataFrame, now: Column | None = None, strict: bool = False) -> DataFrame:
    """Rows of the results table: all rules, each per dataset and over all."""
    parts = [raw_row_rules(raw), duplicate_rule(raw), cycle_rules(raw, strict), health_row_rules(health, now, strict), count_rule(raw, health)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    now = F.current_timestamp() if now is None else now
    return out.withColumns({"run_ts": now, "run_date": F.to_date(now)}).select(*TABLES["gold.dq_results"].schema.names)


def exit_code(results: DataFrame, fail_on_fail: bool = True) -> int:
    return int(fail_on_fail and not results.where("status = 'FAIL'").isEmpty())


def status_counts(results: DataFrame, day: Column | None = None) -> DataFrame:
    return results.where(F.col("run_date") == (F.current_date() if day is None else day)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
