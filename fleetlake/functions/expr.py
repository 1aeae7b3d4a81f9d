"""Column expressions of the domain; all stay within generated code."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Tiers in cycles left, the score's two time constants, the 90 % quantile of the normal distribution.
TIERS = [(10, "CRITICAL"), (30, "HIGH"), (80, "MED")]
LATE, EARLY = 13.0, 10.0
Z90 = 1.6449
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
INFINITY = float("inf")


def seconds_of(text: str) -> int:
    """Seconds of a duration such as 30s, 5m, 1h or 1d; ValueError for anything else."""
    found = re.fullmatch(r"(\d+)([smhd])", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * SECONDS[found[2]]


def event_time(base: Column, unit: Column, cycle: Column, interval: int, jitter: int) -> Column:
    """base + jitter * unit + interval * (cycle - 1), in seconds."""
    steps = unit.cast("long") * F.lit(jitter) + (cycle.cast("long") - 1) * F.lit(interval)
    return F.timestamp_micros(F.unix_micros(base) + steps * F.lit(1_000_000))


def event_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_test(source_file: Column | None) -> Column:
    """Whether the row comes from a test file; a table without the column holds none."""
    return F.lit(False) if source_file is None else F.coalesce(source_file.startswith("test_"), F.lit(False))


def row_mean(columns: list[str]) -> Column:
    return reduce(add, [F.col(c) for c in columns]) / F.lit(float(len(columns)))


def health_index(average: Column) -> Column:
    """1 for an average at the group's mean, 0 from three deviations on. A null average counts as the worst, since
    least() passes over nulls."""
    return 1 - F.least(F.abs(average), F.lit(3.0)) / F.lit(3.0)


def rul_label(engine: list[str]) -> Column:
    """Cycles left until the engine's last one; null for test engines."""
    last = F.max("cycle").over(Window.partitionBy(*engine))
    return F.when(F.col("is_test"), None).otherwise(last - F.col("cycle")).cast("int")


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (value - mean) / deviation).otherwise(F.lit(0.0))


def nearest(values: list[Column], centers: list[tuple[float, ...]]) -> Column:
    """Index of the nearest center, of equally near ones the first."""
    distances = F.array(*[reduce(add, [F.pow(v - F.lit(float(x)), F.lit(2.0)) for v, x in zip(values, center, strict=True)]) for center in centers])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def split_of(keys: list[Column], ratio: float = 0.8, seed: int = 42) -> Column:
    """True for the training side: a share of the engines picked by hash. The hash is widened before abs(), which
    fails on the least int."""
    return F.abs(F.hash(*keys, F.lit(seed)).cast("long")) % 100 < int(ratio * 100)


def portable_split(key: Column, percent: int = 80) -> Column:
    """The same with a hash that other engines have too."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100 < percent


def phm08(difference: Column) -> Column:
    """Penalty of prediction minus truth: late predictions cost more."""
    return F.when(difference >= 0, F.exp(difference / LATE) - 1).otherwise(F.exp(-difference / EARLY) - 1)


def risk_tier(left: Column) -> Column:
    """Tier by predicted cycles left; null counts as the lowest risk."""
    return F.coalesce(*[F.when(left <= bound, name) for bound, name in TIERS], F.lit("LOW"))


def filled(column: str) -> Column:
    """0 for null and NaN."""
    return F.when(F.col(column).isNull() | F.isnan(column), 0.0).otherwise(F.col(column))


def not_finite(columns: list[str]) -> Column:
    """Whether any of the columns is null, NaN or infinite."""
    return reduce(or_, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == INFINITY) for c in columns])


def unknown(columns: list[str]) -> Column:
    """Whether any of the columns is null or NaN."""
    return reduce(or_, [F.col(c).isNull() | F.isnan(c) for c in columns])


def rule_status(measured: Column, threshold: Column, operator: str) -> Column:
    """PASS, WARN (up to half above the threshold) or FAIL; ValueError for an unknown operator."""
    if operator in ("<=", "<"):
        good = measured <= threshold if operator == "<=" else measured < threshold
        return F.when(good, "PASS").when(measured <= threshold * 1.5 + 1e-9, "WARN").otherwise("FAIL")
    if operator == "==":
        return F.when(F.abs(measured - threshold) <= 1e-9, "PASS").otherwise("FAIL")
    raise ValueError(f"unknown operator {operator!r}")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where there is nothing."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes, cut off."""
    return F.timestamp_diff("MINUTE", earlier, later)
