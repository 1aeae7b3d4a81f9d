"""Session settings that results depend on, and those that suit a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, since event times are written as UTC text; ANSI, since a failed cast must not become null unseen.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "fleetlake", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def prepared(spark: SparkSession) -> SparkSession:
    """Sets what can be set on a session that someone else made."""
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(key, SETTINGS[key])
    return spark
