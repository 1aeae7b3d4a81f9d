"""Feature stages: first write wins, operating conditions, scaling within groups, rolling features, labels.

What is learnt (condition centers, means and deviations per dataset and condition) is a FeatureModel; fitting, full
runs and incremental runs share its one transform.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.functions import expr
from fleetlake.schemas import ENGINE, KEPT_SENSORS, NORMS, ROLLING, SETTINGS, TABLES
from fleetlake.sources.table import SnapshotTable

#: An engine is of the training or of the test files; both count from unit 1.
UNIT = [*ENGINE, "is_test"]


class Deduplicate(Transformer):
    """Keeps the first arrival of each (source_file, line_no); ties go to the given columns, then to any row."""

    def __init__(self, keys: list[str] | None = None, order: list[str] | None = None):
        super().__init__()
        self.keys, self.order = keys or ["source_file", "line_no"], order or ["ingest_ts"]

    def _transform(self, df: DataFrame) -> DataFrame:
        first = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order))
        return df.withColumn("__rank", first).where("__rank = 1").drop("__rank")


class ConditionClusterer(Estimator):
    """K-means over the operating settings, with clusters numbered by their centers in lexicographic order.

    It is fitted on the distinct settings, weighted by their rows and dealt by their hash to a number of partitions that
    follows from how many there are, in sorted order: the result then doesn't depend on the table's layout.
    """

    PART_ROWS = 500_000

    def __init__(self, k: int = 6, seed: int = 42, settings: list[str] | None = None):
        super().__init__()
        self.k, self.seed, self.settings = k, seed, settings or SETTINGS

    def _fit(self, df: DataFrame) -> ConditionModel:
        weighed = df.groupBy(*self.settings).agg(F.count(F.lit(1)).cast("double").alias("weight"))
        weighed = weighed.cache()
        parts = max(1, -(-weighed.count() // self.PART_ROWS))
        dealt = weighed.repartition(parts, *self.settings).sortWithinPartitions(*self.settings)
        rows = VectorAssembler(inputCols=self.settings, outputCol="v", handleInvalid="skip").transform(dealt).cache()
        found = KMeans(k=self.k, seed=self.seed, featuresCol="v", weightCol="weight").fit(rows)
        rows.unpersist()
        weighed.unpersist()
        return ConditionModel(sorted(tuple(float(x) for x in c) for c in found.clusterCenters()), self.settings)


class ConditionModel(Model):
    def __init__(self, centers: list[tuple[float, ...]], settings: list[str] | None = None):
        super().__init__()
        self.centers, self.settings = centers, settings or SETTINGS

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("op_condition_cluster", expr.nearest([F.col(c) for c in self.settings], self.centers))


class GroupScaler(Estimator):
    """Means and population deviations of columns within groups."""

    def __init__(self, columns: list[str], groups: list[str], outputs: list[str]):
        super().__init__()
        self.columns, self.groups, self.outputs = columns, groups, outputs

    def _fit(self, df: DataFrame) -> GroupScalerModel:
        measures = [f(c).alias(f"{c}_{m}") for c in self.columns for f, m in ((F.avg, "mean"), (F.stddev_pop, "std"))]
        return GroupScalerModel(self, df.groupBy(*self.groups).agg(F.count(F.lit(1)).alias("n_samples"), *measures))


class GroupScalerModel(Model):
    """Scales by the stored statistics; rows of unknown groups and groups without deviation come out as 0."""

    def __init__(self, scaler: GroupScaler, stats: DataFrame):
        super().__init__()
        self.scaler, self.stats = scaler, stats

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.scaler
        names = [f"{c}_{m}" for c in s.columns for m in ("mean", "std")]
        met = df.join(self.stats.select(*s.groups, *names), s.groups, "left")
        return met.withColumns({o: expr.z_score(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")) for c, o in zip(s.columns, s.outputs, strict=True)}).drop(*names)


class RollingFeatures(Transformer):
    """Mean, sample deviation and end-to-end slope of the row mean over the last ``window`` cycles of a unit."""

    def __init__(self, columns: list[str], window: int = 5, unit: list[str] | None = None, order: str = "cycle"):
        super().__init__()
        self.columns, self.window, self.unit, self.order = columns, window, unit or UNIT, order

    def _transform(self, df: DataFrame) -> DataFrame:
        x = expr.row_mean(self.columns)
        w = Window.partitionBy(*self.unit).orderBy(self.order).rowsBetween(1 - self.window, 0)
        slope = (F.col("__x") - F.first("__x").over(w)) / F.lit(float(max(self.window - 1, 1)))
        df = df.withColumn("__x", x)
        return df.withColumns({ROLLING[0]: F.avg("__x").over(w), ROLLING[1]: F.stddev_samp("__x").over(w), ROLLING[2]: slope}).drop("__x")


def test_flag(df: DataFrame) -> Column:
    return expr.is_test(F.col("source_file") if "source_file" in df.columns else None)


@dataclass
class FeatureModel:
    """What the feature stages have learnt, under a version."""

    version: str
    conditions: ConditionModel
    scaler: GroupScalerModel
    fit_snapshot_id: int | None = None
    window: int = 5

    def transform(self, raw: DataFrame) -> DataFrame:
        """Rows of the health table (without silver_ts) from raw rows of whole engines."""
        rows = Deduplicate().transform(raw) if {"source_file", "line_no", "ingest_ts"} <= set(raw.columns) else raw
        rows = rows.withColumn("is_test", test_flag(rows))
        rows = self.scaler.transform(self.conditions.transform(rows))
        rows = RollingFeatures(NORMS, self.window).transform(rows)
        return rows.withColumns({"health_index": expr.health_index(F.col(ROLLING[0])), "rul_label": expr.rul_label(UNIT), "silver_version": F.lit(self.version)})

    def save(self, table: SnapshotTable, fit_ts: Column | None = None) -> None:
        centers = [(i, *c) for i, c in enumerate(self.conditions.centers)]
        names = ", ".join(["cluster_id int", *(f"center_{c} double" for c in SETTINGS)])
        stats = self.scaler.stats.withColumnRenamed("op_condition_cluster", "cluster_id").join(table.spark.createDataFrame(centers, names), "cluster_id")
        stamp = {"stats_version": F.lit(self.version), "fit_snapshot_id": F.lit(self.fit_snapshot_id).cast("bigint"), "fit_ts": fit_ts if fit_ts is not None else F.current_timestamp()}
        table.upsert(stats.withColumns(stamp).select(*TABLES["silver.feat_stats"].schema.names))

    @staticmethod
    def load(table: SnapshotTable, version: str | None = None) -> FeatureModel | None:
        """The given or the latest version; None where there is none."""
        rows = table.read()
        if version is None:
            version = rows.agg(F.max_by("stats_version", "fit_ts")).first()[0]
        own = rows.where(F.col("stats_version") == version)
        found = own.select("cluster_id", "fit_snapshot_id", *(f"center_{c}" for c in SETTINGS)).dropDuplicates(["cluster_id"]).orderBy("cluster_id").collect()  # a row per cluster
        if version is None or not found:
            return None
        centers = [tuple(r[f"center_{c}"] for c in SETTINGS) for r in found]
        return FeatureModel(version, ConditionModel(centers), GroupScalerModel(scaler(), own.withColumnRenamed("cluster_id", "op_condition_cluster")), found[0]["fit_snapshot_id"])


def scaler() -> GroupScaler:
    return GroupScaler(KEPT_SENSORS, ["dataset_id", "op_condition_cluster"], NORMS)


def fit_features(raw: DataFrame, version: str, k: int = 6, seed: int = 42, snapshot_id: int | None = None) -> FeatureModel:
    rows = Deduplicate().transform(raw) if {"source_file", "line_no", "ingest_ts"} <= set(raw.columns) else raw
    conditions = ConditionClusterer(k, seed).fit(rows)
    return FeatureModel(version, conditions, scaler().fit(conditions.transform(rows)), snapshot_id)


def sequences(df: DataFrame, columns: list[str], window: int = 30, unit: list[str] | None = None, order: str = "cycle") -> DataFrame:
    """``df`` with ``sequence``: the last ``window`` rows of the columns, oldest first, padded in front with the
    earliest of them."""
    w = Window.partitionBy(*(unit or UNIT)).orderBy(order).rowsBetween(1 - window, 0)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w)
    return df.withColumn("__s", rows).withColumn("sequence", F.concat(F.array_repeat(F.element_at("__s", 1), window - F.size("__s")), F.col("__s"))).drop("__s")
