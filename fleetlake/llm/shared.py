"""The folder that driver and executors share, tables written there, and small files inside it.

On a cluster the folder is named by ``spark.checkpoint.dir``; only where that is unset (tests, laptops) is a
folder of our own made and set. Everything goes below one folder per application, removed when the driver ends.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of Arrow data handed to Python at once; rows of any length then stay within a worker's memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
#: Spark then removes a query's shuffle files as the query ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path; sets one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fleetlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    base = f"{shared_dir(spark)}/fleetlake-{spark.sparkContext.applicationId}"
    known = _app_dir.__dict__.setdefault("known", set())
    if base not in known:
        known.add(base)
        atexit.register(_remove, spark, base)
    return base


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_app_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or file tree written under ``fresh_path``."""
    _remove(spark, path)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends there, and lost
    executors lose nothing. The path is kept as ``.shared_path`` of the result."""
    path = fresh_path(spark, name)
    bounded_batches(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    spark.sparkContext._jvm.System.gc()  # what led here isn't needed again: Spark then removes its shuffle files
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Caps Arrow batches by bytes and rows, so that very long texts do not gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def put_file(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all, from any process: under another name first, then renamed. A task that
    runs again writes the same bytes to the same name."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        path = parts.path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(draft := f"{path}.{uuid.uuid4().hex}.part", "wb") as f:
            f.write(data)
        os.replace(draft, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    store.move(draft, path)


def listed_content(spark: SparkSession, files: DataFrame, glob: str) -> DataFrame | None:
    """``files``, whose column ``path`` names files, with their ``content``, in whatever store they are; None if there is
    none. Folders are listed whole, but only files whose last two names ``files`` has stay."""
    place = lambda c: F.concat_ws("/", F.slice(F.split(c, "/+"), -2, 2))
    folders = [r[0] for r in files.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]  # a row per call of write()
    if not folders:
        return None
    content = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folders).select(place("path").alias("__place"), "content")
    return content.join(files.withColumn("__place", place("path")), "__place").drop("__place")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for clusters on which it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in ship.__dict__.setdefault("sent", set()):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="fleetlake-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    ship.sent.add(app)


def _give_back() -> None:
    """Returns freed memory to the system: idle workers otherwise keep what their last task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with bounded batches and this package at hand; at a task's end its memory goes back."""
    bounded_batches(df.sparkSession)
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(tidy, schema)


def mapped(df: DataFrame, fields: dict[str, str], make: Callable[[pa.RecordBatch], list], keep: list[str] | None = None) -> DataFrame:
    """``df`` with further columns that ``make`` computes from each Arrow batch, one array per field in order.
    ``fields`` gives names and SQL types. Columns of ``df`` that bear such a name are replaced; ``keep`` names the
    columns of ``df`` to pass on (default: all), those that ``make`` reads must be in ``df``."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in fields]
    new = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *make(batch)], names=[*keep, *fields])

    return arrow_map(df, run, schema)
