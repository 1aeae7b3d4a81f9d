"""Streaming ingestion of messages into the raw table."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlake.schemas import MESSAGE, TABLES
from fleetlake.sources.table import SnapshotTable

RAW = "bronze.engine_sensor_raw"


def parsed(stream: DataFrame) -> DataFrame:
    """Rows of the raw table from messages. A broken message gives a row of nulls; without an event time the arrival
    counts."""
    body = F.from_json(F.col("value").cast("string"), MESSAGE, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"})
    rows = stream.select(body.alias("m")).select("m.*").withColumn("ingest_ts", F.current_timestamp())
    return rows.withColumn("event_ts", F.coalesce("event_ts", "ingest_ts")).select(*TABLES[RAW].schema.names)


def ingest(stream: DataFrame, table: SnapshotTable, checkpoint: str, trigger: str | None = "10 seconds", exactly_once: bool = True, name: str = "raw_ingest") -> StreamingQuery:
    """Starts the query that appends each micro-batch; ``trigger`` None takes all there is and ends. Batches that
    bring nothing make no snapshot. Exactly once by the batch's number in the commit, else at least once."""

    def add(batch: DataFrame, number: int) -> None:
        table.append(batch, (name, number) if exactly_once else None)

    writer = parsed(stream).writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def keep_running(restart, pause: float = 30.0, most: int | None = None) -> None:
    """Starts the query with ``restart`` and looks after it each ``pause`` seconds until it ends by itself. One that fails
    is started again, from its checkpoint, ``most`` times at most (None: always)."""
    query, failed = None, 0
    while True:
        query = ensure_running(query, restart)
        try:
            if query.awaitTermination(pause):
                return
        except StreamingQueryException:
            failed += 1
            if most is not None and failed > most:
                raise


def ensure_running(query: StreamingQuery | None, restart) -> StreamingQuery:
    """The query if it is alive, else what ``restart`` starts."""
    return query if query is not None and query.isActive else restart()
