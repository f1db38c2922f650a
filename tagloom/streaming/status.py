"""Latest status per worker from a stream of status events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import latest_by, worker_keys


def status_stream(events: DataFrame, out: str, checkpoint: str, keys: Sequence[str] | None = None,
                  order: Sequence[str] = ("updated_at", "event_id"), keep: Sequence[str] = ("state",),
                  **trigger) -> StreamingQuery:
    """Keep the newest event per worker (of a run and file) as streaming state, one entry per worker, and log every change to ``out``."""
    keys = keys or worker_keys(events)
    newest = F.max_by(F.struct(*order, *keep), F.struct(*order)).alias("_newest")
    latest = events.groupBy(*keys).agg(newest).select(*keys, "_newest.*")

    def handle(changed: DataFrame, batch_id: int) -> None:
        (changed.withColumn("stream_batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("stream_batch").parquet(out))

    return (latest.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_status_table(spark: SparkSession, out: str, keys: Sequence[str] | None = None,
                      order: Sequence[str] = ("updated_at", "event_id"), schema: T.StructType | None = None) -> DataFrame:
    """Current state per worker from the change log; with the ``schema`` of the events a log without entries can be read too."""
    reader = spark.read.schema(schema) if schema else spark.read
    changes = reader.parquet(out).drop("stream_batch")
    keys = keys or worker_keys(changes)
    return latest_by(changes, keys, order, [c for c in changes.columns if c not in keys])
