"""Labelling rows as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.messages import is_file


def read_stream(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet",
                files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Message files of a folder, or a single file, as a stream.

    Spark streams no path that is a file, but what a pattern finds; so a file is given as a pattern that finds it alone.
    """
    if is_file(spark, path):
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema).format(form)
    if form == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    elif form == "json":
        reader = reader.options(multiLine=True, mode="DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def label_stream(messages: DataFrame, label: Callable[[DataFrame, str], DataFrame], out: str, checkpoint: str,
                 folder: str, **trigger) -> StreamingQuery:
    """Label what is new in each micro-batch and add it to ``out``.

    ``label(rows, wave_folder)`` is usually ``label_table`` with its options bound. The output is partitioned by
    micro-batch and a repeated one replaces its own partition only; its waves have a folder of their own, so a restart
    in the middle does not call the model again for waves that were complete. ``trigger`` is that of ``writeStream``, by
    default ``availableNow=True``.
    """
    def handle(rows: DataFrame, batch_id: int) -> None:
        labelled = label(rows, f"{folder}/stream_batch={batch_id}")
        (labelled.withColumn("stream_batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("stream_batch").parquet(out))

    return (messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
