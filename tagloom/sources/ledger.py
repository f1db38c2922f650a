"""Append-only run tables: worker status, run metadata, manifest entries, failed ranges."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .messages import path_exists

STATUS_SCHEMA = (
    "worker_id int, run_id string, state string, started_at string, updated_at string, row_start long, row_end long, "
    "current_row long, rows_processed long, total_rows long, progress_pct double, api_calls long, rows_per_sec double, "
    "tokens_per_sec double, avg_tokens_per_row double, tokens_total long, errors long, last_error string, "
    "output_file string, checkpoints array<string>, eta_seconds double, completed_at string, failed_at string"
)
RUN_SCHEMA = (
    "run_id string, project string, version string, model_name string, model_tag string, started_at timestamp, "
    "config_snapshot string"
)


def read_status(spark: SparkSession, folder: str, glob: str = "worker_*.json") -> DataFrame:
    """Worker status, one JSON file per worker; an unreadable or half-written file counts as absent."""
    df = (spark.read.schema(STATUS_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED")
          .option("pathGlobFilter", glob).json(folder))
    return df.filter(F.col("worker_id").isNotNull())


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths below a folder; only the listing is used, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return files.load(folder).select("path")


def append(df: DataFrame, path: str) -> None:
    """Add entries to a ledger; earlier ones stay."""
    df.write.mode("append").parquet(path)


def append_failed_ranges(failed: DataFrame, run_id: str, path: str) -> None:
    append(failed.withColumn("run_id", F.lit(run_id)), path)


def append_run_file(entry: DataFrame, path: str) -> None:
    """Log a manifest entry; ``operators.runs.upsert_run_file`` reads the newest one per label."""
    append(entry, path)


class Conflict(RuntimeError):
    """Somebody else committed the entry that was to be written."""


def commit_once(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file with ``text``, or raise ``Conflict`` if there is one already; it appears whole or not at all.

    It is written beside its place and moved there without overwriting, which HDFS does in one step. A store that has no such move
    (most object stores) needs a file system layer that adds it, or drivers that do not run at the same time.
    """
    jvm = spark.sparkContext._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    stream = system.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf)
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(beside, target, never)
    except Py4JJavaError as problem:
        system.delete(beside, False)
        if "FileAlreadyExistsException" not in str(problem.java_exception.getClass().getName()):
            raise
        raise Conflict(f"{path} was committed by another driver") from problem


def record_run(spark: SparkSession, path: str, meta: Mapping[str, str], config: Mapping[str, object],
               started_at: datetime) -> bool:
    """Write the metadata of a run once; a run id that is there already is left as it is. True if written."""
    if path_exists(spark, path):
        known = spark.read.parquet(path).filter(F.col("run_id") == meta["run_id"])
        if not known.isEmpty():
            return False
    row = (meta["run_id"], meta.get("project"), meta.get("version"), meta.get("model_name"), meta.get("model_tag"),
           started_at, json.dumps(config, sort_keys=True))
    append(spark.createDataFrame([row], RUN_SCHEMA), path)
    return True
