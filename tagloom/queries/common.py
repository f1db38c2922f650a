"""Shared inputs of the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import whole_div
from ..operators.batches import chunk_batches
from ..operators.position import KeyStats, key_stats, with_position
from ..operators.ranges import assign_worker
from ..session import prepare

WORKERS, BATCH, INTERVAL, RETRIES = 4, 10, 25, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def as_messages(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select(
        (F.col("doc_id") + 1).alias("RowID"), F.col("source").alias("Title"), F.col("text").alias("Message"), *more)


def messages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as messages, with the quality label as given sentiment."""
    quality = table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 1).alias("RowID"),
        F.when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Negative").alias("Sentiment"))
    rows = as_messages(table(spark, sf_dir, "documents"), *more)
    return rows.join(quality, "RowID", "left").select("RowID", "Title", "Message", "Sentiment", *more)


MESSAGES_SQL = """
messages AS (
  SELECT d.doc_id + 1 AS RowID, d.source AS Title, d.text AS Message,
         CASE l.quality WHEN 1 THEN 'Positive' WHEN 0 THEN 'Negative' END AS Sentiment, d.lang, d.n_chars, d.source
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def placed(df: DataFrame, key: str = "RowID", workers: int = WORKERS, size: int = BATCH,
           stats: KeyStats | None = None) -> DataFrame:
    """Position, worker and batch of every row."""
    stats = stats or key_stats(df, key)
    return chunk_batches(assign_worker(with_position(df, key, stats=stats), stats.rows, workers), size)


def placed_sql(source: str = "messages", key: str = "RowID", workers: int = WORKERS, size: int = BATCH) -> str:
    return f"""
tiles AS (SELECT *, row_number() OVER (ORDER BY {key}) AS position, ntile({workers}) OVER (ORDER BY {key}) AS worker_id
          FROM {source}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY {key}) AS pos_in_worker FROM tiles),
placed AS (SELECT *, (pos_in_worker - 1) // {size} AS batch_id,
                  CAST((pos_in_worker - 1) % {size} + 1 AS INTEGER) AS pos FROM ranked)
"""


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a response log: three attempts per unit, token counts and durations from their columns."""
    nanos = F.round(F.col("value") * 100).cast("long") * 10_000_000
    return table(spark, sf_dir, "events").select(
        whole_div(F.col("event_id"), 3).alias("unit_id"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"),
        (F.col("event_type") != "error").alias("ok"), F.col("props").alias("content"),
        F.col("user_id").alias("worker_id"), "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("prompt_eval_count"),
        (F.col("event_id") % 7).alias("prompt_tokens"),
        F.col("user_id").alias("eval_count"), F.lit(5).cast("long").alias("completion_tokens"),
        F.when(F.col("event_type") != "view", nanos).alias("total_duration"),
        F.when(F.col("event_type") == "view", nanos).alias("prompt_eval_duration"),
        F.lit(None).cast("long").alias("eval_duration"),
        F.round(F.col("value") * 100).cast("long").alias("elapsed_ms"))


LOG_SQL = """
log AS (
  SELECT event_id // 3 AS unit_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt, event_type <> 'error' AS ok,
         props AS content, user_id AS worker_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         event_id % 7 AS prompt_tokens, user_id AS eval_count, CAST(round(value * 100) AS BIGINT) AS elapsed_ms,
         CAST(round(value * 100) AS BIGINT) * 10000000 AS nanos
  FROM events),
used AS (
  SELECT *, CASE WHEN k <> 0 THEN k ELSE prompt_tokens END AS prompt_tok,
         CASE WHEN eval_count <> 0 THEN eval_count ELSE 5 END AS completion_tok
  FROM log)
"""


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as worker status: one worker per user, four files."""
    return status_from(table(spark, sf_dir, "events"))


def status_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    state = (F.when(kind == "signup", "initializing").when(kind == "purchase", "completed")
             .when(kind == "error", "failed").otherwise("running"))
    number = F.col("event_id").cast("string")
    return events.select(
        F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("file"), (F.col("user_id") % 4).cast("string")).alias("label"),
        F.col("user_id").alias("worker_id"), F.col("ts").alias("updated_at"), "event_id", state.alias("state"),
        (F.col("event_id") % 101).alias("rows_processed"), F.lit(100).cast("long").alias("total_rows"),
        F.round("value", 2).alias("elapsed_sec"),
        F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("problem "), number)).alias("last_error"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("out_"), number)).alias("output_file"))


STATUS_SQL = """
status AS (
  SELECT 'run' || (user_id % 3) AS run_id, 'file' || (user_id % 4) AS label, user_id AS worker_id, ts AS updated_at,
         event_id, CASE event_type WHEN 'signup' THEN 'initializing' WHEN 'purchase' THEN 'completed'
                                   WHEN 'error' THEN 'failed' ELSE 'running' END AS state,
         event_id % 101 AS rows_processed, 100 AS total_rows, round(value, 2) AS elapsed_sec,
         CASE WHEN event_id % 2 = 1 THEN 'problem ' || event_id END AS last_error,
         CASE WHEN event_id % 5 > 0 THEN 'out_' || event_id END AS output_file
  FROM events),
latest AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM status)
  WHERE rn = 1)
"""
