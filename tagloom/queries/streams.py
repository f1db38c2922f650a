"""Structured Streaming: labelling arriving files, and the status of workers."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..plans.calls import ColumnCaller
from ..plans.label import label_table
from ..session import work_folder
from ..streaming.incremental import label_stream as start_labels
from ..streaming.incremental import read_stream
from ..streaming.status import read_status_table, status_stream as start_status
from ..streaming.waves import WaveStream
from .common import STATUS_SQL, as_messages, status_from, table
from .labelling import PLAN, SPEC, with_answer


#: In how many micro-batches documents arrive.
LOTS = 4
#: Columns of the labelled rows, by which an output without rows can be read too.
LABELLED = ", ".join(["RowID long", *[f"`{c}` string" for c in SPEC.columns]])


def _array(attempt):
    return F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["answer"]), ","), F.lit("]"))


UNDAMAGED = ColumnCaller(batch=_array, row=lambda attempt: F.col("rows")[0]["answer"])


def _stream(spark, sf_dir, name):
    """A table as a stream, whether it is one file or a folder of files."""
    return read_stream(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def label_stream(spark, sf_dir):
    """Documents as a stream of files through the whole run."""
    rows = with_answer(as_messages(_stream(spark, sf_dir, "documents"), "lang", "n_chars", "source"))
    folder = work_folder(spark, "label-stream")

    def label(batch, wave_folder):
        return label_table(batch, SPEC, UNDAMAGED, PLAN, extra=("answer",), folder=wave_folder)

    start_labels(rows, label, f"{folder}/out", f"{folder}/state", f"{folder}/waves").awaitTermination()
    return spark.read.schema(LABELLED).parquet(f"{folder}/out").select("RowID", *SPEC.columns)


def label_stream_waves(spark, sf_dir):
    """Documents that arrive in four lots of files, one wave of calls per micro-batch; what failed waits for the next one, the last ones for a drain."""
    folder = work_folder(spark, "label-waves")
    docs = table(spark, sf_dir, "documents")
    # Every task of the scan writes a file for each lot, so none holds more than its split however large the table is.
    docs.withColumn("lot", F.col("doc_id") % LOTS).write.partitionBy("lot").parquet(f"{folder}/in")
    arriving = read_stream(spark, f"{folder}/in", docs.schema, files_per_trigger=docs.rdd.getNumPartitions())
    rows = with_answer(as_messages(arriving, "lang", "n_chars", "source"))
    stream = WaveStream(SPEC, UNDAMAGED, PLAN, f"{folder}/out", f"{folder}/run", extra=("answer",))
    stream.start(rows, f"{folder}/state").awaitTermination()
    stream.drain(spark)
    return stream.rows(spark, LABELLED).select("RowID", *SPEC.columns)


def status_stream(spark, sf_dir):
    folder = work_folder(spark, "status-stream")
    events = status_from(_stream(spark, sf_dir, "events")).select(
        "run_id", "worker_id", "updated_at", "event_id", "state", "rows_processed")
    start = partial(start_status, keep=("state", "rows_processed"))
    start(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_status_table(spark, f"{folder}/out", schema=events.schema).select(
        "run_id", "worker_id", "event_id", "state", "rows_processed")


def status_stream_files(spark, sf_dir):
    """The same with the files that workers belong to, as worker numbers may repeat between files."""
    folder = work_folder(spark, "status-stream")
    events = status_from(_stream(spark, sf_dir, "events")).withColumn("worker_id", F.col("worker_id") % 10).select(
        "run_id", "label", "worker_id", "updated_at", "event_id", "state", "rows_processed")
    start = partial(start_status, keep=("state", "rows_processed"))
    start(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    return read_status_table(spark, f"{folder}/out", schema=events.schema).select(
        "run_id", "label", "worker_id", "event_id", "state", "rows_processed")


QUERIES = {"label_stream": label_stream, "label_stream_waves": label_stream_waves,
           "status_stream": status_stream, "status_stream_files": status_stream_files}

_LABELLED = """
        WITH a AS (SELECT doc_id + 1 AS r, lang, n_chars, source FROM documents),
        b AS (SELECT r, CASE WHEN r % 17 = 0 THEN 'na' WHEN r % 5 = 0 THEN 'N' ELSE 'Y' END AS k,
                     CASE WHEN r % 29 = 0 THEN 'ERROR_MISSING_KEY' WHEN lang = 'en' THEN 'Product'
                          WHEN lang = 'fr' THEN 'Support' WHEN lang = 'de' THEN 'Billing' ELSE '[Custom]' END AS topic,
                     CASE n_chars % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'so_so' END AS tone,
                     source AS note FROM a),
        c AS (SELECT *, CASE WHEN k = 'Y' AND r % 31 = 0 THEN 'ERROR_ALL_RETRIES_FAILED' END AS e FROM b)
        SELECT r AS RowID, coalesce(e, CASE k WHEN 'na' THEN 'NOT_APPLICABLE' ELSE k END) AS Relevant,
               coalesce(e, CASE k WHEN 'na' THEN 'Other'
                    WHEN 'N' THEN CASE topic WHEN 'ERROR_MISSING_KEY' THEN topic ELSE '-' END ELSE topic END) AS Topic,
               coalesce(e, CASE k WHEN 'na' THEN 'Neutral' WHEN 'N' THEN '-' ELSE tone END) AS Tone,
               coalesce(e, CASE k WHEN 'na' THEN NULL WHEN 'N' THEN '-' ELSE note END) AS Note
        FROM c"""

ORACLES = {
    "label_stream": _LABELLED,
    "label_stream_waves": _LABELLED,
    "status_stream": f"""WITH {STATUS_SQL}
        SELECT run_id, worker_id, event_id, state, rows_processed FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, worker_id ORDER BY updated_at DESC, event_id DESC) AS rn
          FROM status) WHERE rn = 1""",
    "status_stream_files": f"""WITH {STATUS_SQL}
        SELECT run_id, label, worker_id % 10 AS worker_id, event_id, state, rows_processed FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, label, worker_id % 10
                                       ORDER BY updated_at DESC, event_id DESC) AS rn FROM status) WHERE rn = 1""",
}
