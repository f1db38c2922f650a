"""Model calls, attempts, fallback, and the whole run."""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import answers, attempts
from ..operators.batches import batch_units, single_units
from ..operators.usage import stamp_metadata
from ..plans.calls import ClientCaller, ColumnCaller, GiveUp
from ..plans.label import RunPlan, label_table
from ..session import work_folder
from ..sources.messages import land_messages
from ..spec import PromptSpec
from .common import (BATCH, INTERVAL, LOG_SQL, MESSAGES_SQL, RETRIES, WORKERS, as_messages, messages, placed,
                     placed_sql, response_log, table)

SPEC = PromptSpec(
    columns=("Relevant", "Topic", "Tone", "Note"),
    system_prompt="Label each message. Answer in JSON only.",
    rules={"valid_topic": ["Product", "Support", "Billing"], "valid_tones": ["Positive", "Negative"]},
    defaults={"Relevant": "NOT_APPLICABLE", "Topic": "Other", "Tone": "Neutral"},
)
PLAN = RunPlan(n_workers=WORKERS, batch_size=BATCH, retries=RETRIES, interval=INTERVAL)


def with_answer(rows):
    """Add the model's answer to every row, a pure function of the row."""
    r = F.col("RowID")
    relevant = F.when(r % 17 == 0, "NOT_APPLICABLE").when(r % 5 == 0, "N").otherwise("Y").alias("Relevant")
    lang = F.col("lang")
    topic = F.when(r % 29 != 0, F.when(lang == "en", "Product").when(lang == "fr", "Support")
                   .when(lang == "de", "Billing").when(lang == "es", "[Custom]")).alias("Topic")
    n = F.col("n_chars") % 3
    tone = F.when(n == 0, "Positive").when(n == 1, "Negative").otherwise("so_so").alias("Tone")
    note = F.col("source").alias("Note")
    number = F.to_json(F.struct(relevant, topic, F.lit(7).alias("Tone"), note))
    text = F.to_json(F.struct(relevant, topic, tone, note))
    return rows.withColumn("answer", F.when(r % 31 == 0, number).otherwise(text))


def damaged_batch(attempt):
    """The answers of a batch as one JSON array, damaged according to the number of the batch."""
    g = (F.col("worker_id") - 1) * 1000 + F.col("batch_id")
    items = F.transform("rows", lambda r: r["answer"])
    short = F.slice(items, F.lit(1), F.size(items) - 1)
    longer = F.concat(items, F.array(F.lit("{}")))

    def array(texts):
        return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))

    broken = F.concat(F.lit("["), F.array_join(items, ","))
    return (F.when(g % 23 == 9, broken)
            .when(g % 19 == 8, broken if attempt == 1 else array(items))
            .when(g % 13 == 6, F.concat(F.lit("Here you are: "), array(items), F.lit(" - done")))
            .when(g % 11 == 5, array(longer))
            .when(g % 7 == 3, array(short))
            .otherwise(array(items)))


RESPONDER = ColumnCaller(batch=damaged_batch, row=lambda attempt: F.col("rows")[0]["answer"])


def label_documents(spark, sf_dir):
    """The whole run over all documents."""
    rows = with_answer(messages(spark, sf_dir, "lang", "n_chars", "source"))
    labelled = label_table(rows, SPEC, RESPONDER, PLAN, extra=("answer",))
    return labelled.select("RowID", "Sentiment", *SPEC.columns, "worker_id", "batch_id", "part", "kind", "attempt")


def label_unnumbered(spark, sf_dir):
    """The whole run over documents without ids: landed once and numbered in file order."""
    folder = work_folder(spark, "unnumbered")
    docs = table(spark, sf_dir, "documents").orderBy("doc_id")
    docs.select(F.col("source").alias("Title"), F.col("text").alias("Message"), "lang", "n_chars", "source").write.parquet(f"{folder}/in")
    rows = land_messages(spark, f"{folder}/in", f"{folder}/landed")
    labelled = label_table(with_answer(rows), SPEC, RESPONDER, PLAN, extra=("answer",))
    return labelled.select("RowID", "Sentiment", *SPEC.columns, "worker_id", "batch_id", "part", "kind", "attempt")


def echo_client():
    """Stands for a model: reads the ids out of the prompt and answers one object per message.

    The class is local, so that it travels to the executors with the task and needs no package there.
    """
    class EchoClient:
        def complete(self, model, system, prompt):
            ids = [int(x) for x in re.findall(r"^RowID: (\d+)$", prompt, re.MULTILINE)]
            found = [{"Topic": ("Product", "Support", "Billing")[i % 3], "Key": f"k{i}"} for i in ids]
            single = prompt.startswith("Please label the message below.")
            return {"content": json.dumps(found[0] if single else found), "prompt_eval_count": len(prompt)}

    return EchoClient()


ECHO_SPEC = PromptSpec(columns=("Topic", "Key"), rules={"topic_options": ["Product", "Support"]})


ECHO = ClientCaller(echo_client(), model="echo")


def _called(units, kind):
    """Units through a client in Python, written, read back and parsed."""
    spark = units.sparkSession
    path = work_folder(spark, "calls")
    ECHO(units, 1).write.parquet(path)
    read = answers.AnswerReader(ECHO_SPEC, kind)(spark.read.parquet(path))
    return answers.coded_rows(read, ECHO_SPEC)


def infer_batches(spark, sf_dir):
    rows = placed(messages(spark, sf_dir))
    return _called(batch_units(rows, BATCH, partitions=ECHO.partitions(spark)), "batch")


def infer_rows(spark, sf_dir):
    rows = placed(messages(spark, sf_dir))
    return _called(single_units(rows, partitions=ECHO.partitions(spark)), "row")


def tired_client(calls: int):
    """An echo client that gives up after so many calls of a process."""
    echo, done = echo_client(), []

    class TiredClient:
        def complete(self, model, system, prompt):
            done.append(1)
            if len(done) > calls:
                raise GiveUp("quota used up")
            return echo.complete(model, system, prompt)

    return TiredClient()


def resume_calls(spark, sf_dir):
    """A run whose client gives up on the way, started again with another: every document once, nothing asked twice."""
    rows, folder = messages(spark, sf_dir), work_folder(spark, "resumed")

    def caller(client):
        # Few tasks for few calls, so that a task comes to the call at which its client gives up; more for more calls.
        return replace(ECHO, client=client, name="echo", slice_units=4, least_tasks=4, calls_per_task=500)

    try:
        label_table(rows, ECHO_SPEC, caller(tired_client(10)), PLAN, folder=folder)
    except PySparkException as problem:
        if "quota used up" not in str(problem):
            raise
    return label_table(rows, ECHO_SPEC, caller(echo_client()), PLAN, folder=folder).select(
        "RowID", "Sentiment", "Topic", "Key", "kind", "attempt")


def retry_pending(spark, sf_dir):
    return attempts.retry_pending(response_log(spark, sf_dir), RETRIES + 1)


def resolve_attempts(spark, sf_dir):
    return attempts.resolve_attempts(response_log(spark, sf_dir), ["content", "event_id"])


def fallback_rows(spark, sf_dir):
    """Rows of the batches whose answers never parse."""
    units = batch_units(placed(messages(spark, sf_dir)), BATCH)
    number = (F.col("worker_id") - 1) * 1000 + F.col("batch_id")
    failed = units.filter(number % 23 == 9)
    return attempts.fallback_rows(units, failed).select("worker_id", "batch_id", "RowID", "Sentiment")


def _coded(spark, sf_dir):
    """Labels as coded rows: what a model said about some of the documents."""
    text = {"Relevant": "toxic", "Topic": "quality"}
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + 1).alias("RowID"), *[F.col(c).cast("string").alias(n) for n, c in text.items()])


def terminal_fill(spark, sf_dir):
    """Documents without a label count as out of attempts."""
    rows = messages(spark, sf_dir).select("RowID", "Sentiment")
    spec = PromptSpec(columns=("Relevant", "Topic"))
    coded = _coded(spark, sf_dir)
    lost = rows.join(coded, "RowID", "left_anti")
    return answers.zip_results(rows, coded).unionByName(answers.terminal_fill(lost, spec))


def prefer_batch(spark, sf_dir):
    """Answers from the batch where there are any, else from the row."""
    rows = as_messages(table(spark, sf_dir, "documents"), "lang").select("RowID", F.col("lang").alias("Topic"))
    return attempts.prefer_batch(_coded(spark, sf_dir).select("RowID", "Topic"), rows, ["Topic"])


def zip_results(spark, sf_dir):
    return answers.zip_results(messages(spark, sf_dir), _coded(spark, sf_dir))


def stamp_metrics(spark, sf_dir):
    """Run constants and per-batch figures on every row."""
    rows = placed(as_messages(table(spark, sf_dir, "documents"), "n_chars")).withColumnRenamed("batch_id", "part")
    slim = rows.select("RowID", "worker_id", "part", "n_chars")
    figures = slim.groupBy("worker_id", "part").agg(
        F.count("*").alias("Rows_In_Part"), F.sum("n_chars").alias("Tokens_Total"))
    meta = {"Model_Name": "echo", "Batch_Size": BATCH, "Run_ID": "run1"}
    return stamp_metadata(slim.drop("n_chars"), meta, figures)


_PLACED = f"WITH {MESSAGES_SQL}, {placed_sql()}"
_FLAGSHIP = f"""{_PLACED},
a AS (SELECT *, (worker_id - 1) * 1000 + batch_id AS g,
             pos = count(*) OVER (PARTITION BY worker_id, batch_id) AS is_last,
             CASE WHEN RowID % 17 = 0 THEN 'NOT_APPLICABLE' WHEN RowID % 5 = 0 THEN 'N' ELSE 'Y' END AS rel,
             CASE WHEN RowID % 29 = 0 THEN 'ERROR_MISSING_KEY' WHEN lang = 'en' THEN 'Product'
                  WHEN lang = 'fr' THEN 'Support' WHEN lang = 'de' THEN 'Billing' ELSE '[Custom]' END AS topic,
             CASE n_chars % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'so_so' END AS tone,
             source AS note FROM placed),
b AS (SELECT *, NOT (g % 23 = 9 OR g % 19 = 8 OR g % 13 = 6 OR g % 11 = 5) AND g % 7 = 3 AND is_last AS cut,
             RowID % 31 = 0 AND rel = 'Y' AS bad FROM a),
c AS (SELECT *, bool_or(g % 23 = 9 OR (bad AND NOT cut)) OVER (PARTITION BY worker_id, batch_id) AS alone FROM b),
d AS (SELECT *, CASE WHEN alone AND bad THEN 'failed' WHEN cut AND NOT alone THEN 'padded'
                     WHEN rel = 'NOT_APPLICABLE' THEN 'na' WHEN rel = 'N' THEN 'gated' ELSE 'plain' END AS how FROM c),
f AS (SELECT *, CASE how WHEN 'failed' THEN 'ERROR_ALL_RETRIES_FAILED' WHEN 'padded' THEN 'ERROR_BATCH_MISMATCH' END AS e
      FROM d)
SELECT RowID, Sentiment, coalesce(e, rel) AS Relevant,
       coalesce(e, CASE how WHEN 'na' THEN 'Other'
                            WHEN 'gated' THEN CASE WHEN topic = 'ERROR_MISSING_KEY' THEN topic ELSE '-' END
                            ELSE topic END) AS Topic,
       coalesce(e, CASE how WHEN 'na' THEN 'Neutral' WHEN 'gated' THEN '-' ELSE tone END) AS Tone,
       coalesce(e, CASE how WHEN 'na' THEN NULL WHEN 'gated' THEN '-' ELSE note END) AS Note,
       CAST(worker_id AS INTEGER) AS worker_id, batch_id, (pos_in_worker - 1) // 50 + 1 AS part,
       CASE WHEN alone THEN 'row' ELSE 'batch' END AS kind,
       CASE WHEN alone THEN CASE WHEN bad THEN 3 ELSE 1 END
            WHEN g % 23 <> 9 AND g % 19 = 8 THEN 2 ELSE 1 END AS attempt
FROM f"""
_ECHO = f"""WITH {MESSAGES_SQL}
    SELECT RowID, Sentiment, CASE RowID % 3 WHEN 0 THEN 'Product' WHEN 1 THEN 'Support' ELSE 'Billing' END AS Topic,
           'k' || RowID AS Key FROM messages"""

QUERIES = {f.__name__: f for f in (
    label_documents, label_unnumbered, infer_batches, infer_rows, resume_calls, retry_pending, resolve_attempts, fallback_rows, terminal_fill,
    prefer_batch, zip_results)} | {"stamp_metadata": stamp_metrics}

ORACLES = {
    "label_documents": _FLAGSHIP,
    "label_unnumbered": f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS Sentiment) FROM ({_FLAGSHIP})",
    "infer_batches": _ECHO,
    "infer_rows": _ECHO,
    "resume_calls": f"SELECT *, 'batch' AS kind, 1 AS attempt FROM ({_ECHO})",
    "retry_pending": f"""WITH {LOG_SQL}
        SELECT unit_id, CAST(max(attempt) + 1 AS INTEGER) AS next_attempt FROM log GROUP BY unit_id
        HAVING NOT bool_or(ok)""",
    "resolve_attempts": f"""WITH {LOG_SQL}
        SELECT unit_id, min(attempt) AS attempt, arg_min(content, attempt) AS content,
               arg_min(event_id, attempt) AS event_id FROM log WHERE ok GROUP BY unit_id""",
    "fallback_rows": f"""{_PLACED}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, batch_id, RowID, Sentiment FROM placed
        WHERE ((worker_id - 1) * 1000 + batch_id) % 23 = 9""",
    "terminal_fill": f"""WITH {MESSAGES_SQL}
        SELECT RowID, Sentiment, coalesce(CAST(toxic AS VARCHAR), 'ERROR_ALL_RETRIES_FAILED') AS Relevant,
               coalesce(CAST(quality AS VARCHAR), 'ERROR_ALL_RETRIES_FAILED') AS Topic
        FROM messages LEFT JOIN labels ON doc_id + 1 = RowID""",
    "prefer_batch": """
        SELECT d.doc_id + 1 AS RowID, coalesce(CAST(quality AS VARCHAR), lang) AS Topic
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "zip_results": f"""WITH {MESSAGES_SQL}
        SELECT RowID, Sentiment, CAST(toxic AS VARCHAR) AS Relevant, CAST(quality AS VARCHAR) AS Topic
        FROM messages JOIN labels ON doc_id + 1 = RowID""",
    "stamp_metadata": f"""{_PLACED}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, batch_id AS part, RowID, 'echo' AS Model_Name,
               {BATCH} AS Batch_Size, 'run1' AS Run_ID,
               count(*) OVER (PARTITION BY worker_id, batch_id) AS Rows_In_Part,
               CAST(sum(n_chars) OVER (PARTITION BY worker_id, batch_id) AS BIGINT) AS Tokens_Total FROM placed""",
}
