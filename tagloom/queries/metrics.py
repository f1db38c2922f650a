"""Usage, throughput, parts, distributions, error counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import whole_div
from ..operators import audit, batches, usage
from ..operators.position import key_stats
from ..operators.ranges import worker_rows
from .common import (BATCH, INTERVAL, LOG_SQL, MESSAGES_SQL, WORKERS, as_messages, placed, placed_sql, response_log,
                     table)


def token_usage(spark, sf_dir):
    return usage.token_usage(response_log(spark, sf_dir), ["worker_id"])


def throughput(spark, sf_dir):
    """Rates per worker; every response counts as one row."""
    used = usage.with_usage(response_log(spark, sf_dir))
    totals = used.groupBy("worker_id").agg(
        F.count_if("ok").alias("rows"), F.sum(F.col("prompt_tok") + F.col("completion_tok")).alias("tokens_total"),
        F.sum(F.when(F.col("worker_id") % 7 > 0, F.col("nanos")).otherwise(0)).alias("nanos"),
        (F.sum("elapsed_ms") / 1000).alias("elapsed_sec"))
    return usage.with_rates(totals, "rows", "elapsed_sec", "tokens_total", "nanos", 4)


def running_throughput(spark, sf_dir):
    """Figures after each part of five hundred responses, per group of workers."""
    used = usage.with_usage(response_log(spark, sf_dir))
    group = (F.col("worker_id") % 8).alias("worker_id")
    parts = used.groupBy(group, whole_div(F.col("event_id"), 500).alias("part")).agg(
        F.count("*").alias("rows"), F.sum(F.col("prompt_tok") + F.col("completion_tok")).alias("tokens"),
        F.sum("nanos").alias("nanos"), F.sum("elapsed_ms").alias("elapsed_ms"))
    figures = usage.running_throughput(parts)
    return figures.select("worker_id", "part", "rows_so_far", "tokens_so_far", "rows_per_sec", "tokens_per_sec",
                          "avg_tokens_per_row")


def busy_time(spark, sf_dir):
    """Calls per kind of event that overlap: how long at least one of a kind was under way."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    log = table(spark, sf_dir, "events").select(
        "event_type", start.alias("started_us"), (start + F.round(F.col("value") * 100).cast("long") * 100_000).alias("ended_us"))
    return usage.busy_time(log, ["event_type"])


def call_figures(spark, sf_dir):
    """Throughput per group of workers, from calls that overlap."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_id", start.alias("started_us"))
    log = response_log(spark, sf_dir).join(events, "event_id").withColumns({
        "worker_id": F.col("worker_id") % 8, "ended_us": F.col("started_us") + F.col("elapsed_ms") * 100_000})
    return usage.call_figures(log, log.filter("ok").select("worker_id"))


def part_number(spark, sf_dir):
    rows = batches.part_number(placed(as_messages(table(spark, sf_dir, "documents"))), BATCH, INTERVAL)
    return rows.groupBy("worker_id", "part").agg(
        F.count("*").alias("rows"), F.min("RowID").alias("first_id"), F.max("RowID").alias("last_id"))


def progress_points(spark, sf_dir):
    """Batches after which a worker reports, with the rows done by then."""
    docs = as_messages(table(spark, sf_dir, "documents"))
    stats = key_stats(docs, "RowID")
    rows = placed(docs, stats=stats)
    return batches.progress_points(rows, BATCH, worker_rows(F.col("worker_id"), stats.rows, WORKERS))


def category_counts(spark, sf_dir):
    """Distributions of the orders and their customers; keys, names and prices have too many values."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return audit.category_counts(joined.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_name", "c_nationkey", "c_mktsegment"))


def analytics_long(spark, sf_dir):
    return audit.metric_counts(audit.category_counts(table(spark, sf_dir, "orders").drop("o_orderdate")))


def analytics_wide(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return audit.analytics_row(orders, {"run_id": "run1", "model": "echo", "batch_size": BATCH, "api_calls": 7})


def error_cells(spark, sf_dir):
    """Errors among event types and in texts made from them."""
    kind = F.upper("event_type")
    rows = table(spark, sf_dir, "events").select(
        "event_id", kind.alias("state"), F.concat(kind, F.lit("_X")).alias("text"), "value",
        F.when(F.col("event_id") % 3 == 0, F.lit("an ERROR_MISSING_KEY here")).alias("note"))
    return audit.error_cells(rows)


_PLACED = f"WITH {MESSAGES_SQL}, {placed_sql()}"
_RATES = """round(rows / greatest(sec, 1e-9), 4) AS rows_per_sec,
    CASE WHEN nanos > 0 THEN round(tokens / (nanos / 1e9), 4) END AS tokens_per_sec,
    CASE WHEN rows > 0 THEN round(tokens / rows, 4) END AS avg_tokens_per_row"""

_CALLS = """calls AS (
    SELECT event_type, user_id % 8 AS worker, epoch_us(ts) AS started,
           epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 100000 AS ended FROM events)"""


def _islands(by):
    """Stretches of overlapping calls: a call that begins after all earlier ones have ended opens a new one."""
    return f"""
    marked AS (SELECT *, max(ended) OVER (PARTITION BY {by} ORDER BY started, ended
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
               FROM calls WHERE ended > started),
    numbered AS (SELECT *, sum(CASE WHEN until IS NULL OR until < started THEN 1 ELSE 0 END)
                             OVER (PARTITION BY {by} ORDER BY started, ended ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    spans AS (SELECT {by}, island, max(ended) - min(started) AS span FROM numbered GROUP BY ALL),
    islands AS (SELECT {by}, CAST(sum(span) AS BIGINT) AS busy, count(*) AS stretches FROM spans GROUP BY ALL)"""


QUERIES = {f.__name__: f for f in (
    token_usage, throughput, running_throughput, busy_time, call_figures, part_number, progress_points, category_counts, analytics_long,
    analytics_wide, error_cells)}

ORACLES = {
    "token_usage": f"""WITH {LOG_SQL}
        SELECT worker_id, CAST(sum(prompt_tok) AS BIGINT) AS prompt_tokens,
               CAST(sum(completion_tok) AS BIGINT) AS completion_tokens,
               CAST(sum(prompt_tok + completion_tok) AS BIGINT) AS total_tokens,
               CAST(sum(nanos) AS BIGINT) AS total_duration_ns FROM used GROUP BY worker_id""",
    "throughput": f"""WITH {LOG_SQL}, t AS (
          SELECT worker_id, count(*) FILTER (ok) AS rows, CAST(sum(prompt_tok + completion_tok) AS BIGINT) AS tokens,
                 CAST(sum(CASE WHEN worker_id % 7 > 0 THEN nanos ELSE 0 END) AS BIGINT) AS nanos,
                 CAST(sum(elapsed_ms) AS BIGINT) / 1000 AS sec FROM used GROUP BY worker_id)
        SELECT worker_id, rows, tokens AS tokens_total, nanos, sec AS elapsed_sec, {_RATES} FROM t""",
    "running_throughput": f"""WITH {LOG_SQL}, p AS (
          SELECT worker_id % 8 AS worker_id, event_id // 500 AS part, count(*) AS rows,
                 sum(prompt_tok + completion_tok) AS tokens, sum(nanos) AS nanos, sum(elapsed_ms) AS ms
          FROM used GROUP BY 1, 2),
        r AS (SELECT worker_id, part, CAST(sum(rows) OVER w AS BIGINT) AS rows, CAST(sum(tokens) OVER w AS BIGINT) AS tokens,
                     CAST(sum(nanos) OVER w AS BIGINT) AS nanos, CAST(sum(ms) OVER w AS BIGINT) / 1000 AS sec
              FROM p WINDOW w AS (PARTITION BY worker_id ORDER BY part))
        SELECT worker_id, part, rows AS rows_so_far, tokens AS tokens_so_far, {_RATES} FROM r""",
    "busy_time": f"""WITH {_CALLS}, {_islands("event_type")}
        SELECT event_type, count(*) AS calls, CAST(sum(ended - started) AS BIGINT) AS summed, any_value(busy) AS busy,
               any_value(stretches) AS stretches FROM calls JOIN islands USING (event_type) GROUP BY event_type""",
    "call_figures": f"""WITH {LOG_SQL}, {_CALLS}, {_islands("worker")},
        t AS (SELECT worker_id % 8 AS worker, count(*) FILTER (ok) AS rows, CAST(sum(prompt_tok + completion_tok) AS BIGINT) AS tokens,
                     CAST(sum(nanos) AS BIGINT) AS nanos FROM used GROUP BY 1),
        r AS (SELECT *, busy / 1e6 AS sec FROM t JOIN islands USING (worker)),
        f AS (SELECT worker, tokens, {_RATES} FROM r)
        SELECT worker AS worker_id, rows_per_sec AS Rows_Per_Sec, tokens_per_sec AS Tokens_Per_Sec,
               avg_tokens_per_row AS Avg_Tokens_Per_Row, tokens AS Tokens_Total FROM f""",
    "part_number": f"""{_PLACED}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, (pos_in_worker - 1) // 50 + 1 AS part, count(*) AS rows,
               min(RowID) AS first_id, max(RowID) AS last_id FROM placed GROUP BY 1, 2""",
    "progress_points": f"""{_PLACED},
        t AS (SELECT worker_id, count(*) AS total FROM placed GROUP BY worker_id),
        b AS (SELECT worker_id, batch_id, max(pos_in_worker) AS done FROM placed GROUP BY 1, 2)
        SELECT CAST(worker_id AS INTEGER) AS worker_id, batch_id, done, total FROM b JOIN t USING (worker_id)
        WHERE done % greatest(10, total // 20) = 0 OR done = total""",
    "category_counts": """
        WITH j AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey),
        l AS (SELECT 'o_orderkey' AS "column", CAST(o_orderkey AS VARCHAR) AS value FROM j
              UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM j
              UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM j
              UNION ALL SELECT 'c_name', c_name FROM j
              UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM j
              UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM j),
        c AS (SELECT "column", value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)
        SELECT * FROM c WHERE "column" IN (SELECT "column" FROM c GROUP BY "column" HAVING count(*) < 50)""",
    "analytics_long": """
        SELECT 'oorderstatus_' || o_orderstatus AS metric, count(*) AS n FROM orders GROUP BY 1
        UNION ALL SELECT 'oorderpriority_' || replace(replace(o_orderpriority, ' ', '_'), '-', '_'), count(*)
        FROM orders GROUP BY 1""",
    "analytics_wide": f"""
        SELECT 'run1' AS run_id, 'echo' AS model, {BATCH} AS batch_size, 7 AS api_calls, count(*) AS total_rows,
               count(*) FILTER (o_orderpriority = '1-URGENT') AS oorderpriority_1_URGENT,
               count(*) FILTER (o_orderpriority = '2-HIGH') AS oorderpriority_2_HIGH,
               count(*) FILTER (o_orderpriority = '3-MEDIUM') AS oorderpriority_3_MEDIUM,
               count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS oorderpriority_4_NOT_SPECIFIED,
               count(*) FILTER (o_orderpriority = '5-LOW') AS oorderpriority_5_LOW,
               count(*) FILTER (o_orderstatus = 'F') AS oorderstatus_F,
               count(*) FILTER (o_orderstatus = 'O') AS oorderstatus_O,
               count(*) FILTER (o_orderstatus = 'P') AS oorderstatus_P, CAST(0 AS BIGINT) AS error_count
        FROM orders""",
    "error_cells": """
        SELECT CAST(sum(2 * CAST(event_type = 'error' AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER)) AS BIGINT)
               AS error_count FROM events""",
}
