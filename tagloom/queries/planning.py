"""Sources, positions, ranges and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches, position, ranges
from ..session import work_folder
from ..sources.messages import read_messages as read_message_file
from ..sources.messages import read_queue as read_queue_files
from ..sources.parts import write_output
from .common import BATCH, MESSAGES_SQL, WORKERS, as_messages, messages, placed, placed_sql, table

PLACED = f"WITH {MESSAGES_SQL}, {placed_sql()}"
TINY = 2000


def manual(n: int) -> list[tuple[int, int]]:
    """Ranges over ``n`` rows: all of them, three with a gap and an overlap, and thousands of tiny ones over the whole table."""
    step = max(1, n // TINY)
    wide = [(1, n), (1, n // 5), (n // 4, n // 2), (n // 3, n)]
    return wide + [(i * step + 1, i * step + 3) for i in range(TINY)]


def read_messages(spark, sf_dir):
    """Documents through a CSV file with quotes and line breaks, and back."""
    path = work_folder(spark, "messages") + ".csv"
    write_output(messages(spark, sf_dir), path)
    text = F.col("Message")
    return read_message_file(spark, path).select(
        "RowID", "Title", "Sentiment", F.length(text).alias("message_len"), F.md5(text).alias("message_md5"))


def read_queue(spark, sf_dir):
    """One file per language and one that is not there."""
    folder = work_folder(spark, "queue")
    docs = table(spark, sf_dir, "documents")
    as_messages(docs, "lang").write.partitionBy("lang").parquet(folder)
    # One entry per language that the table has, as many as there are files.
    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    queue = [(f"{folder}/lang={lang}", lang) for lang in langs] + [(f"{folder}/lang=xx", "none")]
    rows, status = read_queue_files(spark, queue)
    counts = rows.groupBy("label").agg(F.count("*").alias("rows"), F.sum("RowID").alias("id_sum"))
    return status.select("label", "status").join(counts, "label", "left")


def row_position(spark, sf_dir):
    return position.with_position(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def slice_position(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return position.slice_by_position(orders, "o_orderkey", 101, 5000)


def slice_id(spark, sf_dir):
    return position.slice_by_id(table(spark, sf_dir, "labels"), 100, 600, "doc_id")


def position_sparse(spark, sf_dir):
    """Ids with gaps, over many ranges."""
    return position.with_position(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", partitions=32)


def position_hot_keys(spark, sf_dir):
    """Line items in the order of a flag with three values: each flag's positions, over many ranges."""
    placed = position.with_position(table(spark, sf_dir, "lineitem"), "l_returnflag", partitions=32)
    at = F.col("position")
    return placed.groupBy("l_returnflag").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("rows"), F.sum(at).cast("double").alias("position_sum"))


def assign_row_id(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_name", "c_acctbal")
    return position.assign_row_id(customers, "c_name", start=501)


def plan_ranges(spark, sf_dir):
    return ranges.plan_ranges(table(spark, sf_dir, "documents"), 7)


def _orders(spark, sf_dir):
    """Positions of all orders, and ranges over them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    stats = position.key_stats(orders, "o_orderkey")
    return position.with_position(orders, "o_orderkey", stats=stats), manual(stats.rows)


def plan_manual(spark, sf_dir):
    """User ranges with gaps and overlaps, and the orders in each."""
    orders, given = _orders(spark, sf_dir)
    counts = ranges.range_join(orders, given).groupBy("worker_id").agg(F.count("*").alias("rows"))
    checked = ranges.check_ranges(ranges.plan_manual(spark, given))
    return checked.join(counts, "worker_id", "left").fillna(0, ["rows"])


def preview_plan(spark, sf_dir):
    queue = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    return ranges.preview_plan(queue, WORKERS)


def assign_worker(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    stats = position.key_stats(orders, "o_orderkey")
    numbered = position.with_position(orders, "o_orderkey", stats=stats)
    return ranges.assign_worker(numbered, stats.rows, 8).drop("position")


def range_join(spark, sf_dir):
    orders, given = _orders(spark, sf_dir)
    return ranges.range_join(orders, given).select("o_orderkey", "worker_id", "pos_in_worker")


def chunk_batches(spark, sf_dir):
    rows = placed(as_messages(table(spark, sf_dir, "documents")))
    return rows.select("RowID", "worker_id", "batch_id", "pos")


def estimate_calls(spark, sf_dir):
    return batches.estimate_calls(placed(as_messages(table(spark, sf_dir, "documents"))), BATCH)


_MANUAL = f"""n AS (SELECT count(*) AS n FROM orders),
        r AS (SELECT 1 AS worker_id, 1 AS s, n AS e FROM n UNION ALL SELECT 2, 1, n // 5 FROM n
              UNION ALL SELECT 3, n // 4, n // 2 FROM n UNION ALL SELECT 4, n // 3, n FROM n
              UNION ALL SELECT 5 + i, i * greatest(1, n // {TINY}) + 1, i * greatest(1, n // {TINY}) + 3 FROM n, range({TINY}) t(i))"""
_EVEN = """
  w, CASE WHEN w <= n % {k} THEN (w - 1) * (n // {k} + 1) ELSE (w - 1) * (n // {k}) + n % {k} END + 1 AS s,
  n // {k} + CASE WHEN w <= n % {k} THEN 1 ELSE 0 END AS size"""

QUERIES = {f.__name__: f for f in (
    read_messages, read_queue, row_position, position_sparse, position_hot_keys, slice_position, slice_id, assign_row_id, plan_ranges, plan_manual,
    preview_plan, assign_worker, range_join, chunk_batches, estimate_calls)}

ORACLES = {
    "read_messages": f"""WITH {MESSAGES_SQL}
        SELECT RowID, Title, Sentiment, CAST(length(Message) AS INTEGER) AS message_len, md5(Message) AS message_md5
        FROM messages""",
    "read_queue": """
        SELECT lang AS label, 'found' AS status, count(*) AS rows, CAST(sum(doc_id + 1) AS BIGINT) AS id_sum
        FROM documents GROUP BY lang
        UNION ALL SELECT 'none', 'file_not_found', NULL, NULL""",
    "row_position": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders",
    "position_sparse": "SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) AS position FROM labels",
    "position_hot_keys": """SELECT l_returnflag, min(p) AS first, max(p) AS last, count(*) AS rows, CAST(sum(p) AS DOUBLE) AS position_sum
        FROM (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS p FROM lineitem) GROUP BY l_returnflag""",
    "slice_position": """SELECT o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p BETWEEN 101 AND 5000""",
    "slice_id": "SELECT doc_id, quality, toxic FROM labels WHERE doc_id >= 100 AND doc_id <= 600",
    "assign_row_id": """
        SELECT c_name, c_acctbal, row_number() OVER (ORDER BY c_name) + 500 AS RowID FROM customer""",
    "plan_ranges": f"""SELECT CAST(w AS INTEGER) AS worker_id, s AS start, s + size - 1 AS "end" FROM (
        SELECT {_EVEN.format(k=7)} FROM (SELECT count(*) AS n FROM documents), range(1, 8) t(w))""",
    "plan_manual": f"""WITH {_MANUAL},
        o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS p FROM orders),
        c AS (SELECT worker_id, count(*) AS n FROM r JOIN o ON p BETWEEN s AND e GROUP BY worker_id),
        l AS (SELECT *, s - coalesce(lag(e) OVER (ORDER BY s, worker_id), 0) - 1 AS step FROM r)
        SELECT CAST(worker_id AS INTEGER) AS worker_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end",
               CAST(greatest(step, 0) AS BIGINT) AS gap, CAST(greatest(-step, 0) AS BIGINT) AS overlap,
               coalesce(n, 0) AS rows
        FROM l LEFT JOIN c USING (worker_id)""",
    "preview_plan": f"""
        SELECT label, CAST(w AS INTEGER) AS worker_id, s AS start, s + size - 1 AS "end", size AS rows FROM (
        SELECT label, {_EVEN.format(k=WORKERS)}
        FROM (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), range(1, {WORKERS + 1}) t(w))""",
    "assign_worker": """
        SELECT o_orderkey, CAST(worker_id AS INTEGER) AS worker_id,
               row_number() OVER (PARTITION BY worker_id ORDER BY o_orderkey) AS pos_in_worker
        FROM (SELECT o_orderkey, ntile(8) OVER (ORDER BY o_orderkey) AS worker_id FROM orders)""",
    "range_join": f"""WITH {_MANUAL}, o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders)
        SELECT o_orderkey, CAST(worker_id AS INTEGER) AS worker_id, p - s + 1 AS pos_in_worker
        FROM o JOIN r ON p BETWEEN s AND e""",
    "chunk_batches": f"{PLACED} SELECT RowID, CAST(worker_id AS INTEGER) AS worker_id, batch_id, pos FROM placed",
    "estimate_calls": f"""{PLACED}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, count(*) AS rows, count(DISTINCT batch_id) AS calls
        FROM placed GROUP BY worker_id""",
}
