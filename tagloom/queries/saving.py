"""Parts, outputs, merging and resuming."""

from __future__ import annotations

from datetime import datetime

from pyarrow import fs
from pyspark.sql import functions as F

from ..operators import batches, merge, resume
from ..session import work_folder
from ..sources import ledger, messages, parts
from ..sources.checked import checked_parts, write_checked_parts
from ..sources.ordered import merge_sorted as merge_files
from ..sources.ordered import write_sorted
from .common import BATCH, INTERVAL, MESSAGES_SQL, as_messages, placed, placed_sql, table
from .text import RUN_ID_SQL, run_ids


def _coded(spark, sf_dir):
    rows = batches.part_number(placed(as_messages(table(spark, sf_dir, "documents"), "lang")), BATCH, INTERVAL)
    return rows.select("RowID", F.col("lang").alias("Topic"), "worker_id", "part", "pos_in_worker")


def write_parts(spark, sf_dir):
    """Every part saved, one of the workers saved a second time, and all read back."""
    path = work_folder(spark, "parts")
    rows = _coded(spark, sf_dir)
    parts.write_parts(rows, path, "run1", "docs", parts_per_folder=20)
    parts.write_parts(rows.filter("worker_id = 2"), path, "run1", "docs", parts_per_folder=20)
    return parts.read_parts(spark, path, "run1", "docs").groupBy("worker_id", "part").agg(
        F.count("*").alias("rows"), F.sum("RowID").alias("id_sum"))


def merge_parts(spark, sf_dir):
    path = work_folder(spark, "parts")
    parts.write_parts(_coded(spark, sf_dir), path, "run1", "docs", parts_per_folder=20)
    return parts.merged_parts(spark, path, "run1", "docs").select(
        "RowID", "Topic", "worker_id", "part", "pos_in_worker", "run_id", "label")


def parts_with_damage(spark, sf_dir):
    """Parts of which one file was cut off and one was lost: what is left, and why the rest was left out."""
    path = work_folder(spark, "parts")
    write_checked_parts(_coded(spark, sf_dir), path, "run1", "docs", parts_per_folder=2)
    harm(path, "run_id=run1/label=docs/worker_id=2/part_group=0", lambda whole: whole[:len(whole) // 2])
    harm(path, "run_id=run1/label=docs/worker_id=3/part_group=1", None)
    rows, notices = checked_parts(spark, path, "run1", "docs")
    left = rows.groupBy("worker_id", "part_group").agg(F.count("*").alias("rows"), F.sum("RowID").alias("id_sum"))
    return notices.join(left, ["worker_id", "part_group"], "left").select(
        "worker_id", "part_group", "state", "rows_wanted", "rows", "id_sum")


def harm(path, folder, change):
    """Rewrite the files of one folder by ``change``, or delete them, as a broken disk would."""
    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    for file in system.get_file_info(fs.FileSelector(f"{place}/{folder}")):
        if file.path.endswith(".parquet"):
            with system.open_input_stream(file.path) as stream:
                whole = stream.read()
            system.delete_file(file.path)
            if change is not None:
                with system.open_output_stream(file.path) as stream:
                    stream.write(change(whole))


def record_run(spark, sf_dir):
    """A run per region is recorded twice: the first entry stays."""
    path = work_folder(spark, "runs")
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        for model in ("echo", "other"):
            ledger.record_run(spark, path, {"run_id": f"run{r.r_regionkey}", "model_name": model}, {"region": r.r_name},
                              datetime(2024, 1, 1 + r.r_regionkey))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.groupBy("r_name").agg(F.count("*").alias("customers"))
    runs = spark.read.parquet(path).withColumn("region", F.get_json_object("config_snapshot", "$.region"))
    return runs.join(customers, F.col("region") == F.col("r_name"), "left").select(
        "run_id", "model_name", "region", "customers", F.date_format("started_at", "yyyy-MM-dd").alias("started"))


def require_columns(spark, sf_dir):
    """Documents without title and sentiment as messages: the missing optional columns are added."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("RowID"), F.col("text").alias("Message"), "lang")
    return messages.require_columns(rows).select(
        "RowID", F.length("Message").alias("n_chars"), "lang", F.col("Title").isNull().alias("no_title"), "Sentiment")


def write_output(spark, sf_dir):
    """Final CSV written and read back."""
    path = work_folder(spark, "output")
    parts.write_output(_coded(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path).select("RowID", "Topic", "part")


def merge_outputs(spark, sf_dir):
    """Orders of three workers put together, sorted by a column with many equal values."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    rows = placed(orders, "o_orderkey", workers=3)
    outputs = [rows.filter(F.col("worker_id") == w).select("worker_id", "pos_in_worker", "o_orderkey", *more)
               for w, more in ((1, ["o_orderpriority"]), (2, ["o_orderpriority", "o_totalprice"]),
                               (3, ["o_orderpriority", "o_orderstatus"]))]
    return merge.merge_outputs(outputs, "o_orderpriority")


def merge_sorted(spark, sf_dir):
    """Orders of three workers, each written as sorted files, in their merged order without another sort."""
    path = work_folder(spark, "sorted")
    rows = placed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey", workers=3)
    for w in (3, 1, 2):
        own = rows.filter(F.col("worker_id") == w).select("o_orderkey", *(["o_orderpriority"] if w < 3 else ["o_totalprice"]))
        write_sorted(own, f"{path}/outputs", f"worker {w}", ["o_orderkey"])
    return merge_files(spark, f"{path}/outputs", ["o_orderkey"], f"{path}/merged").select(
        "merged_pos", "o_orderkey", "o_orderpriority", "o_totalprice")


def merge_late(spark, sf_dir):
    """Urgent orders of the middle tenth of the customers' keys come late: only the files among which they fall are sorted again."""
    path = work_folder(spark, "late")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    high = rows.agg(F.max("o_custkey")).first()[0] or 0
    late = F.coalesce(F.col("o_custkey").between(high * 0.45, high * 0.55) & (F.col("o_orderpriority") == "1-URGENT"), F.lit(False))
    order = ["o_custkey", "o_orderkey"]
    for name, some in (("on time", ~late), ("late", late)):
        write_sorted(rows.filter(some).withColumn("late", F.lit(name == "late")), f"{path}/outputs", name, order)
    return merge_files(spark, f"{path}/outputs", order, f"{path}/merged")


def resume_high_water(spark, sf_dir):
    """Labelled documents of the lower half as saved rows of a run that broke off; what follows the last of them is left."""
    labels = table(spark, sf_dir, "labels")
    half = labels.agg(F.max("doc_id") / 2).first()[0]
    saved = labels.filter(F.col("doc_id") < half).select((F.col("doc_id") + 1).alias("RowID"))
    saved = batches.part_number(placed(saved, workers=1), BATCH, INTERVAL)
    return resume.resume_high_water(as_messages(table(spark, sf_dir, "documents")), saved).select("RowID")


def resume_missing(spark, sf_dir):
    saved = table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("RowID"))
    rows = as_messages(table(spark, sf_dir, "documents")).select("RowID", "Title")
    return resume.resume_missing(rows, saved)


def latest_run(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return resume.latest_run(orders.select(run_ids(orders).alias("run_id")))


_PLACED = f"WITH {MESSAGES_SQL}, {placed_sql()}"
_THREE = placed_sql("orders", "o_orderkey", 3)

QUERIES = {f.__name__: f for f in (
    write_parts, merge_parts, parts_with_damage, record_run, require_columns, write_output, merge_outputs, merge_sorted, merge_late,
    resume_high_water, resume_missing, latest_run)}

ORACLES = {
    "write_parts": f"""{_PLACED}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, (pos_in_worker - 1) // 50 + 1 AS part, count(*) AS rows,
               CAST(sum(RowID) AS BIGINT) AS id_sum FROM placed GROUP BY 1, 2""",
    "merge_parts": f"""{_PLACED}
        SELECT RowID, lang AS Topic, CAST(worker_id AS INTEGER) AS worker_id, (pos_in_worker - 1) // 50 + 1 AS part,
               pos_in_worker, 'run1' AS run_id, 'docs' AS label FROM placed""",
    "parts_with_damage": f"""{_PLACED},
        g AS (SELECT CAST(worker_id AS INTEGER) AS worker_id, CAST((pos_in_worker - 1) // 100 AS INTEGER) AS part_group,
                     count(*) AS n, CAST(sum(RowID) AS BIGINT) AS ids FROM placed GROUP BY 1, 2),
        s AS (SELECT *, CASE WHEN worker_id = 2 AND part_group = 0 THEN 'damaged'
                             WHEN worker_id = 3 AND part_group = 1 THEN 'missing' ELSE 'good' END AS state FROM g)
        SELECT worker_id, part_group, state, n AS rows_wanted, CASE WHEN state = 'good' THEN n END AS rows,
               CASE WHEN state = 'good' THEN ids END AS id_sum FROM s""",
    "record_run": """
        SELECT 'run' || r_regionkey AS run_id, 'echo' AS model_name, r_name AS region,
               nullif(count(c_custkey), 0) AS customers,
               strftime(DATE '2024-01-01' + CAST(r_regionkey AS INTEGER), '%Y-%m-%d') AS started
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
        GROUP BY r_regionkey, r_name""",
    "require_columns": """
        SELECT doc_id + 1 AS RowID, CAST(length(text) AS INTEGER) AS n_chars, lang, true AS no_title, CAST(NULL AS VARCHAR) AS Sentiment
        FROM documents""",
    "write_output": f"""{_PLACED}
        SELECT CAST(RowID AS VARCHAR) AS RowID, lang AS Topic, CAST((pos_in_worker - 1) // 50 + 1 AS VARCHAR) AS part
        FROM placed""",
    "merge_outputs": f"""WITH {_THREE}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, pos_in_worker, o_orderkey, o_orderpriority,
               CASE WHEN worker_id = 2 THEN o_totalprice END AS o_totalprice,
               CASE WHEN worker_id = 3 THEN o_orderstatus END AS o_orderstatus
        FROM placed ORDER BY o_orderpriority, worker_id, pos_in_worker""",
    "merge_sorted": f"""WITH {_THREE}
        SELECT row_number() OVER (ORDER BY o_orderkey) AS merged_pos, o_orderkey,
               CASE WHEN worker_id < 3 THEN o_orderpriority END AS o_orderpriority,
               CASE WHEN worker_id = 3 THEN o_totalprice END AS o_totalprice FROM placed""",
    "merge_late": """
        SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS merged_pos,
               o_custkey >= 0.45 * (SELECT max(o_custkey) FROM orders) AND o_custkey <= 0.55 * (SELECT max(o_custkey) FROM orders)
               AND o_orderpriority = '1-URGENT' AS late
        FROM orders""",
    "resume_high_water": """
        SELECT doc_id + 1 AS RowID FROM documents
        WHERE doc_id > (SELECT max(doc_id) FROM labels WHERE doc_id < (SELECT max(doc_id) / 2.0 FROM labels))""",
    "resume_missing": """
        SELECT doc_id + 1 AS RowID, source AS Title FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "latest_run": f"SELECT max({RUN_ID_SQL}) AS run_id FROM orders",
}
