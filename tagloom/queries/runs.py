"""Run tables: status, manifest, roll-ups, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import output_name
from ..operators import ranges, resume, runs
from ..session import work_folder
from ..sources import ledger
from .common import STATUS_SQL, status_events, table


def _latest(spark, sf_dir):
    """Latest status per worker, over all runs."""
    return runs.status_latest(status_events(spark, sf_dir), ("worker_id",))


def status_latest(spark, sf_dir):
    latest = runs.status_latest(status_events(spark, sf_dir))
    return latest.select("run_id", "worker_id", "state", "rows_processed", "event_id", "last_error")


def read_status(spark, sf_dir):
    """Newest status of every run and file, written as one JSON file each and read back."""
    path = work_folder(spark, "status")
    latest = runs.status_latest(status_events(spark, sf_dir), ("run_id", "label"))
    latest = latest.withColumn("updated_at", F.col("updated_at").cast("string"))
    latest.write.option("maxRecordsPerFile", 1).json(path)
    return ledger.read_status(spark, path, "part-*.json").select(
        "worker_id", "run_id", "state", "rows_processed", "total_rows", "last_error", "output_file")


def _entries(spark, sf_dir):
    """Events as manifest log entries of forty files."""
    number = (F.col("worker_id") % 40).cast("string")
    return status_events(spark, sf_dir).withColumn("label", F.concat(F.lit("f"), number))


def manifest_entries(spark, sf_dir):
    """Entries of one file per language, with four ranges each."""
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    queue = docs.distinct().withColumn("input_file", F.concat(F.lit("in_"), F.col("label")))
    entries = runs.file_entries(queue, ranges.plan_ranges(docs, 4, ["label"]), "{project}_{label}", project=F.lit("p"))
    shown = F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"]))
    return entries.select("label", "input_file", "status", F.array_join(shown, "|").alias("ranges"),
                          F.array_join("expected_outputs", "|").alias("expected_outputs"))


def manifest_upsert(spark, sf_dir):
    entries = _entries(spark, sf_dir).select(
        "run_id", "label", "event_id", F.col("state").alias("status"), "output_file")
    return runs.upsert_run_file(entries, order=("event_id",))


def manifest_patch(spark, sf_dir):
    merged = F.when(F.col("state") == "completed", F.col("output_file"))
    patches = _entries(spark, sf_dir).select(
        "run_id", "label", "event_id", F.col("state").alias("status"), merged.alias("merged_output"))
    return runs.patch_run_file(patches, order="event_id")


def failed_ranges(spark, sf_dir):
    """Failed workers with their range of the documents, appended to a ledger and read back."""
    planned = ranges.plan_ranges(table(spark, sf_dir, "documents"), 120)
    failed = runs.failed_ranges(_latest(spark, sf_dir), planned)
    path = work_folder(spark, "failed-ranges")
    ledger.append_failed_ranges(failed, "run1", path)
    return spark.read.parquet(path)


def _planned(spark, sf_dir):
    """One planned worker per customer, in the run and file in which a user of that number reports; only some ever do."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("worker_id"), F.concat(F.lit("run"), (key % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("file"), (key % 4).cast("string")).alias("label"))


def all_done(spark, sf_dir):
    return runs.all_done(_planned(spark, sf_dir), runs.status_latest(status_events(spark, sf_dir)), ("run_id", "label"))


def _repeated(spark, sf_dir):
    """Status events in which every file numbers its workers from 0 to 4."""
    return status_events(spark, sf_dir).withColumn("worker_id", F.col("worker_id") % 5)


def status_latest_files(spark, sf_dir):
    latest = runs.status_latest(_repeated(spark, sf_dir))
    return latest.select("run_id", "label", "worker_id", "state", "event_id")


def all_done_files(spark, sf_dir):
    """Seven workers planned in every file and run; five of them report."""
    latest = runs.status_latest(_repeated(spark, sf_dir))
    planned = latest.select("run_id", "label").distinct().withColumn("worker_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return runs.all_done(planned, latest, ("run_id", "label"))


def failed_ranges_files(spark, sf_dir):
    """Ranges of ten rows, at another place in every file."""
    latest = runs.status_latest(_repeated(spark, sf_dir))
    start = F.col("worker_id") * 10 + F.substring("label", 5, 9).cast("long") * 1000 + 1
    planned = latest.select("run_id", "label", "worker_id", start.alias("start"), (start + 9).alias("end"))
    return runs.failed_ranges(latest, planned)


def progress_eta(spark, sf_dir):
    figures = runs.with_progress(_latest(spark, sf_dir))
    return figures.select("worker_id", "progress_pct", "worker_eta", "monitor_eta")


def _rollup(spark, sf_dir):
    return runs.run_rollup(_latest(spark, sf_dir))


def run_rollup(spark, sf_dir):
    lists = [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in ("successful", "failed", "output_files")]
    return _rollup(spark, sf_dir).select("label", "total_rows", "total_errors", *lists)


def merge_gate(spark, sf_dir):
    rollup = _rollup(spark, sf_dir)
    gates = [runs.merge_gate(rollup, c).select("label", F.lit(c).alias("condition"), "merge")
             for c in ("all_success", "any_success", "always", "never_heard_of")]
    return gates[0].unionByName(gates[1]).unionByName(gates[2]).unionByName(gates[3])


def final_summary(spark, sf_dir):
    return runs.final_summary(_rollup(spark, sf_dir))


def run_summary(spark, sf_dir):
    """Totals of each run, from the latest status of its workers."""
    latest = runs.status_latest(status_events(spark, sf_dir))
    totals = latest.groupBy("run_id").agg(
        F.sum("rows_processed").alias("processed_rows"), F.sum("total_rows").alias("total_rows"),
        F.count_if(F.col("state") != "initializing").alias("api_calls"),
        F.count_if(F.col("state") == "failed").alias("errors"), F.count_if(F.col("state") == "completed").alias("parts"),
        (F.sum(F.round(F.col("elapsed_sec") * 100).cast("long")) / 100).alias("total_sec"))
    return runs.run_summary(totals)


def _order_files(spark, sf_dir):
    """Orders as planned files with one to three expected worker outputs each."""
    key = F.col("o_orderkey")
    workers = F.sequence(F.lit(1), (key % 3 + 1).cast("int"))
    fields = {"run_id": F.lit("r"), "label": key.cast("string")}
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("label"), status.alias("status"), F.concat(F.lit("in_"), key.cast("string")).alias("input_file"),
        F.transform(workers, lambda w: F.struct(w.alias("worker_id"))).alias("ranges"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("out_"), key.cast("string"))).alias("merged_output"),
        F.transform(workers, lambda w: output_name("{run_id}_{label}", w, **fields)).alias("expected_outputs"))


def _order_listing(spark, sf_dir):
    """Files found: one per line item."""
    fields = {"run_id": F.lit("r"), "label": F.col("l_orderkey")}
    return table(spark, sf_dir, "lineitem").select(
        output_name("{run_id}_{label}", F.col("l_linenumber"), **fields).alias("path"))


def missing_outputs(spark, sf_dir):
    return runs.missing_outputs(_order_files(spark, sf_dir), _order_listing(spark, sf_dir))


def manifest_summary(spark, sf_dir):
    return runs.manifest_summary(_order_files(spark, sf_dir), _order_listing(spark, sf_dir))


def unplanned_files(spark, sf_dir):
    """Nations without a rich customer, as files the manifest does not know."""
    queue = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("label"), F.col("n_name").alias("input_file"))
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("label"))
    return runs.unplanned_files(queue, known)


def resume_files(spark, sf_dir):
    """Files of the status log: completed ones are skipped, others use their stored ranges or new ones."""
    latest, events = _latest(spark, sf_dir), status_events(spark, sf_dir)
    name = F.col("worker_id").cast("string")
    one = F.struct(F.lit(1).cast("long").alias("start"), F.col("rows_processed").alias("end"))
    stored = F.when(F.col("event_id") % 2 == 0, F.array(one))
    files = latest.select(name.alias("label"), F.concat(F.lit("in_"), name).alias("input_file"),
                          F.col("state").alias("status"), stored.alias("ranges"))
    listing = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.concat(F.lit("in_"), F.col("c_custkey").cast("string")).alias("input_file"))
    planned = ranges.plan_ranges(events.withColumnRenamed("worker_id", "owner"), 2, ["owner"])
    plan = planned.groupBy(F.col("owner").cast("string").alias("label")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    left = resume.resume_files(files, listing, plan)
    shown = F.transform("ranges", lambda r: F.concat_ws("-", r["start"], r["end"]))
    return left.select("label", "action", F.array_join(shown, "|").alias("ranges"))


_WITH = f"WITH {STATUS_SQL}"
_PER_RUN = f"""{_WITH}, per_run AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, worker_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM status)
    WHERE rn = 1)"""
_ENTRIES = f"""{_WITH}, e AS (SELECT * REPLACE ('f' || (worker_id % 40) AS label),
    CASE WHEN state = 'completed' THEN output_file END AS merged_output FROM status)"""
_ROLL = f"""{_WITH}, roll AS (
    SELECT label, CAST(coalesce(sum(rows_processed) FILTER (state = 'completed'), 0) AS BIGINT) AS total_rows,
           count(*) FILTER (state = 'completed') AS good, count(*) FILTER (state = 'failed') AS bad,
           count(*) FILTER (state = 'completed' AND output_file IS NOT NULL) AS outs,
           coalesce(string_agg(CAST(worker_id AS VARCHAR), '|' ORDER BY worker_id) FILTER (state = 'completed'), '')
             AS successful,
           coalesce(string_agg(CAST(worker_id AS VARCHAR), '|' ORDER BY worker_id) FILTER (state = 'failed'), '')
             AS failed,
           coalesce(string_agg(output_file, '|' ORDER BY output_file) FILTER (state = 'completed'), '') AS output_files
    FROM latest GROUP BY label)"""
_FILES = """files AS (
    SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS label, o_orderstatus AS st, o_orderkey % 3 + 1 AS n FROM orders),
expected AS (SELECT k, label, st, w FROM files, range(1, 4) t(w) WHERE w <= n),
gone AS (SELECT label, w, concat('r_', label, '_w', w, '.csv') AS path FROM expected
         WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = k AND l_linenumber = w))"""

QUERIES = {f.__name__: f for f in (
    status_latest, read_status, manifest_entries, manifest_upsert, manifest_patch, failed_ranges, all_done,
    status_latest_files, all_done_files, failed_ranges_files, progress_eta, run_rollup, merge_gate,
    final_summary, run_summary, missing_outputs, manifest_summary, unplanned_files, resume_files)}

_REPEATED = f"""WITH {STATUS_SQL}, w AS (SELECT * EXCLUDE (worker_id), worker_id % 5 AS worker_id FROM status),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, label, worker_id
                                                      ORDER BY updated_at DESC, event_id DESC) AS rn FROM w) WHERE rn = 1)"""

ORACLES = {
    "status_latest_files": f"{_REPEATED} SELECT run_id, label, worker_id, state, event_id FROM newest",
    "all_done_files": f"""{_REPEATED}, planned AS (
          SELECT run_id, label, worker_id FROM (SELECT DISTINCT run_id, label FROM newest), range(0, 7) t(worker_id))
        SELECT run_id, label, bool_and(coalesce(state IN ('completed', 'failed'), false)) AS all_done, count(*) AS workers,
               count(*) FILTER (state IN ('completed', 'failed')) AS finished
        FROM planned LEFT JOIN newest USING (run_id, label, worker_id) GROUP BY run_id, label""",
    "failed_ranges_files": f"""{_REPEATED}
        SELECT worker_id, label, worker_id * 10 + CAST(substr(label, 5) AS BIGINT) * 1000 + 1 AS start,
               worker_id * 10 + CAST(substr(label, 5) AS BIGINT) * 1000 + 10 AS "end",
               coalesce(last_error, 'Unknown error') AS error FROM newest WHERE state = 'failed'""",
    "status_latest": f"""{_PER_RUN}
        SELECT run_id, worker_id, state, rows_processed, event_id, last_error FROM per_run""",
    "read_status": f"""{_WITH}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, run_id, state, rows_processed, CAST(total_rows AS BIGINT) AS total_rows,
               last_error, output_file FROM (
          SELECT *, row_number() OVER (PARTITION BY run_id, label ORDER BY updated_at DESC, event_id DESC) AS rn FROM status)
        WHERE rn = 1""",
    "manifest_entries": """
        WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang),
        r AS (SELECT label, w, CASE WHEN w <= n % 4 THEN (w - 1) * (n // 4 + 1) ELSE (w - 1) * (n // 4) + n % 4 END + 1 AS s,
                     n // 4 + CASE WHEN w <= n % 4 THEN 1 ELSE 0 END AS size FROM c, range(1, 5) t(w))
        SELECT label, 'in_' || label AS input_file, 'pending' AS status,
               string_agg(concat(s, '-', s + size - 1), '|' ORDER BY w) AS ranges,
               string_agg(concat('p_', label, '_w', w, '.csv'), '|' ORDER BY w) AS expected_outputs
        FROM r GROUP BY label""",
    "manifest_upsert": f"""{_ENTRIES}
        SELECT run_id, label, max(event_id) AS event_id, arg_max(state, event_id) AS status,
               arg_max_null(output_file, event_id) AS output_file FROM e GROUP BY run_id, label""",
    "manifest_patch": f"""{_ENTRIES}
        SELECT run_id, label, arg_max(state, event_id) AS status,
               arg_max(merged_output, event_id) FILTER (merged_output IS NOT NULL) AS merged_output,
               max(event_id) AS last_updated FROM e GROUP BY run_id, label""",
    "failed_ranges": f"""{_WITH}, n AS (SELECT count(*) AS n FROM documents)
        SELECT worker_id, label, s AS start, s + n // 120 + CASE WHEN w <= n % 120 THEN 1 ELSE 0 END - 1 AS "end",
               coalesce(last_error, 'Unknown error') AS error, 'run1' AS run_id
        FROM latest LEFT JOIN (SELECT w, n, (w - 1) * (n // 120) + least(w - 1, n % 120) + 1 AS s
                               FROM n, range(1, 121) t(w)) ON w = worker_id
        WHERE state = 'failed'""",
    "all_done": f"""{_WITH},
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, label, worker_id
                                                          ORDER BY updated_at DESC, event_id DESC) AS rn FROM status) WHERE rn = 1),
        p AS (SELECT c_custkey AS worker_id, 'run' || (c_custkey % 3) AS run_id, 'file' || (c_custkey % 4) AS label FROM customer),
        f AS (SELECT run_id, label, coalesce(state IN ('completed', 'failed'), false) AS fin
              FROM p LEFT JOIN n USING (run_id, label, worker_id))
        SELECT run_id, label, bool_and(fin) AS all_done, count(*) AS workers, count(*) FILTER (fin) AS finished
        FROM f GROUP BY run_id, label""",
    "progress_eta": f"""{_WITH}
        SELECT worker_id, round(rows_processed / 100 * 100, 1) AS progress_pct,
               CASE WHEN rows_processed > 0
                    THEN round(elapsed_sec / rows_processed * (100 - rows_processed), 4) END AS worker_eta,
               CASE WHEN rows_processed > 0
                    THEN round(elapsed_sec / rows_processed * (100 - rows_processed), 4) ELSE 0 END AS monitor_eta
        FROM latest""",
    "run_rollup": f"""{_ROLL}
        SELECT label, total_rows, bad AS total_errors, successful, failed, output_files FROM roll""",
    "merge_gate": f"""{_ROLL}
        SELECT label, c AS condition, outs > 0 AND CASE c WHEN 'all_success' THEN bad = 0 WHEN 'any_success' THEN good > 0
               WHEN 'always' THEN true ELSE false END AS merge
        FROM roll, (VALUES ('all_success'), ('any_success'), ('always'), ('never_heard_of')) t(c)""",
    "final_summary": f"""{_ROLL}
        SELECT label, CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(bad) AS BIGINT) AS failed_workers,
               count(*) AS files FROM roll GROUP BY ROLLUP (label)""",
    "run_summary": f"""{_PER_RUN}, t AS (
          SELECT run_id, CAST(sum(rows_processed) AS BIGINT) AS processed_rows, CAST(sum(total_rows) AS BIGINT) AS total_rows,
                 count(*) FILTER (state <> 'initializing') AS api_calls, count(*) FILTER (state = 'failed') AS errors,
                 count(*) FILTER (state = 'completed') AS parts,
                 CAST(sum(CAST(round(elapsed_sec * 100) AS BIGINT)) AS BIGINT) / 100 AS total_sec
          FROM per_run GROUP BY run_id)
        SELECT *, CASE WHEN processed_rows > 0 THEN round(total_sec / processed_rows, 4) END AS sec_per_row,
               CASE WHEN api_calls > 0 THEN round(total_sec / api_calls, 4) END AS sec_per_call,
               processed_rows = total_rows AS complete FROM t""",
    "missing_outputs": f"WITH {_FILES} SELECT label, path FROM gone",
    "manifest_summary": f"""WITH {_FILES}, m AS (SELECT label, count(*) AS m FROM gone GROUP BY label)
        SELECT label, CASE st WHEN 'F' THEN 'completed' ELSE 'pending' END AS status, 'in_' || label AS input_file,
               CAST(n AS INTEGER) AS n_ranges, CASE WHEN st = 'F' THEN 'out_' || label END AS merged_output,
               CASE WHEN st <> 'F' THEN CAST(n AS INTEGER) END AS expected,
               CASE WHEN st <> 'F' THEN CAST(coalesce(m, 0) AS INTEGER) END AS missing
        FROM files LEFT JOIN m USING (label)""",
    "unplanned_files": """
        SELECT n_nationkey AS label, n_name AS input_file, 'pending' AS status FROM nation
        WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""",
    "resume_files": f"""{_WITH},
        n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
        p AS (SELECT user_id, CASE WHEN n = 1 THEN '1-1|2-1' ELSE
                concat('1-', n // 2 + n % 2, '|', n // 2 + n % 2 + 1, '-', n) END AS planned FROM n)
        SELECT CAST(worker_id AS VARCHAR) AS label,
               CASE WHEN c_custkey IS NULL THEN 'input_missing' ELSE 'process' END AS action,
               CASE WHEN c_custkey IS NULL THEN NULL WHEN event_id % 2 = 0 THEN concat('1-', rows_processed)
                    ELSE planned END AS ranges
        FROM latest LEFT JOIN p ON user_id = worker_id
             LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = worker_id
        WHERE state <> 'completed'""",
}
