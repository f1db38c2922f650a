"""Run tables: worker status, roll-ups, manifest and summaries.

A status table is an append-only log. "Latest" is a max_by aggregation, which combines before the shuffle, so a worker
with very many events is no hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rates as R
from ..functions.text import output_name

# States and outcomes.
FINISHED = ("completed", "failed")
#: A worker's number is its own only within a run and a file.
WORKER_KEYS = ("run_id", "label", "worker_id")
NO_ERROR_TEXT = "Unknown error"


def latest_by(log: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The newest entry per key; ``order`` must be unique per key."""
    newest = F.max_by(F.struct(*keep), F.struct(*order)).alias("_newest")
    return log.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def worker_keys(*tables: DataFrame) -> list[str]:
    """Those of run, file and worker that all the tables have."""
    return [k for k in WORKER_KEYS if all(k in t.columns for t in tables)]


def status_latest(events: DataFrame, keys: Sequence[str] | None = None,
                  order: Sequence[str] = ("updated_at", "event_id")) -> DataFrame:
    """Newest status per worker; workers are told apart by run, file and number."""
    keys = keys or worker_keys(events)
    keep = [c for c in events.columns if c not in keys]
    return latest_by(events, keys, order, keep)


def upsert_run_file(entries: DataFrame, keys: Sequence[str] = ("run_id", "label"),
                    order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Manifest from its log: the entry written last replaces earlier ones with the same label."""
    keep = [c for c in entries.columns if c not in keys]
    return latest_by(entries, keys, order, keep)


def file_entries(queue: DataFrame, ranges: DataFrame, pattern: str, **fields: Column) -> DataFrame:
    """Manifest entries of planned files (label, input_file): pending, with their ranges and expected outputs.

    ``fields`` fill the naming pattern; ``label`` is the file's own. A file has one range per worker of the plan.
    """
    named = ranges.withColumn("_path", output_name(pattern, F.col("worker_id"), label=F.col("label"), **fields))
    one = F.struct("worker_id", "start", "end", "_path")
    listed = named.groupBy("label").agg(F.sort_array(F.collect_list(one)).alias("_r"))
    return queue.join(listed, "label", "left").select(
        "label", "input_file", F.lit("pending").alias("status"),
        F.transform("_r", lambda r: F.struct(r["worker_id"].alias("worker_id"), r["start"].alias("start"),
                                             r["end"].alias("end"))).alias("ranges"),
        F.col("_r._path").alias("expected_outputs"), F.lit(None).cast("string").alias("merged_output"))


def patch_run_file(patches: DataFrame, keys: Sequence[str] = ("run_id", "label"), order: str = "updated_at") -> DataFrame:
    """Manifest state after status patches: last status, and the last merged path that was given at all."""
    given = F.when(F.col("merged_output").isNotNull(), F.col(order))
    return patches.groupBy(*keys).agg(
        F.max_by("status", order).alias("status"),
        F.max_by("merged_output", given).alias("merged_output"),
        F.max(order).alias("last_updated"))


def with_progress(status: DataFrame) -> DataFrame:
    """Percentage done and remaining seconds; the worker's figure is NULL before its first row, the monitor's is 0."""
    eta = R.eta_seconds(F.col("elapsed_sec"), F.col("rows_processed"), F.col("total_rows"))
    return status.withColumns({
        "progress_pct": R.progress_pct(F.col("rows_processed"), F.col("total_rows")),
        "worker_eta": F.round(eta, 4),
        "monitor_eta": F.round(F.coalesce(eta, F.lit(0.0)), 4),
    })


def all_done(planned: DataFrame, status: DataFrame, by: Sequence[str] = ("label",),
             worker: str = "worker_id") -> DataFrame:
    """Whether every planned worker has completed or failed; one that never reported counts as not done.

    Both tables are matched by run, file and worker, as far as both have these.
    """
    keys = list(dict.fromkeys([*worker_keys(planned, status), worker]))
    joined = planned.join(status.select(*keys, "state"), keys, "left")
    finished = F.coalesce(F.col("state").isin(*FINISHED), F.lit(False))
    return joined.groupBy(*by).agg(F.bool_and(finished).alias("all_done"), F.count("*").alias("workers"),
                                   F.sum(finished.cast("long")).alias("finished"))


def run_rollup(status: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Per label, over the latest status of all its workers: good and failed workers, rows and outputs of the good ones.

    The lists have one entry per worker of the plan.
    """
    good, bad = F.col("state") == "completed", F.col("state") == "failed"

    def listed(value: Column, when: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(when, value)))

    return status.groupBy(*by).agg(
        listed(F.col("worker_id"), good).alias("successful"),
        listed(F.col("worker_id"), bad).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.coalesce("rows_processed", F.lit(0)))), F.lit(0)).alias("total_rows"),
        F.count_if(bad).alias("total_errors"),
        listed(F.nullif(F.col("output_file"), F.lit("")), good).alias("output_files"))


def failed_ranges(status: DataFrame, ranges: DataFrame, worker: str = "worker_id") -> DataFrame:
    """Failed workers with their planned range and error text, matched by run, file and worker as far as both have these."""
    keys = list(dict.fromkeys([*worker_keys(status, ranges), worker]))
    failed = status.filter(F.col("state") == "failed")
    joined = failed.join(ranges.select(*keys, "start", "end"), keys, "left")
    return joined.select(worker, "label", "start", "end", F.coalesce("last_error", F.lit(NO_ERROR_TEXT)).alias("error"))


def merge_gate(rollup: DataFrame, condition: str) -> DataFrame:
    """Labels whose outputs may be merged: ``all_success``, ``any_success`` or ``always``, and never without output."""
    allowed = {
        "all_success": F.size("failed") == 0,
        "any_success": F.size("successful") > 0,
        "always": F.lit(True),
    }
    hit = allowed.get(condition, F.lit(False))
    return rollup.withColumn("merge", hit & (F.size("output_files") > 0))


def missing_outputs(run_files: DataFrame, listing: DataFrame) -> DataFrame:
    """Planned outputs (label, path) that are not among the files found."""
    keys = [k for k in ("run_id", "label") if k in run_files.columns]
    expected = run_files.select(*keys, F.explode("expected_outputs").alias("path"))
    return expected.join(listing.select("path"), "path", "left_anti").select(*keys, "path")


def unplanned_files(queue: DataFrame, run_files: DataFrame) -> DataFrame:
    """Queue entries the manifest does not know, as pending entries without ranges."""
    keys = [k for k in ("run_id", "label") if k in run_files.columns and k in queue.columns]
    rest = queue.join(run_files.select(*keys), keys, "left_anti")
    return rest.select(*keys, "input_file", F.lit("pending").alias("status"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Duration per row and per call, and whether everything was done, from one row of totals per run."""
    done, total, calls = F.col("processed_rows"), F.col("total_rows"), F.col("api_calls")
    return runs.withColumns({
        "sec_per_row": F.when(done > 0, F.round(F.col("total_sec") / done, 4)),
        "sec_per_call": F.when(calls > 0, F.round(F.col("total_sec") / calls, 4)),
        "complete": done == total,
    })


def manifest_summary(run_files: DataFrame, listing: DataFrame) -> DataFrame:
    """Per file: status, input, number of ranges, merged output, or else how many outputs are expected and missing."""
    keys = [k for k in ("run_id", "label") if k in run_files.columns]
    gone = missing_outputs(run_files, listing).groupBy(*keys).agg(F.count("*").alias("_missing"))
    merged = F.col("merged_output").isNotNull()
    return run_files.join(gone, keys, "left").select(
        *keys, F.coalesce("status", F.lit("pending")).alias("status"), "input_file",
        F.size("ranges").alias("n_ranges"), "merged_output",
        F.when(~merged, F.size("expected_outputs")).alias("expected"),
        F.when(~merged, F.coalesce("_missing", F.lit(0))).cast("int").alias("missing"))


def final_summary(rollup: DataFrame) -> DataFrame:
    """Rows and failed workers per label, and the totals in a row with a NULL label."""
    return rollup.rollup("label").agg(
        F.sum("total_rows").alias("total_rows"), F.sum(F.size("failed")).alias("failed_workers"),
        F.count("*").alias("files"))
