"""A whole run over a queue of files: plan, label, save, roll up, merge, and go on after an interruption."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from ..operators.audit import analytics_row
from ..operators.merge import merge_outputs
from ..operators.position import key_stats
from ..operators.ranges import plan_manual, plan_ranges
from ..operators.usage import call_figures, stamp_metadata, token_usage
from ..session import prepare
from ..sources import ledger
from ..sources.messages import land_messages, path_exists
from ..sources.checked import checked_parts, write_checked_parts
from ..sources.parts import folder_name, read_partitioned, write_output
from ..spec import RETRIES_FAILED, PromptSpec
from .calls import Caller
from .label import RunPlan, label_run

ENTRY_SCHEMA = (
    "run_id string, version long, updated_at timestamp, status string, input_file string, "
    "ranges array<struct<worker_id int, start long, end long>>, merged_output string, plan string, label string"
)


@dataclass(frozen=True)
class QueueRun:
    """One run: where its tables are and how its files are handled.

    ``out`` is shared storage and holds: runs, files (manifest log, a small file per version), input (every file landed once; rows without ``RowID`` are numbered in
    file order), status, waves, parts (with their
    ledger), notices of parts that were left out, merged and analytics. With
    ``files_at_once`` above 1 the jobs of that many files are handed to Spark side by side.
    """

    run_id: str
    out: str
    spec: PromptSpec
    caller: Caller
    plan: RunPlan = RunPlan()
    model: str = ""
    merge_when: str = "all_success"
    sort_by: str = "RowID"
    form: str = "parquet"
    parts_per_folder: int = 100
    na_tokens: tuple[str, ...] = ()
    files_at_once: int = 1

    def files(self, spark: SparkSession) -> DataFrame | None:
        """Current manifest of the run: the entry of the highest version per label."""
        path = f"{self.out}/files/{folder_name(self.run_id)}"
        if not path_exists(spark, path):
            return None
        entries = spark.read.schema(ENTRY_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
        return runs.upsert_run_file(entries, order=("version",))

    def status(self, spark: SparkSession) -> DataFrame:
        """Newest status of every worker and file."""
        log = read_partitioned(spark, f"{self.out}/status", ("label",)).filter(F.col("run_id") == self.run_id)
        return runs.latest_by(log, ("run_id", "label", "worker_id"), ("updated_at",),
                              [c for c in log.columns if c not in ("run_id", "label", "worker_id")])


class Manifest:
    """The log of one file of a run. Each entry is a version that only one driver can commit.

    A driver that finds the version it wants to write taken raises ``Conflict``: another one goes on with the file, and its ranges
    and status are not to be mixed with this one's.
    """

    def __init__(self, spark: SparkSession, run: QueueRun, label: str, path: str, version: int = 0):
        self.spark, self.run, self.label, self.path, self.version = spark, run, label, path, version

    def note(self, status: str, ranges: list | None = None, merged: str | None = None, plan: RunPlan | None = None) -> None:
        entry = {
            "run_id": self.run.run_id, "version": self.version + 1, "updated_at": datetime.now(timezone.utc).isoformat(), "status": status,
            "input_file": self.path, "ranges": [dict(zip(("worker_id", "start", "end"), r)) for r in ranges] if ranges is not None else None,
            "merged_output": merged, "plan": json.dumps(asdict(plan)) if plan else None, "label": self.label}
        folder = f"{self.run.out}/files/{folder_name(self.run.run_id)}/{folder_name(self.label)}"
        ledger.commit_once(self.spark, f"{folder}/{self.version + 1:08d}.json", json.dumps(entry))
        self.version += 1


def _stored_plan(text: str | None, plan: RunPlan) -> RunPlan:
    """The plan that a manifest entry holds, with the waiting time of ``plan``; ``plan`` itself where there is none."""
    if not text:
        return plan
    facts = json.loads(text)
    return RunPlan(**{**facts, "ranges": tuple(map(tuple, facts["ranges"])), "delay_sec": plan.delay_sec})


def _worker_status(run: QueueRun, label: str, rows: DataFrame, planned: DataFrame, n_rows: int) -> DataFrame:
    """Status of every planned worker: completed if all rows that its range holds are saved.

    A range may reach beyond the table or hold nothing. Rows out of attempts are errors.
    """
    first = run.spec.first if run.spec.first in rows.columns else f"Validated_{run.spec.first}"
    lost = F.count_if(F.col(first) == RETRIES_FAILED)
    done = rows.groupBy("worker_id").agg(F.count("*").alias("rows_processed"), lost.alias("errors"))
    total = F.greatest(F.least(F.col("end"), F.lit(n_rows).cast("long")) - F.col("start") + 1, F.lit(0))
    joined = planned.join(done, "worker_id", "left").fillna(0, ["rows_processed", "errors"])
    full = F.col("rows_processed") == total
    part = F.concat(F.lit(f"{run.out}/parts/run_id={run.run_id}/label={folder_name(label)}/worker_id="), F.col("worker_id").cast("string"))
    return joined.select(
        F.lit(run.run_id).alias("run_id"), "worker_id", F.current_timestamp().alias("updated_at"),
        F.when(full, "completed").otherwise("failed").alias("state"), "rows_processed", total.alias("total_rows"),
        "errors", F.when(~full, "rows are missing").alias("last_error"),
        F.when(F.col("rows_processed") > 0, part).alias("output_file"))


def _label_file(manifest: Manifest, plan: RunPlan) -> None:
    """Label one file, save its parts and status, and merge if the condition allows it."""
    spark, run, path, label = manifest.spark, manifest.run, manifest.path, manifest.label
    begun = datetime.now(timezone.utc)
    messages = land_messages(spark, path, f"{run.out}/input/{run.run_id}/{folder_name(label)}", run.na_tokens)
    stats = key_stats(messages, "RowID")
    planned = plan_manual(spark, plan.ranges) if plan.ranges else plan_ranges(messages.select("RowID"), plan.n_workers)
    # One entry per worker of the plan.
    ranges = [tuple(r) for r in planned.orderBy("worker_id").collect()]
    manifest.note("pending", ranges, plan=plan)

    labelled = label_run(messages, run.spec, run.caller, plan, folder=f"{run.out}/waves/{run.run_id}/{folder_name(label)}", stats=stats)
    meta = {"Model_Name": run.model, "Batch_Size": plan.batch_size}
    figures = call_figures(labelled.log, labelled.rows.select("worker_id"))
    stamped = stamp_metadata(labelled.rows, meta, figures, ("worker_id",))
    write_checked_parts(stamped, f"{run.out}/parts", run.run_id, label, run.parts_per_folder)
    saved, notices = checked_parts(spark, f"{run.out}/parts", run.run_id, label)
    ledger.append(notices.filter("state <> 'good'"), f"{run.out}/notices/{run.run_id}/{folder_name(label)}")
    ledger.append(_worker_status(run, label, saved, planned, stats.rows), f"{run.out}/status/label={folder_name(label)}")

    status = run.status(spark).filter(F.col("label") == label)
    rollup = runs.run_rollup(status)
    gate = runs.merge_gate(rollup, run.merge_when).first()
    merged = None
    if gate["merge"]:
        merged = f"{run.out}/merged/{run.run_id}/{folder_name(label)}"
        good = saved.filter(F.col("worker_id").isin(gate["successful"])) if gate["failed"] else saved
        write_output(merge_outputs(good.drop("part_group"), run.sort_by), merged, run.form)
        _analytics(spark, run, label, good.drop("part_group", "label"), labelled.log, plan, begun)
    if gate["failed"]:
        failed = runs.failed_ranges(status, planned).drop("label")
        ledger.append_failed_ranges(failed, run.run_id, f"{run.out}/failed_ranges/label={folder_name(label)}")
    manifest.note("completed_with_failures" if gate["failed"] else "completed", ranges, merged, plan)


def _analytics(spark: SparkSession, run: QueueRun, label: str, rows: DataFrame, log: DataFrame, plan: RunPlan,
               begun: datetime) -> None:
    """One wide row about the merged output, with counts of the given sentiment as well; its columns depend on the labels, so every file has a table of its own."""
    used = token_usage(log.withColumn("_all", F.lit(1)), ["_all"]).first()
    given = [*run.spec.output_columns, "Sentiment"]
    coded = rows.select("RowID", *[c for c in rows.columns if c in given or c.startswith("Validated_")])
    now = datetime.now(timezone.utc)
    facts = {"run_id": run.run_id, "timestamp": f"{now:%Y-%m-%d %H:%M:%S}", "file_label": label, "model": run.model,
             "batch_size": plan.batch_size, "total_time_seconds": (now - begun).total_seconds(), "api_calls": log.count(), "tokens_total": used["total_tokens"] if used else 0}
    write_output(analytics_row(coded, facts), f"{run.out}/analytics/{run.run_id}/{folder_name(label)}", "parquet")


def run_queue(spark: SparkSession, run: QueueRun, queue: Sequence[tuple[str, str]],
              meta: Mapping[str, str] | None = None, config: Mapping[str, object] | None = None) -> DataFrame:
    """Handle every file of ``queue`` (path, label); started again, completed files are skipped and others go on.

    A file that was begun goes on with the plan in its manifest entry, whatever ``run.plan`` says by then: its ranges, batches and
    waves stay those of the first start. Ranges of workers whose rows are not all saved are noted in ``failed_ranges``; the next start
    writes their parts again, from the saved waves. Of two drivers at work on one file the second to write an entry of its manifest stops
    with ``Conflict``.
    Result: per label its status, rows, failed workers and merged output. A missing file is noted and the others go on.
    """
    prepare(spark)
    ledger.record_run(spark, f"{run.out}/runs", {"run_id": run.run_id, "model_name": run.model, **(meta or {})},
                      config or {}, datetime.now(timezone.utc))
    known = run.files(spark)
    # One entry per file of the queue.
    found = {r["label"]: r for r in known.select("label", "version", "status", "plan").collect()} if known is not None else {}

    def handle(path: str, label: str) -> None:
        before = found.get(label)
        manifest = Manifest(spark, run, label, path, before["version"] if before else 0)
        if path_exists(spark, path):
            _label_file(manifest, _stored_plan(before["plan"] if before else None, run.plan))
        else:
            manifest.note("input_missing")

    todo = [(path, label) for path, label in queue if label not in found or found[label]["status"] != "completed"]
    with ThreadPoolExecutor(run.files_at_once) as pool:
        for handled in [pool.submit(inheritable_thread_target(spark)(handle), *item) for item in todo]:
            handled.result()
    return queue_summary(spark, run)


def queue_summary(spark: SparkSession, run: QueueRun) -> DataFrame:
    """Per label: status, rows, failed workers and merged output."""
    files = run.files(spark).select("label", "status", "input_file", "merged_output")
    if not path_exists(spark, f"{run.out}/status"):
        return files.select("label", "status", F.lit(0).cast("long").alias("total_rows"), F.lit(0).alias("failed_workers"),
                            "merged_output")
    rollup = runs.run_rollup(run.status(spark))
    joined = files.join(rollup, "label", "left")
    return joined.select(
        "label", "status", F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce(F.size("failed"), F.lit(0)).alias("failed_workers"), "merged_output")
