"""The whole run: place rows, batch them, call in waves, read answers, fall back, fill."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import STANDARD_RULES, Rule
from ..functions.numbers import whole_div
from ..functions.text import Wording
from ..operators.answers import AnswerReader, coded_rows, terminal_fill
from ..operators.batches import UNIT_KEYS, batch_units, chunk_batches, part_number, single_units
from ..operators.position import KeyStats, key_stats, with_position
from ..operators.ranges import assign_worker, range_join
from ..session import prepare, work_folder
from ..sources.commits import SliceLog, slice_number
from ..sources.messages import path_exists, require_columns
from ..spec import PromptSpec
from .calls import SLICE, Caller

KEEP = ("RowID", "Sentiment")


@dataclass(frozen=True)
class RunPlan:
    """Numbers of a run. ``ranges`` replaces the even split over ``n_workers``.

    ``workers_per_step`` cuts a big run into steps of that many workers (row ranges): each step is saved on its own, so
    that a run that breaks off goes on with the step it was in. A step should still fill the cluster.
    """

    n_workers: int = 4
    batch_size: int = 10
    retries: int = 3
    interval: int = 25
    delay_sec: float = 0.0
    ranges: tuple[tuple[int, int], ...] = ()
    workers_per_step: int | None = None

    def __post_init__(self):
        if min(self.retries, self.batch_size, self.n_workers, self.interval, self.workers_per_step or 1) < 1:
            raise ValueError("workers, batch size, retries and interval must be positive")

    def steps(self) -> list[tuple[int, int]]:
        """First and last worker of each step."""
        workers = len(self.ranges) or self.n_workers
        size = self.workers_per_step or workers
        return [(w, min(w + size - 1, workers)) for w in range(1, workers + 1, size)]

    def extent(self, first: int, last: int, n_rows: int) -> tuple[int, int]:
        """First and last position of a group of workers."""
        if self.ranges:
            held = [r for r in self.ranges[first - 1:last] if r[0] <= r[1]] or [(1, 0)]
            return min(r[0] for r in held), max(r[1] for r in held)
        base, extra = divmod(n_rows, self.n_workers)
        return (first - 1) * base + min(first - 1, extra) + 1, last * base + min(last, extra)


def place_rows(messages: DataFrame, plan: RunPlan, stats: KeyStats | None = None) -> DataFrame:
    """Worker, batch, place and part of every row. For gap-free ids these are plain expressions of the id."""
    stats = stats or key_stats(messages, "RowID")
    placed = with_position(messages, "RowID", stats=stats)
    if plan.ranges:
        placed = range_join(placed, plan.ranges)
    else:
        placed = assign_worker(placed, stats.rows, plan.n_workers)
    return part_number(chunk_batches(placed, plan.batch_size), plan.batch_size, plan.interval)


def _with_folders(schema: T.StructType, **folders: T.DataType) -> T.StructType:
    """Schema of a saved table with the columns that its folder names hold."""
    return T.StructType(schema.fields + [T.StructField(name, kind) for name, kind in folders.items()])


def _placed_steps(messages: DataFrame, plan: RunPlan, stats: KeyStats, folder: str) -> list[DataFrame]:
    """Placed rows of each step.

    With gap-free ids a step is a range of ids that reaches the scan, so a step reads only its own rows. Otherwise
    placing takes a shuffle, and a run of several steps does it once and saves the result by step.
    """
    placed, steps = place_rows(messages, plan, stats), plan.steps()
    if len(steps) == 1:
        return [placed]
    if stats.dense:
        extents = [plan.extent(first, last, stats.rows) for first, last in steps]
        ids = [(stats.low + start - 1, stats.low + end - 1) for start, end in extents]
        return [placed.filter(F.col("RowID").between(*i) & F.col("worker_id").between(*w)) for i, w in zip(ids, steps)]
    path, size = f"{folder}/placed", steps[0][1]
    if not path_exists(messages.sparkSession, f"{path}/_SUCCESS"):
        saved = placed.withColumn("step", whole_div(F.col("worker_id") - 1, size))
        saved.write.mode("overwrite").partitionBy("step").parquet(path)
    saved = messages.sparkSession.read.schema(_with_folders(placed.schema, step=T.IntegerType())).parquet(path)
    return [saved.filter(F.col("step") == n).drop("step") for n in range(len(steps))]


def _units(rows: DataFrame, kind: str, plan: RunPlan, keep: Sequence[str], wording: Wording,
           partitions: int | None, slices: int | None = None) -> DataFrame:
    """All units of one kind."""
    if kind == "batch":
        return batch_units(rows, plan.batch_size, keep, wording, partitions, slices)
    return single_units(rows, keep, wording, partitions, slices)


def _again(failed: DataFrame, kind: str, partitions: int | None, slices: int | None = None) -> DataFrame:
    """Units of the next wave from the failed ones of the last: their prompts were saved, so nothing is read or joined."""
    units = failed.withColumn("kind", F.lit(kind))
    if slices:
        units = units.withColumn(SLICE, slice_number([*UNIT_KEYS, "row_id"], slices))
    return units.repartition(partitions, *([SLICE] if slices else [*UNIT_KEYS, "row_id"])) if partitions else units


def _wave(units: DataFrame, caller: Caller, reader: AnswerReader, attempt: int, path: str, log: SliceLog | None = None) -> DataFrame:
    """One attempt for all given units: call, read, write. A wave that was written before is not called again, and of one that
    broke off only those slices that are not in its log.

    Units that are not ok are written with their prompts.
    """
    spark = units.sparkSession
    read = reader(caller(units, attempt, log) if log else caller(units, attempt)).drop("kind")
    read = read.withColumn("prompt", F.when(~F.col("ok"), F.col("prompt")))
    if not path_exists(spark, f"{path}/_SUCCESS"):
        read.write.mode("overwrite").parquet(path)
    return spark.read.schema(read.schema).parquet(path)


def _description(caller: Caller) -> str:
    described = getattr(caller, "describe", None)
    return described() if described else type(caller).__qualname__


def _row_hash(messages: DataFrame, columns: Sequence[str]) -> Column:
    """Hash of a row; which columns are null is part of it, as Spark's hash passes over nulls."""
    named = [F.col(f"`{c}`") for c in columns]
    # Maps have no hash, and within nested values nulls would be passed over.
    nested = (T.MapType, T.ArrayType, T.StructType, T.VariantType)
    plain = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(messages.schema[name].dataType, nested) else c
             for name, c in zip(columns, named)]
    return F.xxhash64(*plain, *[c.isNull() for c in named])


def _claim(messages: DataFrame, folder: str, facts: dict[str, object], columns: Sequence[str]) -> None:
    """Write down what the waves in a folder belong to; a folder of another run is refused.

    The input is told by its number of rows, its extent, and order-free hashes over all ids and over the rows' ``columns``.
    """
    hashes = F.xxhash64("RowID"), _row_hash(messages, columns)
    ids = messages.agg(F.count("*"), *[F.sum(h.cast("decimal(38,0)")) for h in hashes]).first()
    claim_folder(messages.sparkSession, folder, {**facts, "rows": ids[0], "ids": str(ids[1]), "texts": str(ids[2])})


def claim_folder(spark: SparkSession, folder: str, facts: dict[str, object]) -> None:
    """Write down the facts of a run in its folder; a folder with other facts, or with waves and none, is refused."""
    path, text = f"{folder}/run", json.dumps(facts, sort_keys=True)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        if path_exists(spark, f"{folder}/waves"):
            raise ValueError(f"{folder} holds waves of an unknown run")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    before, now = json.loads(spark.read.text(path).first()[0]), json.loads(text)
    changed = sorted(k for k in {*before, *now} if before.get(k) != now.get(k))
    if changed:
        raise ValueError(f"{folder} belongs to a run with other {', '.join(changed)}; use a new folder")


@dataclass(frozen=True)
class LabelRun:
    """Result of a run: ``rows`` (one per message and range) and ``log`` (one per response)."""

    rows: DataFrame
    log: DataFrame


def label_run(messages: DataFrame, spec: PromptSpec, caller: Caller, plan: RunPlan = RunPlan(), *,
              folder: str | None = None, keep: Sequence[str] = KEEP, extra: Sequence[str] = (),
              wording: Wording = Wording(), rules: tuple[Rule, ...] = STANDARD_RULES,
              stats: KeyStats | None = None) -> LabelRun:
    """Label every row of ``messages``.

    Each wave is written to ``folder`` (shared storage) and read back, so no call is made twice. While it runs, tasks put away the
    answers of each slice of calls, so a run that is started again with the same folder goes on after the last slice. A folder that belongs to another input, spec,
    plan or caller is refused. Failed units are written with their prompts, so a retry reads these and nothing else.
    Batches that use up their attempts are asked for row by row, for which their rows are read once more. ``extra`` names row columns
    that a Column caller needs.
    """
    spark = prepare(messages.sparkSession)
    folder = folder or work_folder(spark, "label-run")
    messages = require_columns(messages)
    stats = stats or key_stats(messages, "RowID")
    kept = list(dict.fromkeys([*keep, "pos_in_worker", "part"]))
    packed = list(dict.fromkeys([*kept, *extra]))
    _claim(messages, folder, {
        "spec": repr(spec), "plan": repr(replace(plan, delay_sec=0.0)), "caller": _description(caller), "wording": repr(wording),
        "columns": repr(packed), "low": str(stats.low), "high": str(stats.high)},
        [c for c in dict.fromkeys(["RowID", "Message", "Title", "Sentiment", *packed]) if c in messages.columns])
    readers = {kind: AnswerReader(spec, kind, rules) for kind in ("batch", "row")}

    # What a caller puts away while a wave runs is told apart by the number of units, which is the same in every start.
    slices = getattr(caller, "slices", None)
    workers = len(plan.ranges) or plan.n_workers
    for step, rows in enumerate(_placed_steps(messages, plan, stats, folder)):
        failed, first, last = None, *plan.steps()[step]
        start, end = plan.extent(first, last, stats.rows)
        n_units = sum(max(0, e - s + 1) for s, e in plan.ranges[first - 1:last]) if plan.ranges else max(0, end - start + 1)
        n_units = math.ceil(n_units / plan.batch_size) + workers
        for kind in ("batch", "row") if plan.batch_size > 1 else ("row",):
            if failed is not None:
                rows, n_units = rows.join(failed.select(*UNIT_KEYS), list(UNIT_KEYS), "left_semi"), n_units * plan.batch_size
            failed = None
            for attempt in range(1, plan.retries + 1):
                n_slices = slices(n_units) if slices else None
                if failed is None:
                    units = _units(rows, kind, plan, packed, wording, caller.partitions(spark, n_units), n_slices)
                else:
                    units = _again(failed, kind, caller.partitions(spark, n_units), n_slices)
                path = f"{folder}/waves/step={step}/kind={kind}/attempt={attempt}"
                log = SliceLog(f"{folder}/calls/step={step}/kind={kind}/attempt={attempt}") if slices else None
                wave = _wave(units, caller, readers[kind], attempt, path, log)
                failed = wave.filter(~F.col("ok")).select(*UNIT_KEYS, "row_id", "rows", "prompt")
                n_units = failed.count()
                if not n_units:
                    failed = None
                    break
                if attempt < plan.retries and plan.delay_sec:
                    time.sleep(plan.delay_sec * attempt)
            if failed is None:
                break

    schema = _with_folders(wave.schema, step=T.IntegerType(), kind=T.StringType(), attempt=T.IntegerType())
    log = spark.read.schema(schema).parquet(f"{folder}/waves")
    carry = ["worker_id", "batch_id", "kind", "attempt"]
    out_of_attempts = (F.col("kind") == "row") & (F.col("attempt") == plan.retries) & ~F.col("ok")
    lost = log.filter(out_of_attempts).select(*carry, F.inline("rows"))
    labelled = coded_rows(log, spec, kept, carry).unionByName(terminal_fill(lost, spec, kept, carry))
    return LabelRun(rows=labelled, log=log.drop("answers", "rows", "prompt"))


def label_table(messages: DataFrame, spec: PromptSpec, caller: Caller, plan: RunPlan = RunPlan(),
                **options) -> DataFrame:
    """Rows of ``label_run``: RowID, Sentiment, coded columns, and where and when each row was handled."""
    return label_run(messages, spec, caller, plan, **options).rows
