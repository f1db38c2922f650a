"""Labelling a stream with one wave of calls per micro-batch.

Every micro-batch makes a single wave: first attempts for its own rows, and the next attempt for whatever failed before. What
fails again is put into a table of waiting units, which the next micro-batch takes. No micro-batch waits for retries of its own
rows, and a micro-batch that is repeated after a crash finds the same waiting units and the answers it has paid for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import STANDARD_RULES, Rule
from ..functions.text import Wording, batch_prompt, row_body
from ..operators.answers import AnswerReader, coded_rows, terminal_fill
from ..operators.batches import UNIT_KEYS, single_units
from ..operators.position import key_stats
from ..plans.calls import SLICE, Caller
from ..plans.label import KEEP, RunPlan, _again, _description, claim_folder, place_rows
from ..session import prepare
from ..sources.commits import SliceLog, slice_number
from ..sources.messages import path_exists, require_columns
from ..spec import PromptSpec

TEXTS = ("RowID", "Sentiment", "Title", "Message")
STATE = ("kind", "attempt")
CARRY = ["worker_id", "batch_id", *STATE]


def text_units(rows: DataFrame, size: int, packed: Sequence[str], wording: Wording = Wording(), partitions: int | None = None,
               slices: int | None = None) -> DataFrame:
    """Units of placed rows that keep their texts, so that a failed one can be asked for row by row without its input.

    The texts are shuffled once; the prompt is made from them behind the shuffle.
    """
    if size == 1:
        return single_units(rows, packed, wording, partitions, slices)
    sliced = [SLICE] if slices else []
    if slices:
        rows = rows.withColumn(SLICE, slice_number(UNIT_KEYS, slices))
    if partitions:
        rows = rows.repartition(partitions, *(sliced or UNIT_KEYS))
    item = F.struct("pos", F.struct(*packed).alias("row"))
    groups = rows.groupBy(*sliced, *UNIT_KEYS).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    bodies = F.transform("_items.row", lambda r: row_body(*[r[c] for c in TEXTS], wording))
    return groups.select(
        *sliced, *UNIT_KEYS, F.lit("batch").alias("kind"), F.lit(None).cast("long").alias("row_id"),
        F.col("_items.row").alias("rows"), batch_prompt(bodies, wording).alias("prompt"))


@dataclass(frozen=True)
class WaveStream:
    """A labelled stream: ``out`` gets every row once, when it is answered or out of attempts.

    ``folder`` (shared storage) holds waves, answers of slices and waiting units; with another spec, plan or caller it is refused.
    Rows need ``RowID`` and ``Message``; each micro-batch is placed and cut into batches on its own. ``delay_sec`` of the plan
    is not used, as the time to the next micro-batch is the delay.
    """

    spec: PromptSpec
    caller: Caller
    plan: RunPlan
    out: str
    folder: str
    keep: tuple[str, ...] = KEEP
    extra: tuple[str, ...] = ()
    wording: Wording = Wording()
    rules: tuple[Rule, ...] = STANDARD_RULES

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Label what arrives; ``trigger`` is that of ``writeStream``, by default ``availableNow=True``."""
        claim_folder(prepare(messages.sparkSession), self.folder, {
            "spec": repr(self.spec), "plan": repr(replace(self.plan, delay_sec=0.0)), "caller": _description(self.caller),
            "wording": repr(self.wording), "columns": repr((self.keep, self.extra))})
        return (messages.writeStream.foreachBatch(self._micro_batch).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())

    def drain(self, spark: SparkSession) -> int:
        """Make waves until no unit waits, and say how many. Call it while the stream stands still; it may go on afterwards.

        A drain that broke off is finished by the next one, or by the next micro-batch.
        """
        prepare(spark)
        batch, made = self._last_batch(spark), 0
        if batch is None:
            return 0
        while True:
            step = self._newest(spark, batch)
            if path_exists(spark, self._taken(step, "batch")):
                raise ValueError("a micro-batch broke off and holds the waiting units: start the stream again first")
            if not self._waiting(spark, step):
                return made
            self._take(spark, step, "drain")
            self._wave(spark, (batch, step[1] + 1), step, None)
            made += 1

    def rows(self, spark: SparkSession, schema: T.StructType | str | None = None) -> DataFrame:
        """What is labelled so far; with a ``schema`` of the columns that are asked for, also when that is nothing."""
        if schema and not path_exists(spark, self.out):
            return spark.createDataFrame([], schema)
        return (spark.read.schema(schema) if schema else spark.read).parquet(self.out)

    # A step is a micro-batch (its number, 0) or a wave of a drain after it (its number, 1 and up).

    @cached_property
    def _packed(self) -> list[str]:
        return list(dict.fromkeys([*TEXTS, *self._kept, *self.extra]))

    @cached_property
    def _kept(self) -> list[str]:
        return list(dict.fromkeys([*self.keep, "pos_in_worker", "part"]))

    def _pending(self, step: tuple[int, int]) -> str:
        return f"{self.folder}/pending/b{step[0]}r{step[1]}"

    def _taken(self, step: tuple[int, int], by: str) -> str:
        return f"{self.folder}/taken/b{step[0]}r{step[1]}-{by}"

    def _take(self, spark: SparkSession, step: tuple[int, int], by: str) -> None:
        system, path = _place(spark, self._taken(step, by))
        system.mkdirs(path)

    def _last_batch(self, spark: SparkSession) -> int | None:
        system, path = _place(spark, f"{self.folder}/pending")
        if not system.exists(path):
            return None
        # At most two micro-batches and their drains are there; older ones are deleted.
        numbers = [int(f.getPath().getName()[1:].split("r")[0]) for f in system.listStatus(path)]
        done = [n for n in numbers if path_exists(spark, f"{self._pending((n, 0))}/_SUCCESS")]
        return max(done, default=None)

    def _newest(self, spark: SparkSession, batch: int) -> tuple[int, int]:
        if not path_exists(spark, f"{self._pending((batch, 0))}/_SUCCESS"):
            raise ValueError(f"{self.folder} does not know micro-batch {batch}: it belongs to another checkpoint")
        turn = 0
        while path_exists(spark, f"{self._pending((batch, turn + 1))}/_SUCCESS"):
            turn += 1
        return batch, turn

    def _waiting(self, spark: SparkSession, step: tuple[int, int]) -> list[tuple[str, int, str]]:
        """Kind, attempt and folder of what waits after a step."""
        states = [(kind, attempt) for kind in ("batch", "row") for attempt in range(1, self.plan.retries + 1)]
        found = [(kind, attempt, f"{self._pending(step)}/kind={kind}/attempt={attempt}") for kind, attempt in states]
        return [f for f in found if path_exists(spark, f[2])]

    def _micro_batch(self, rows: DataFrame, batch: int) -> None:
        spark, before = prepare(rows.sparkSession), None
        if batch > 0:
            before = self._newest(spark, batch - 1)
            while path_exists(spark, self._taken(before, "drain")):
                # The drain that took these units did not finish; its wave may have been answered and written.
                following = (before[0], before[1] + 1)
                self._wave(spark, following, before, None)
                before = following
            self._take(spark, before, "batch")
        self._wave(spark, (batch, 0), before, rows)
        self._forget(spark, batch - 2)

    def _forget(self, spark: SparkSession, batch: int) -> None:
        """Delete waiting units of a micro-batch that no repeated one can ask for any more."""
        turn = 0
        while batch >= 0 and path_exists(spark, self._pending((batch, turn))):
            system, path = _place(spark, self._pending((batch, turn)))
            system.delete(path, True)
            turn += 1

    def _wave(self, spark: SparkSession, step: tuple[int, int], before: tuple[int, int] | None, rows: DataFrame | None) -> None:
        """One wave: the waiting units of ``before`` and first attempts for ``rows``; then output and waiting units of ``step``."""
        name, parts = f"b{step[0]}r{step[1]}", []
        for kind, attempt, path in self._waiting(spark, before) if before else []:
            units = spark.read.parquet(path)
            n_units = units.count()
            parts.append(self._called(_again(units, kind, *self._spread(spark, n_units)), kind, attempt, name))
        if rows is not None:
            rows = require_columns(rows)
            stats = key_stats(rows, "RowID")
            if stats.rows:
                n_units = math.ceil(stats.rows / self.plan.batch_size) + (len(self.plan.ranges) or self.plan.n_workers)
                placed = place_rows(rows, self.plan, stats)
                units = text_units(placed, self.plan.batch_size, self._packed, self.wording, *self._spread(spark, n_units))
                parts.append(self._called(units, "batch" if self.plan.batch_size > 1 else "row", 1, name))
        if not parts:
            spark.createDataFrame([], "kind string, attempt int, row_id long").write.mode("overwrite").partitionBy(*STATE).parquet(
                self._pending(step))
            return
        wave = parts[0]
        for part in parts[1:]:
            wave = wave.unionByName(part)
        path = f"{self.folder}/waves/step={name}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            wave.write.mode("overwrite").partitionBy(*STATE).parquet(path)
        fields = [f for f in wave.schema.fields if f.name not in STATE]
        schema = T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("attempt", T.IntegerType())])
        self._settle(spark.read.schema(schema).parquet(path), step, name)

    def _spread(self, spark: SparkSession, n_units: int) -> tuple[int | None, int | None]:
        """Partitions and slices of that many units."""
        slices = getattr(self.caller, "slices", None)
        return self.caller.partitions(spark, n_units), slices(n_units) if slices else None

    def _called(self, units: DataFrame, kind: str, attempt: int, name: str) -> DataFrame:
        """Read answers of units of one kind and attempt; those that are not ok keep their texts and prompt."""
        log = SliceLog(f"{self.folder}/calls/{name}/kind={kind}/attempt={attempt}") if SLICE in units.columns else None
        called = self.caller(units, attempt, log) if log else self.caller(units, attempt)
        kept = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in self._kept]))
        read = AnswerReader(self.spec, kind, self.rules)(called.withColumn("texts", F.col("rows")).withColumn("rows", kept))
        failed = ~F.col("ok")
        return read.drop(SLICE).withColumns({"texts": F.when(failed, F.col("texts")), "prompt": F.when(failed, F.col("prompt")),
                                             "attempt": F.lit(attempt)})

    def _settle(self, wave: DataFrame, step: tuple[int, int], name: str) -> None:
        """Write what a wave answered or gave up, and what has to wait for the next one."""
        last = F.col("attempt") == self.plan.retries
        lost = wave.filter(~F.col("ok") & last & (F.col("kind") == "row")).select(*CARRY, F.inline("rows"))
        labelled = coded_rows(wave, self.spec, self._kept, CARRY).unionByName(terminal_fill(lost, self.spec, self._kept, CARRY))
        (labelled.withColumn("step", F.lit(name)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(self.out))

        failed = wave.filter(~F.col("ok")).drop("rows").withColumnRenamed("texts", "rows")
        unit = ["kind", *UNIT_KEYS, "row_id", "rows", "prompt"]
        again = failed.filter(~last).select(*unit, (F.col("attempt") + 1).alias("attempt"))
        alone = failed.filter(last & (F.col("kind") == "batch")).select(*UNIT_KEYS, F.inline("rows"))
        alone = single_units(alone, self._packed, self.wording).select(*unit, F.lit(1).alias("attempt"))
        again.unionByName(alone).write.mode("overwrite").partitionBy(*STATE).parquet(self._pending(step))


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
