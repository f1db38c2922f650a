"""Model calls over units (one prompt each): a client in Python, or a Column expression that answers."""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batches import UNIT_KEYS
from ..sources.commits import SliceLog, by_slice

COUNTERS = ("prompt_eval_count", "prompt_tokens", "eval_count", "completion_tokens",
            "total_duration", "prompt_eval_duration", "eval_duration")
#: When a call began and ended, in microseconds since 1970.
TIMES = ("started_us", "ended_us")
#: Column of units that says in which slice of the commit log they are.
SLICE = "slice"


class ModelClient(Protocol):
    """Answers prompts; must be picklable."""

    def complete(self, model: str, system: str, prompt: str) -> dict:
        """``content`` and any of ``COUNTERS``. An exception is a failed call of this prompt only."""
        ...


class GiveUp(Exception):
    """Raised by a client when no call can succeed (quota used up, key revoked): the run stops instead of noting an error."""


class Caller(Protocol):
    def __call__(self, units: DataFrame, attempt: int, log: SliceLog | None = None) -> DataFrame:
        """``units`` with content, error and counters, for one attempt."""
        ...

    def describe(self) -> str:
        """What decides the answers, as text that is the same whenever the run is started again."""
        ...

    def partitions(self, spark: SparkSession, units: int | None = None) -> int | None:
        """In how many partitions that many units should come, if that matters."""
        ...


@dataclass(frozen=True)
class ClientCaller:
    """Calls a client from tasks, slice by slice; the only place where Python sees data.

    Calls at one time are at most ``threads`` per running task; fewer ``tasks`` than slots cap them further. Without
    ``tasks`` there are ``least_tasks``, by default four per slot, and more if a task would have over ``calls_per_task`` units. With a log, the
    answers of every ``slice_units`` or so units are put away as soon as they are there: neither a lost executor nor a run that
    breaks off pays again for them. Write the result before using it twice, because a recomputation would call again.
    ``settings`` names what else decides the answers (temperature, address), so that a run with others is told apart;
    ``name`` stands for the client where its class does not say which one it is.
    """

    client: ModelClient
    model: str = ""
    system: str = ""
    tasks: int | None = None
    threads: int = 1
    slice_units: int = 64
    calls_per_task: int = 2000
    least_tasks: int | None = None
    settings: str = ""
    name: str = ""

    def __call__(self, units: DataFrame, attempt: int, log: SliceLog | None = None) -> DataFrame:
        if units.sparkSession.conf.get("spark.speculation", "false") == "true":
            warnings.warn("spark.speculation is on: slow tasks would call the model twice", stacklevel=2)
        client, model, system, threads, size = self.client, self.model, self.system, self.threads, self.slice_units
        number = SLICE if SLICE in units.columns else None
        keys = [c for c in (*UNIT_KEYS, "row_id") if c in units.columns]
        if number:
            units = units.sortWithinPartitions(SLICE, *keys)
        passed = [f for f in units.schema.fields if f.name != SLICE]
        texts = [T.StructField(c, T.StringType()) for c in ("content", "error")]
        schema = T.StructType(passed + texts + [T.StructField(c, T.LongType()) for c in (*COUNTERS, *TIMES)])
        kinds = {**{c: pa.string() for c in ("content", "error")}, **{c: pa.int64() for c in (*COUNTERS, *TIMES)}}

        def ask(prompt: str) -> dict:
            start = time.time_ns()
            try:
                answer = client.complete(model, system, prompt)
            except GiveUp:
                raise
            except Exception as problem:
                answer = {"error": f"{type(problem).__name__}: {problem}"}
            return {**answer, "started_us": start // 1000, "ended_us": time.time_ns() // 1000}

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(threads) as pool:
                for part, rows in by_slice(batches, number, size):
                    known = {c: rows.column(c) for c in keys}
                    done = log.read(part) if log and number else None
                    if done is None or any(done.column(c).to_pylist() != known[c].to_pylist() for c in keys):
                        found = list(pool.map(ask, rows.column("prompt").to_pylist()))
                        done = pa.table({**known, **{c: pa.array([a.get(c) for a in found], kind) for c, kind in kinds.items()}})
                        if log and number:
                            log.write(part, done)
                    done = done.combine_chunks()
                    columns = {f.name: rows.column(f.name) for f in passed}
                    for c, kind in kinds.items():
                        columns[c] = pa.array(done.column(c).to_pylist(), kind)
                    yield pa.RecordBatch.from_pydict(columns)

        return units.mapInArrow(call, schema)

    def describe(self) -> str:
        kind = type(self.client)
        name = self.name or f"{kind.__module__}.{kind.__qualname__}"
        more = f" {self.settings!r}" if self.settings else ""
        return f"{name} {self.model!r} {self.system!r}{more}"

    def partitions(self, spark: SparkSession, units: int | None = None) -> int:
        least = self.least_tasks or 4 * spark.sparkContext.defaultParallelism
        return self.tasks or max(least, math.ceil((units or 0) / self.calls_per_task))

    def slices(self, units: int) -> int:
        """In how many slices that many units are put away."""
        return max(1, math.ceil(units / self.slice_units))


@dataclass(frozen=True)
class ColumnCaller:
    """Answers with a Column expression over the unit: for tests, dry runs and replayed answers."""

    batch: Callable[[int], Column]
    row: Callable[[int], Column]

    def __call__(self, units: DataFrame, attempt: int, log: SliceLog | None = None) -> DataFrame:
        content = F.when(F.col("kind") == "batch", self.batch(attempt)).otherwise(self.row(attempt))
        empty = {c: F.lit(None).cast("long") for c in (*COUNTERS, *TIMES)}
        return units.withColumns({"content": content, "error": F.lit(None).cast("string"), **empty})

    def describe(self) -> str:
        return f"{self.batch(1)} {self.row(1)}"

    def partitions(self, spark: SparkSession, units: int | None = None) -> None:
        return None
