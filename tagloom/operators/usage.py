"""Token usage and throughput of a response log."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rates as R
from .position import running_sums


def with_usage(log: DataFrame) -> DataFrame:
    """Add prompt_tok, completion_tok and nanos to every response; failed parses count as well."""
    return log.withColumns({
        "prompt_tok": R.first_count(F.col("prompt_eval_count"), F.col("prompt_tokens")),
        "completion_tok": R.first_count(F.col("eval_count"), F.col("completion_tokens")),
        "nanos": R.response_nanos(F.col("total_duration"), F.col("prompt_eval_duration"), F.col("eval_duration")),
    })


def token_usage(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    used = with_usage(log)
    return used.groupBy(*by).agg(
        F.sum("prompt_tok").alias("prompt_tokens"), F.sum("completion_tok").alias("completion_tokens"),
        F.sum(F.col("prompt_tok") + F.col("completion_tok")).alias("total_tokens"),
        F.sum("nanos").alias("total_duration_ns"))


def with_rates(totals: DataFrame, rows: str, elapsed_sec: str, tokens: str, nanos: str,
               digits: int | None = None) -> DataFrame:
    """Add rows_per_sec, tokens_per_sec and avg_tokens_per_row to totals."""
    figures = {
        "rows_per_sec": R.rows_per_sec(F.col(rows), F.col(elapsed_sec)),
        "tokens_per_sec": R.tokens_per_sec(F.col(tokens), F.col(nanos)),
        "avg_tokens_per_row": R.tokens_per_row(F.col(tokens), F.col(rows)),
    }
    if digits is not None:
        figures = {k: F.round(v, digits) for k, v in figures.items()}
    return totals.withColumns(figures)


def running_throughput(parts: DataFrame, group: Sequence[str] = ("worker_id",), order: str = "part",
                       digits: int = 4) -> DataFrame:
    """Throughput up to and including each part.

    ``parts`` has one row per part: rows, tokens, nanos and elapsed_ms spent in it.
    """
    sums = {"rows": "rows_so_far", "tokens": "tokens_so_far", "nanos": "nanos_so_far", "elapsed_ms": "ms_so_far"}
    running = running_sums(parts, group, order, sums).withColumn("_sec", F.col("ms_so_far") / 1000)
    return with_rates(running, "rows_so_far", "_sec", "tokens_so_far", "nanos_so_far", digits).drop("_sec")


def busy_time(log: DataFrame, by: Sequence[str] = (), start: str = "started_us", end: str = "ended_us",
              blocks: int = 1 << 16) -> DataFrame:
    """How long at least one call was under way, per group: calls that overlap count once.

    ``start`` and ``end`` are whole numbers (microseconds, say). Result: the group, ``calls``, ``summed`` (all durations added
    up), ``busy`` (the length of their union) and ``stretches`` (calls that touch are in one). Calls without a start or end are
    left out, a call that ends before it starts counts as one without duration, and a call without duration is in no stretch.

    A sweep: starts add one and ends take one away; where the running count leaves or comes back to zero a stretch begins or
    ends. Changes of equal times are added up before they are shuffled, and running counts are made in about ``blocks``
    blocks of time per group, so that no task holds a group. Only the log's extent comes to the driver.
    """
    first, last = F.col(start).cast("long"), F.col(end).cast("long")
    # Within a struct nulls are equal, so groups may be null.
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    timed = log.filter(first.isNotNull() & last.isNotNull()).select(
        group.alias("group"), first.alias("first"), F.greatest(first, last).alias("last"))
    low, high = timed.agg(F.min("first"), F.max("last")).first()
    width = max(1, math.ceil((high - low + 1) / blocks)) if low is not None else 1
    marks = F.array(F.struct(F.col("first").alias("time"), F.lit(1).alias("step")),
                    F.struct(F.col("last").alias("time"), F.lit(-1).alias("step")))
    steps = timed.select("group", F.inline(marks)).groupBy("group", "time").agg(F.sum("step").alias("step")).filter("step != 0")
    swept = running_sums(steps, ["group"], "time", {"step": "depth"}, width)
    ends, begins = F.col("depth") == 0, F.col("depth") == F.col("step")
    edge = F.when(ends, F.col("time")).when(begins, -F.col("time")).otherwise(0)
    swept = swept.groupBy("group").agg(F.sum(edge).alias("busy"), F.count_if(ends).alias("stretches"))
    totals = timed.groupBy("group").agg(F.count("*").alias("calls"), F.sum(F.col("last") - F.col("first")).alias("summed"))
    return totals.join(swept, "group", "left").select(
        *[F.col(f"group.`{c}`") for c in by], "calls", "summed", F.coalesce("busy", F.lit(0)).alias("busy"),
        F.coalesce("stretches", F.lit(0)).alias("stretches"))


def call_figures(log: DataFrame, rows: DataFrame, by: Sequence[str] = ("worker_id",), digits: int = 4) -> DataFrame:
    """Throughput of the calls in a run's log per group: Rows_Per_Sec over the time in which calls were under way, Tokens_Per_Sec
    over the model's time, Avg_Tokens_Per_Row, Tokens_Total. Without times of calls there is no Rows_Per_Sec."""
    used = token_usage(log, by).select(*by, "total_tokens", "total_duration_ns")
    counted = rows.groupBy(*by).agg(F.count("*").alias("n_rows")).join(used, list(by), "left")
    timed = counted.join(busy_time(log, by).select(*by, (F.col("busy") / 1e6).alias("sec")), list(by), "left")
    figures = with_rates(timed, "n_rows", "sec", "total_tokens", "total_duration_ns", digits)
    return figures.select(
        *by, F.when(F.col("sec").isNotNull(), F.col("rows_per_sec")).alias("Rows_Per_Sec"), F.col("tokens_per_sec").alias("Tokens_Per_Sec"),
        F.col("avg_tokens_per_row").alias("Avg_Tokens_Per_Row"), F.col("total_tokens").alias("Tokens_Total"))


def stamp_metadata(rows: DataFrame, meta: dict[str, object], part_metrics: DataFrame | None = None,
                   keys: Sequence[str] = ("worker_id", "part")) -> DataFrame:
    """Constants of the run and, per part, its figures on every row.

    Parts grow with the rows, so Spark picks the join and no broadcast is asked for.
    """
    stamped = rows.withColumns({name: F.lit(value) for name, value in meta.items()})
    return stamped if part_metrics is None else stamped.join(part_metrics, list(keys), "left")
