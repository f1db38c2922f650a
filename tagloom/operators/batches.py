"""Batches of consecutive rows, their prompts, and the parts they are saved in."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import whole_div
from ..functions.text import Wording, batch_prompt, row_body, single_prompt
from ..sources.commits import slice_number

UNIT_KEYS = ("worker_id", "batch_id")


def batch_column(pos_in_worker: Column, size: int) -> Column:
    """0-based batch number of a row inside its worker."""
    return whole_div(pos_in_worker - 1, size)


def chunk_batches(df: DataFrame, size: int) -> DataFrame:
    """Add ``batch_id`` and the 1-based place in the batch; the last batch of a worker may be short."""
    if size < 1:
        raise ValueError("batch size must be positive")
    at = F.col("pos_in_worker")
    return df.withColumns({"batch_id": batch_column(at, size), "pos": ((at - 1) % size + 1).cast("int")})


def estimate_calls(df: DataFrame, size: int, by: Sequence[str] = ("worker_id",)) -> DataFrame:
    """Planned calls: full and started batches, counted per worker."""
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"))
    return counts.withColumn("calls", F.ceil(F.col("rows") / size))


def batch_units(df: DataFrame, size: int, keep: Sequence[str] = ("RowID", "Sentiment"), wording: Wording = Wording(),
                partitions: int | None = None, slices: int | None = None) -> DataFrame:
    """One row per batch: its rows in order (``keep`` columns only) and its prompt.

    A group holds at most ``size`` rows. The texts travel through one shuffle, into ``partitions`` partitions if that is
    given, and leave as part of the prompt. With ``slices`` the units have a number of their ``slice`` below that, and those of
    one slice share a partition. With batch size 1 the single-row prompt is used; a one-row rest of a larger
    size keeps the batch form.
    """
    if size == 1:
        return single_units(df, keep, wording, partitions, slices)
    sliced = ["slice"] if slices else []
    if slices:
        df = df.withColumn("slice", slice_number(UNIT_KEYS, slices))
    if partitions:
        df = df.repartition(partitions, *(sliced or UNIT_KEYS))
    body = row_body(F.col("RowID"), F.col("Sentiment"), F.col("Title"), F.col("Message"), wording)
    item = F.struct("pos", F.struct(*keep).alias("row"), body.alias("body"))
    groups = df.groupBy(*sliced, *UNIT_KEYS).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return groups.select(
        *sliced, *UNIT_KEYS, F.lit("batch").alias("kind"), F.lit(None).cast("long").alias("row_id"),
        F.col("_items.row").alias("rows"), batch_prompt(F.col("_items.body"), wording).alias("prompt"),
    )


def single_units(df: DataFrame, keep: Sequence[str] = ("RowID", "Sentiment"), wording: Wording = Wording(),
                 partitions: int | None = None, slices: int | None = None) -> DataFrame:
    """One row per message with the single-row prompt; no shuffle unless ``partitions`` is given."""
    sliced = ["slice"] if slices else []
    if slices:
        df = df.withColumn("slice", slice_number([*UNIT_KEYS, "RowID"], slices))
    if partitions:
        df = df.repartition(partitions, *(sliced or [*UNIT_KEYS, "RowID"]))
    prompt = single_prompt(F.col("RowID"), F.col("Sentiment"), F.col("Title"), F.col("Message"), wording)
    return df.select(
        *sliced, *UNIT_KEYS, F.lit("row").alias("kind"), F.col("RowID").cast("long").alias("row_id"),
        F.array(F.struct(*keep)).alias("rows"), prompt.alias("prompt"),
    )


def part_column(pos_in_worker: Column, size: int, interval: int) -> Column:
    """Number of the part that saves a row.

    A part is due when the row count is a multiple of ``interval``, but the count moves in steps of the batch size, so
    parts close every lcm(size, interval) rows.
    """
    return whole_div(pos_in_worker - 1, math.lcm(size, interval)) + 1


def part_number(df: DataFrame, size: int, interval: int) -> DataFrame:
    return df.withColumn("part", part_column(F.col("pos_in_worker"), size, interval))


def progress_points(rows: DataFrame, size: int, total: Column) -> DataFrame:
    """After which batches a worker reports progress, and the rows done by then.

    Reported are counts that are a multiple of max(size, total div 20), and the end. The count only moves by whole
    batches, so the last row of a batch stands for it: a filter, without any grouping. ``total`` is the worker's number
    of rows, for an even plan from ``ranges.worker_rows``.
    """
    done = rows.select("worker_id", "batch_id", F.col("pos_in_worker").alias("done"), total.alias("total"))
    at, end = F.col("done"), F.col("total")
    step = F.greatest(F.lit(size).cast("long"), whole_div(end, 20))
    return done.filter((at == end) | ((at % size == 0) & (at % step == 0)))
