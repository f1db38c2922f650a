"""Row ranges: planning, preview, and which worker a row belongs to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import whole_div
from .position import free_names

# Pieces of ranges that are sent to every executor; those of a longer list are joined without a broadcast.
MAX_PIECES = 1 << 17
# Positions have 63 bits.
MAX_LEVEL = 62


def plan_ranges(df: DataFrame, n_workers: int, by: Sequence[str] = ()) -> DataFrame:
    """Even ranges over the row count, per ``by`` group: the first (n mod w) ranges hold one row more.

    With more workers than rows the last ranges are empty (end = start - 1).
    """
    if n_workers < 1:
        raise ValueError("at least one worker is needed")
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    workers = counts.select(*by, "_n", F.explode(F.sequence(F.lit(1), F.lit(n_workers))).alias("worker_id"))
    base = whole_div(F.col("_n"), n_workers)
    extra = F.col("_n") % n_workers
    before = F.col("worker_id") - 1
    start = before * base + F.least(before.cast("long"), extra) + 1
    size = base + F.when(F.col("worker_id") <= extra, 1).otherwise(0)
    return workers.select(*by, "worker_id", start.alias("start"), (start + size - 1).alias("end"))


def plan_single(df: DataFrame) -> DataFrame:
    """One range over all rows."""
    return plan_ranges(df, 1)


def plan_by_strategy(df: DataFrame, strategy: str | None, n_workers: int = 1,
                     ranges: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """``None`` (not parallel), ``auto`` or ``manual``; anything else is an error."""
    if strategy is None:
        return plan_single(df)
    if strategy == "auto":
        return plan_ranges(df, n_workers)
    if strategy == "manual":
        return plan_manual(df.sparkSession, ranges)
    raise ValueError(f"unknown split strategy: {strategy}")


def plan_manual(spark: SparkSession, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Ranges given by the user, numbered 1..k in their order."""
    rows = [(i, start, end) for i, (start, end) in enumerate(ranges, 1)]
    return spark.createDataFrame(rows, "worker_id int, start long, end long")


def check_ranges(ranges: DataFrame) -> DataFrame:
    """Rows left out before a range (``gap``) and rows shared with the range before it (``overlap``)."""
    # A plan has one row per worker.
    before = F.lag("end").over(Window.orderBy("start", "worker_id"))
    step = F.col("start") - F.coalesce(before, F.lit(0)) - 1
    return ranges.select("*", F.greatest(step, F.lit(0)).alias("gap"), F.greatest(-step, F.lit(0)).alias("overlap"))


def preview_plan(queue: DataFrame, n_workers: int, label: str = "label") -> DataFrame:
    """Per file and worker: start, end and rows."""
    return plan_ranges(queue, n_workers, [label]).withColumn("rows", F.col("end") - F.col("start") + 1)


def worker_columns(position: Column, n_rows: int, n_workers: int) -> tuple[Column, Column]:
    """Worker and position inside its range for an even plan, in closed form: no join with the ranges."""
    base, extra = divmod(n_rows, n_workers)
    longer = extra * (base + 1)
    at = position - 1
    in_longer = position <= longer
    worker = F.when(in_longer, whole_div(at, base + 1)).otherwise(extra + whole_div(at - longer, max(base, 1))) + 1
    inside = F.when(in_longer, at % (base + 1)).otherwise((at - longer) % max(base, 1)) + 1
    return worker.cast("int"), inside.cast("long")


def worker_rows(worker: Column, n_rows: int, n_workers: int) -> Column:
    """Number of rows of a worker in an even plan."""
    base, extra = divmod(n_rows, n_workers)
    return (F.lit(base) + F.when(worker <= extra, 1).otherwise(0)).cast("long")


def assign_worker(df: DataFrame, n_rows: int, n_workers: int, position: str = "position") -> DataFrame:
    """Add ``worker_id`` and ``pos_in_worker`` of an even plan."""
    worker, inside = worker_columns(F.col(position), n_rows, n_workers)
    return df.withColumns({"worker_id": worker, "pos_in_worker": inside})


def dyadic_pieces(ranges: DataFrame) -> DataFrame:
    """Every range as the fewest aligned blocks of 2^level positions: at most two per level.

    At each level the rest of a range lies between two block borders; a block that its neighbour does not pair with belongs to
    no larger block inside the range, so it is a piece.
    """
    level, low, high = F.col("level"), F.col("low"), F.col("high")
    levels = ranges.filter("start <= end").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))))
    # Block numbers from the first whole block on, up to but without ``high``.
    cut = levels.withColumns({
        "low": -F.call_function("shiftright", -F.col("start"), level), "high": F.call_function("shiftright", F.col("end") + 1, level)})
    cut = cut.filter("low < high")
    odd = [F.when(low.bitwiseAND(F.lit(1)) == 1, low), F.when(high.bitwiseAND(F.lit(1)) == 1, high - 1)]
    blocks = cut.withColumn("block", F.explode(F.array_compact(F.array(*odd))))
    return blocks.select(*ranges.columns, level.cast("int").alias("level"), "block")


def range_join(df: DataFrame, ranges: Sequence[tuple[int, int]], position: str = "position", most: int = MAX_PIECES) -> DataFrame:
    """Rows with the user-given range(s) that hold them, as ``worker_id, start, end, pos_in_worker``; a row in two ranges appears twice.

    Ranges are cut into aligned blocks of 1, 2, 4, ... positions, so that ranges of very unlike lengths are matched by
    equality: a row looks up one block per level that occurs, at most log2 of the longest range. Blocks are broadcast
    from the largest level down as long as there are at most ``most``; smaller blocks, which hold few positions each, are
    joined by a shuffle.
    """
    spark = df.sparkSession
    level, block = free_names(df, "level", "block")
    pieces = dyadic_pieces(plan_manual(spark, ranges)).withColumnsRenamed({"level": level, "block": block})
    # One entry per level, 63 at most.
    counts = {r[0]: r[1] for r in pieces.groupBy(level).count().collect()}
    sent, shuffled = [], []
    for n in sorted(counts, reverse=True):
        fits = not shuffled and sum(counts[x] for x in sent) + counts[n] <= most
        (sent if fits else shuffled).append(n)
    joined = []
    for levels, large in ((sent, False), (shuffled, True)):
        if levels or not (large or counts):
            keys = F.array(*[F.struct(F.lit(n).cast("int").alias(level), F.call_function("shiftright", F.col(f"`{position}`"), F.lit(n)).alias(block))
                             for n in levels or [0]])
            rows = df.select("*", F.inline(keys))
            held = pieces.filter(F.col(level).isin(*levels) if levels else F.lit(False))
            joined.append(rows.join(held if large else F.broadcast(held), [level, block]))
    found = reduce(DataFrame.unionByName, joined)
    return found.withColumn("pos_in_worker", F.col(f"`{position}`") - F.col("start") + 1).drop(level, block)
