"""Attempts: what is still open, which attempt counts, and falling back to single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_state(log: DataFrame, unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Per unit: highest attempt so far and whether one was usable. One aggregation with partial sums, no window."""
    return log.groupBy(*unit).agg(F.max("attempt").alias("attempt"), F.bool_or("ok").alias("done"))


def retry_pending(log: DataFrame, retries: int, unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Units without a usable attempt that still have one left, with the number of the next one."""
    if retries < 1:
        raise ValueError("at least one attempt is needed")
    state = unit_state(log, unit)
    open_units = state.filter(~F.col("done") & (F.col("attempt") < retries))
    return open_units.select(*unit, (F.col("attempt") + 1).alias("next_attempt"))


def exhausted(log: DataFrame, retries: int, unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Units that used up their attempts."""
    return unit_state(log, unit).filter(~F.col("done") & (F.col("attempt") >= retries)).select(*unit)


def fallback_rows(units: DataFrame, failed: DataFrame, unit: Sequence[str] = ("worker_id", "batch_id")) -> DataFrame:
    """The rows of failed batches, each to be asked for alone."""
    return units.join(failed.select(*unit), list(unit), "left_semi").select(*unit, F.inline("rows"))


def resolve_attempts(log: DataFrame, values: Sequence[str], unit: Sequence[str] = ("unit_id",)) -> DataFrame:
    """First usable attempt per unit."""
    best = F.min_by(F.struct("attempt", *values), F.col("attempt")).alias("_best")
    return log.filter("ok").groupBy(*unit).agg(best).select(*unit, "_best.*")


def prefer_batch(batch: DataFrame, rows: DataFrame, values: Sequence[str], key: str = "RowID") -> DataFrame:
    """The answer from the batch if there is one, else the one from the row alone."""
    b, r = batch.alias("b"), rows.alias("r")
    joined = b.join(r, F.col(f"b.{key}") == F.col(f"r.{key}"), "full_outer")
    from_batch = F.col(f"b.{key}").isNotNull()
    return joined.select(
        F.coalesce(f"b.{key}", f"r.{key}").alias(key),
        *[F.when(from_batch, F.col(f"b.{v}")).otherwise(F.col(f"r.{v}")).alias(v) for v in values])
