"""What is left to do after an interrupted run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def high_water(parts: DataFrame, key: str = "RowID", part: str = "part", pos: str = "position") -> DataFrame:
    """One row: the id stored last in the highest part (NULL without parts)."""
    return parts.agg(F.max_by(key, F.struct(part, pos)).alias("last_id"))


def resume_high_water(df: DataFrame, parts: DataFrame, key: str = "RowID", part: str = "part",
                      pos: str = "position") -> DataFrame:
    """Rows with an id above the last saved one. Needs sorted ids and parts without holes; see ``resume_missing``."""
    last = high_water(parts, key, part, pos).first()["last_id"]
    return df if last is None else df.filter(F.col(key) > last)


def resume_missing(df: DataFrame, done: DataFrame, keys: Sequence[str] = ("RowID",)) -> DataFrame:
    """Rows that are not saved yet; also right for unsorted ids and lost parts."""
    return df.join(done.select(*keys), list(keys), "left_anti")


def resume_files(run_files: DataFrame, listing: DataFrame, plan: DataFrame) -> DataFrame:
    """Files to go on with: everything not completed.

    ``listing`` holds the input files that exist (input_file), ``plan`` the ranges for files without stored ones
    (label, ranges). Result: label, action (``process`` or ``input_missing``) and the ranges to use.
    """
    found = listing.select("input_file").distinct().withColumn("_found", F.lit(True))
    open_files = run_files.filter(F.coalesce("status", F.lit("pending")) != "completed")
    planned = plan.select("label", F.col("ranges").alias("_planned"))
    joined = open_files.join(found, "input_file", "left").join(planned, "label", "left")
    stored = F.when(F.size("ranges") > 0, F.col("ranges"))
    there = F.col("_found").isNotNull()
    return joined.select(
        "label", "input_file",
        F.when(there, "process").otherwise("input_missing").alias("action"),
        F.when(there, F.coalesce(stored, "_planned")).alias("ranges"))


def latest_run(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """The greatest run id by name, as one row."""
    return runs.agg(F.max(run_id).alias(run_id))
