"""Saved parts and final outputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import whole_div
from ..operators.merge import merge_parts

PART_KEYS = ("run_id", "label", "worker_id", "part_group")


def folder_name(label: str) -> str:
    """A label as a folder name, escaped in Spark's way for partition folders, so that reading gives the label back."""
    return re.sub(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", label)


def write_parts(df: DataFrame, path: str, run_id: str, label: str, parts_per_folder: int = 1) -> None:
    """Save rows that carry ``worker_id`` and ``part``, partitioned by run, label, worker and group of parts.

    Only folders that get rows are replaced, so writing the same parts again changes nothing. Choose
    ``parts_per_folder`` so that a folder holds a few hundred megabytes: small parts over a big table would otherwise
    make millions of folders. Every folder is written by one task.
    """
    stamped = df.withColumns({
        "run_id": F.lit(run_id), "label": F.lit(label),
        "part_group": whole_div(F.col("part") - 1, parts_per_folder),
    })
    (stamped.repartition("worker_id", "part_group")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PART_KEYS).parquet(path))


def read_partitioned(spark: SparkSession, path: str, text: tuple[str, ...], **options) -> DataFrame:
    """Parquet in named folders; the ``text`` folder columns stay text even if they look like numbers."""
    reader = spark.read.options(**options)
    found = reader.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in text else f for f in found.fields]
    return reader.schema(T.StructType(fields)).parquet(path)


def read_parts(spark: SparkSession, path: str, run_id: str, label: str | None = None,
               skip_corrupt: bool = False) -> DataFrame:
    """Saved rows of a run, and of one label if given; only the folders needed are read."""
    options = {"mergeSchema": True, "ignoreCorruptFiles": skip_corrupt}
    df = read_partitioned(spark, path, ("run_id", "label"), **options).filter(F.col("run_id") == run_id)
    return df if label is None else df.filter(F.col("label") == label)


def merged_parts(spark: SparkSession, path: str, run_id: str, label: str) -> DataFrame:
    return merge_parts(read_parts(spark, path, run_id, label), ("worker_id", "part", "pos_in_worker")).drop("part_group")


def write_output(df: DataFrame, path: str, form: str = "csv", single_file: bool = False) -> None:
    """Final output without an index column; one file only on request, as that makes one task write everything."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    if form == "csv":
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown output form: {form}")
