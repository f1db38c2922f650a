"""Distributions, label notices and error counts of coded tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_class
from ..functions.text import metric_key

# Columns that are never counted, and the text that marks an error cell.
UNCOUNTED = ("RowID", "Message", "Title", "Model_Name", "Batch_Size", "Run_ID")
ERROR_TEXT = "ERROR"


def category_counts(df: DataFrame, limit: int = 50, skip: Sequence[str] = UNCOUNTED) -> DataFrame:
    """Value counts (column, value, n) of every column with fewer than ``limit`` distinct values, NULLs left out.

    One scan and one aggregation of bounded size. Per column it keeps a sketch of the distinct hashes and one of the
    values' counts. Both are exact up to ``limit`` values and merge, so no value is shuffled row by row: every task hands on at
    most some 2 * ``limit`` values per column, and these are merged in two steps. A column leaves only when that many
    values were really seen. A table without rows or without such columns gives no rows.
    """
    columns = [c for c in df.columns if c not in skip]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    names = [f"c{i}" for i in range(len(columns))]
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(columns, names)])
    # The hashes' sketch is exact up to 2 ** bits values; one more value is tracked because NULL counts as a value there.
    bits = max(4, math.ceil(math.log2(2 * limit)))
    kept = [F.expr(f"theta_sketch_agg(if({n} IS NULL, NULL, xxhash64({n})), {bits})").alias(f"{n}_seen") for n in names]
    kept += [F.expr(f"approx_top_k_accumulate({n}, {limit + 1})").alias(f"{n}_top") for n in names]
    kept += [F.count(n).alias(f"{n}_cells") for n in names]
    by_task = texts.groupBy(F.spark_partition_id().alias("task")).agg(*kept)
    merged = [F.struct(
        F.lit(c).alias("column"), F.expr(f"theta_sketch_estimate(theta_union_agg({n}_seen, {bits}))").alias("seen"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine({n}_top, {limit + 1}), {limit + 1})").alias("top"),
        F.sum(f"{n}_cells").alias("cells")) for c, n in zip(columns, names)]
    # A key, even a constant one, gives no row for an empty table, which the sketches could not be merged for.
    found = by_task.groupBy(F.lit("all")).agg(F.array(*merged).alias("found")).select(F.inline("found"))
    counts = F.filter("top", lambda t: t["item"].isNotNull())
    all_counted = F.aggregate(counts, F.lit(0).cast("long"), lambda n, t: n + t["count"]) == F.col("cells")
    few = found.filter(F.col("seen") < limit).withColumn("top", counts).filter((F.size("top") < limit) & all_counted)
    return few.select("column", F.inline("top")).toDF("column", "value", "n")


def _error_cells(df: DataFrame) -> Column:
    hits = [F.coalesce(F.contains(F.col(f"`{c}`").cast("string"), F.lit(ERROR_TEXT)).cast("int"), F.lit(0))
            for c in df.columns]
    return F.coalesce(F.sum(sum(hits[1:], hits[0])), F.lit(0)).alias("error_count")


def error_cells(df: DataFrame) -> DataFrame:
    """Cells (not rows) whose text contains the error mark, over all columns, in one pass."""
    return df.agg(_error_cells(df))


def metric_counts(counts: DataFrame) -> DataFrame:
    """Category counts under their metric names; names that meet are added up."""
    return counts.groupBy(metric_key(F.col("column"), F.col("value")).alias("metric")).agg(F.sum("n").alias("n"))


def analytics_row(df: DataFrame, facts: Mapping[str, object], limit: int = 50) -> DataFrame:
    """One wide row: the run's facts, total rows, one column per metric, error count.

    The metrics become column names, so they are read first: fewer than ``limit`` per counted column.
    """
    metrics = metric_counts(category_counts(df, limit)).orderBy("metric").collect()
    totals = df.agg(F.count("*").alias("total_rows"), _error_cells(df))
    return totals.select(
        *[F.lit(v).alias(k) for k, v in facts.items()], "total_rows",
        *[F.lit(r["n"]).cast("long").alias(r["metric"]) for r in metrics], "error_count")


def label_audit(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """How many labels of each ruled column fall into which class."""
    pairs = [F.struct(F.lit(c).alias("column"), label_class(F.col(f"`{c}`"), list(labels)).alias("class"))
             for c, labels in allowed.items()]
    return df.select(F.inline(F.array(*pairs))).groupBy("column", "class").agg(F.count("*").alias("n"))
