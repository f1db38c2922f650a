"""Putting parts and worker outputs together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that a table lacks is NULL there. Nothing is deduplicated."""
    if not tables:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_parts(parts: DataFrame, order: Sequence[str] = ("part", "pos_in_worker")) -> DataFrame:
    """Rows of all parts in part order, compared as numbers: a range-partitioned sort."""
    return parts.orderBy(*order)


def merge_outputs(outputs: Sequence[DataFrame] | DataFrame, sort_by: str | None = "RowID",
                  tie: Sequence[str] = ("worker_id", "pos_in_worker")) -> DataFrame:
    """Worker outputs as one table, sorted by ``sort_by`` if there is such a column.

    The tie columns make the order of equal values definite and let a hot value spread over several sort partitions.
    """
    merged = outputs if isinstance(outputs, DataFrame) else concat_by_name(outputs)
    if sort_by is None or sort_by not in merged.columns:
        return merged
    return merged.orderBy(sort_by, *[F.col(t) for t in tie if t in merged.columns])
