"""Row positions without a global sort in one task.

``with_position`` gives the 1-based position of every row in the order of a key. There are two ways:

* keys that are whole numbers without gaps: position is ``key - low + 1``, no shuffle at all;
* every other key, of whatever type, size and spread: rows are sorted in ranges of (key, hash of the row), saved, and each
  brings its place in its range; the sizes of the ranges before it give the rest.

Ranges are bounded by key and row hash together, so a key of very many rows is spread over many ranges. Rows with equal keys
stand in the order of that hash, at every size and in every run; only rows that are equal in all columns cannot be told
apart. Saving cuts the lineage: a lost executor does not move a row. The table of ranges has a row per shuffle
partition and is the only thing that is summed up in one task and broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import whole_div
from ..session import work_folder

# Spark's increasing ids have the number of the partition above this many bits and the place in it below.
PLACE_BITS = 33


@dataclass(frozen=True)
class KeyStats:
    """Extent of the order key, read in one pass over that column alone."""

    rows: int
    low: object
    high: object
    dense: bool

    @property
    def integral(self) -> bool:
        return isinstance(self.low, int)


def key_stats(df: DataFrame, key: str, verify: bool = True) -> KeyStats:
    """Count and extent of ``key``. With ``verify`` gap-free keys are confirmed by an order-free fingerprint:

    XOR of the hashes over the data must equal XOR of the hashes over the plain range. With the row count equal to
    the extent this holds only if every number is there exactly once (up to a 64-bit hash clash).
    """
    integral = isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    column = F.col(key).cast("long") if integral else F.col(key)
    row = df.select(column.alias("k")).agg(
        F.count("*").alias("rows"), F.count("k").alias("known"), F.min("k").alias("low"), F.max("k").alias("high"),
        (F.bit_xor(F.xxhash64("k")) if integral and verify else F.max(F.lit(0))).alias("mark"),
    ).first()
    if row["known"] < row["rows"]:
        raise ValueError(f"order key {key} has NULLs")
    dense = integral and row["rows"] > 0 and row["high"] - row["low"] + 1 == row["rows"]
    if dense and verify:
        expected = df.sparkSession.range(row["low"], row["high"] + 1).agg(F.bit_xor(F.xxhash64("id"))).first()[0]
        dense = expected == row["mark"]
    return KeyStats(row["rows"], row["low"], row["high"], dense)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(df: DataFrame) -> Column:
    """Hash of a row; which columns are null is part of it, as Spark's hash passes over nulls."""
    # Maps have no hash, and within nested values nulls would be passed over.
    nested = (T.MapType, T.ArrayType, T.StructType, T.VariantType)
    named = [(F.col(f"`{f.name}`"), isinstance(f.dataType, nested)) for f in df.schema.fields]
    plain = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if deep else c for c, deep in named]
    return F.xxhash64(*plain, *[c.isNull() for c, _ in named])


def sorted_ranges(df: DataFrame, key: str, at: str, part: str, partitions: int | None = None) -> DataFrame:
    """``df`` sorted by key and row hash, saved, with the place ``at`` (rising in that order) and range ``part`` of every row."""
    tie, = free_names(df, "tie")
    order = [F.col(f"`{key}`"), F.col(tie)]
    rows = df.withColumn(tie, row_hash(df))
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).drop(tie).withColumn(at, F.monotonically_increasing_id())
    path = work_folder(df.sparkSession, "positions")
    ranged.write.parquet(path)
    return df.sparkSession.read.schema(ranged.schema).parquet(path).withColumn(part, F.shiftright(at, PLACE_BITS))


def _offsets(counts: DataFrame, part: str, n: str, out: str) -> DataFrame:
    """Rows in all parts before each one, for one row per part."""
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(out))


def with_position(df: DataFrame, key: str, out: str = "position", stats: KeyStats | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Add the 1-based position in the order of ``key``; equal keys in the order of the row's hash.

    Keys that are no gap-free whole numbers are sorted and saved when this is called, in ``partitions`` ranges or as many as
    the session shuffles into. Columns may have any names; one with the name ``out`` is replaced. An empty table
    stays empty; a null key is an error of ``key_stats``.
    """
    stats = stats or key_stats(df, key)
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    if stats.rows == 0:
        return df.select(*kept, F.lit(None).cast("long").alias(out))
    if stats.dense:
        return df.select(*kept, (F.col(f"`{key}`").cast("long") - F.lit(stats.low).cast("long") + 1).alias(out))
    at, part, n, before = free_names(df, "at", "part", "n", "before")
    placed = sorted_ranges(df, key, at, part, partitions)
    offsets = _offsets(placed.groupBy(part).agg(F.count("*").alias(n)), part, n, before)
    inside = F.col(at).bitwiseAND((1 << PLACE_BITS) - 1) + 1
    return placed.join(F.broadcast(offsets), part).select(*kept, (inside + F.col(before)).cast("long").alias(out))


def slice_by_position(df: DataFrame, key: str, start: int, end: int, stats: KeyStats | None = None) -> DataFrame:
    """Rows ``start`` to ``end``, both included, by position. With gap-free keys this reaches the scan as a pushed filter."""
    stats = stats or key_stats(df, key)
    if stats.dense:
        return slice_by_id(df, stats.low + start - 1, stats.low + end - 1, key)
    position, = free_names(df, "position")
    placed = with_position(df, key, position, stats)
    return placed.filter(F.col(position).between(start, end)).drop(position)


def slice_by_id(df: DataFrame, start: int, end: int, key: str = "RowID") -> DataFrame:
    """Rows with ``start <= key <= end``; gaps in the ids give fewer rows. Reaches the scan as a pushed filter."""
    return df.filter(F.col(f"`{key}`").between(start, end))


def assign_row_id(df: DataFrame, order_key: str, start: int = 1, out: str = "RowID",
                  stats: KeyStats | None = None) -> DataFrame:
    """Number the rows of a table that came without ids: start, start + 1, ..."""
    if out in df.columns:
        return df
    return with_position(df, order_key, out, stats).withColumn(out, F.col(out) + (start - 1))


def running_sums(df: DataFrame, group: Sequence[str], order: str, sums: Mapping[str, str],
                 width: int = 1 << 16) -> DataFrame:
    """Cumulative sums per group over a whole-number order column that is unique in its group.

    Each group is cut into blocks of ``width`` order values, so that no task holds a whole hot group: sums inside a
    block come from a window over that block, and blocks bring the total of the blocks before them.
    """
    cut = df.withColumn("_block", whole_div(F.col(order), width))
    keys = [*group, "_block"]
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys).agg(*[F.sum(c).alias(f"_total_{c}") for c in sums])
    carried = totals.select(
        *keys, *[F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_carry_{c}") for c in sums])
    partial = cut.select("*", *[F.sum(c).over(inside).alias(f"_part_{c}") for c in sums])
    joined = partial.join(carried, keys)
    return joined.select(
        *df.columns, *[(F.col(f"_part_{c}") + F.col(f"_carry_{c}")).alias(out) for c, out in sums.items()])
