"""Sorted outputs with stored extents, and merging them without sorting again.

An output is written once as files that are sorted inside and do not overlap; a ledger holds the rows and the first and last key of
every file. To merge outputs, the files are put in order by these extents. A row's place is then the number of rows in
the files before plus its place in its own file, so no row is moved. Only files whose extents overlap are sorted once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.position import free_names
from .checked import stored_columns
from .messages import path_exists
from .parts import folder_name

#: Files whose places are sent to the rows; those of more files are joined by a shuffle.
SENT_FILES = 1 << 16


def _key(order: Sequence[str]) -> Column:
    """The order columns as one value; numbered names, so that outputs may be compared whatever their columns are called."""
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)])


def _output(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{folder_name(name)}"


def _ledger(path: str, name: str | None = None) -> str:
    return f"{path.rstrip('/')}-extents" + (f"/output={folder_name(name)}" if name is not None else "")


def _file() -> Column:
    """The file of a row by its folder and name, as the same name may be in several folders."""
    return F.substring_index("_metadata.file_path", "/", -2)


def write_sorted(df: DataFrame, path: str, name: str, order: Sequence[str], files: int | None = None, split: str | None = None) -> None:
    """Write an output below ``path`` as files in ``order`` (nulls first) and note their extents; an output of the same name is replaced.

    ``files`` is the number of ranges, by default that of shuffle partitions. Rows with one key may lie in two neighbouring
    files, unless ``order`` names columns that tell them apart. An output without rows has no entry, so its columns do not count.
    No file holds rows of two values of ``split``, a column that goes before the order and is not kept.
    The order columns are read back once for the extents.
    """
    spark, target = df.sparkSession, _output(path, name)
    keys = [F.col(f"`{c}`") for c in ([split] if split else []) + [*order]]
    columns = T.StructType([f for f in df.schema.fields if f.name != split])
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).parquet(target)
    extents = _read(spark, path, [name], columns, _file().alias("_file")).groupBy(F.col("_file").alias("file")).agg(
        F.count("*").alias("rows"), F.min(_key(order)).alias("low"), F.max(_key(order)).alias("high"))
    extents.select(F.lit(name).alias("name"), "*", F.lit(columns.json()).alias("columns")).write.mode("overwrite").parquet(
        _ledger(path, name))


def read_extents(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of all outputs below a path: a row per file."""
    return spark.read.parquet(_ledger(path)).drop("output")


def islands(extents: DataFrame) -> DataFrame:
    """Files with their ``island``: those whose extents overlap, directly or by others between them, have the same number.

    Files that only touch (the last key of one is the first of the next) do not overlap. This is a sweep over one row per file.
    """
    by = Window.orderBy("low", "high", "name", "file")
    before = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("low") >= before)).cast("long")
    marked = extents.withColumn("_fresh", fresh)
    return marked.withColumn("island", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def _read(spark: SparkSession, path: str, names: Sequence[str], columns: T.StructType, *more: Column) -> DataFrame:
    """Rows of some outputs: their columns, which leaves out those of folder names, and what is said about the file."""
    rows = spark.read.schema(columns).parquet(*[_output(path, n) for n in names])
    return rows.select(*[F.col(f"`{c}`") for c in columns.names], *more)


def merge_sorted(spark: SparkSession, path: str, order: Sequence[str], out: str, place: str = "merged_pos") -> DataFrame:
    """All rows of the outputs below ``path`` with their 1-based ``place`` in the merged order; columns that an output lacks are null.

    ``order`` is that of ``write_sorted``. Files that overlap with others are sorted together and written to ``out``, island by
    island in one range sort; all others are read where they are. The places of the files are kept in ``out``, so a later
    ``read_merged`` gives the same table without any of this.
    """
    extents = read_extents(spark, path)
    # One entry per output.
    names = [r[0] for r in extents.select("name").distinct().orderBy("name").collect()]
    columns = stored_columns(extents)
    if place in columns.names:
        raise ValueError(f"there is a column {place} already")
    found = islands(extents)
    crowded = found.groupBy("island").count().filter("count > 1").select("island")
    mixed = found.join(_sent(crowded), "island", "left_semi").select("file", "island")
    saved = f"{out}/mixed"
    mixed.write.mode("overwrite").parquet(saved)
    mixed = spark.read.schema("file string, island long").parquet(saved)
    kept = extents.join(mixed.select("file"), "file", "left_anti").withColumn("again", F.lit(False))
    if not mixed.isEmpty():
        file, island = free_names(_read(spark, path, names, columns), "file", "island")
        rows = _read(spark, path, names, columns, _file().alias(file))
        rows = rows.join(_sent(mixed.select(F.col("file").alias(file), F.col("island").alias(island))), file).drop(file)
        # A file with rows of two islands would reach over the files between them.
        write_sorted(rows, f"{out}/sorted", "again", order, split=island)
        kept = kept.unionByName(read_extents(spark, f"{out}/sorted").withColumn("again", F.lit(True)))
    by = Window.orderBy("low", "high", "name", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("first", F.coalesce(F.sum("rows").over(by), F.lit(0)) + 1)
    placed.select("name", "file", "rows", "first", "again", "low", "high", "columns").write.mode("overwrite").parquet(f"{out}/places")
    return read_merged(spark, path, out, place)


def _sent(files: DataFrame) -> DataFrame:
    """A table of files, marked to be sent around if it is small; a row is a file, so it is counted first."""
    return F.broadcast(files) if files.limit(SENT_FILES + 1).count() <= SENT_FILES else files


def read_merged(spark: SparkSession, path: str, out: str, place: str = "merged_pos", first: int | None = None,
                last: int | None = None) -> DataFrame:
    """The table of ``merge_sorted``, or its rows ``first`` to ``last``: then only the files that hold them give rows.

    The place comes from the file's own row numbers, so nothing is shuffled or sorted. An empty merge gives an empty table.
    """
    places = spark.read.parquet(f"{out}/places")
    columns = stored_columns(places)
    if first is not None:
        places = places.filter(F.col("first") + F.col("rows") > first)
    if last is not None:
        places = places.filter(F.col("first") <= last)
    tables = []
    for again, base in ((False, path), (True, f"{out}/sorted")):
        some = places.filter(F.col("again") == again)
        # One entry per output.
        names = [r[0] for r in some.select("name").distinct().orderBy("name").collect()]
        if not names:
            continue
        file, at, start = free_names(_read(spark, base, names, columns), "file", "at", "start")
        rows = _read(spark, base, names, columns, _file().alias(file), F.col("_metadata.row_index").alias(at))
        starts = _sent(some.select(F.col("file").alias(file), F.col("first").alias(start)))
        found = rows.join(starts, file).withColumn(place, (F.col(start) + F.col(at)).cast("long"))
        tables.append(found.drop(file, at, start))
    if not tables:
        return spark.createDataFrame([], T.StructType([*columns.fields, T.StructField(place, T.LongType())]))
    merged = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    if first is not None:
        merged = merged.filter(F.col(place) >= first)
    if last is not None:
        merged = merged.filter(F.col(place) <= last)
    return merged


def is_merged(spark: SparkSession, out: str) -> bool:
    """Whether a merge was finished."""
    return path_exists(spark, f"{out}/places/_SUCCESS")
