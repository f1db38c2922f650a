"""Input tables of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import concat_by_name
from ..operators.position import free_names

# Splits of an input (one for about 128 MB) whose first numbers are sent to the rows; those of a larger input are joined by a shuffle.
SENT_SPLITS = 1 << 16
REQUIRED = ("RowID", "Message")
OPTIONAL = ("Title", "Sentiment")

def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED,
                    optional: Sequence[str] = OPTIONAL) -> DataFrame:
    """Fail on a missing required column; add missing optional ones as NULL."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit(None).cast("string") for c in optional if c not in df.columns})


def na_as_null(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Text cells that equal one of the tokens become NULL, in one projection."""
    return df.select(*[
        F.when(~F.col(f"`{f.name}`").isin(*tokens), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; quoted line breaks and doubled quotes are right.

    Such files cannot be split, so one task reads one file: write the result as Parquet once and go on from there.
    """
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path)


def read_messages(spark: SparkSession, path: str, na_tokens: Sequence[str] | None = None,
                  form: str | None = None) -> DataFrame:
    """Messages from CSV or Parquet; without ``form`` a path that ends in ``.csv`` is CSV. Empty cells are NULL; texts such as ``None`` stay unless listed in ``na_tokens``."""
    df = require_columns(read_plain(spark, path, form))
    df = df.withColumn("RowID", F.col("RowID").cast("long"))
    return na_as_null(df, na_tokens) if na_tokens else df


def read_plain(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """A file or folder as it is; without ``form`` a path that ends in ``.csv`` is CSV."""
    form = form or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    return read_csv(spark, path) if form == "csv" else spark.read.format(form).load(path)


def in_file_order(df: DataFrame, file: str, block: str, at: str, out: str, start: int = 1) -> DataFrame:
    """Number rows from ``start`` on: files by path, splits of a file by their first byte, rows of a split as they were read.

    ``at`` must rise within every split. What is summed up is a row per split, within each file; only the files' totals, one row
    per file, are summed up in one task.
    """
    splits = df.groupBy(file, block).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy(file).agg(F.sum("_n").alias("_rows"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(file, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_files"))
    splits = splits.withColumn("_inside", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(files, file)
    shift = (F.col("_files") + F.col("_inside") - F.col("_first") + start).alias("_shift")
    shifts = splits.select(file, block, shift)
    if shifts.limit(SENT_SPLITS + 1).count() <= SENT_SPLITS:
        shifts = F.broadcast(shifts)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (file, block, at)]
    return df.join(shifts, [file, block]).select((F.col(at) + F.col("_shift")).cast("long").alias(out), *rest)


def land_messages(spark: SparkSession, path: str, folder: str, na_tokens: Sequence[str] | None = None,
                  form: str | None = None, start: int = 1) -> DataFrame:
    """Messages of a file or folder, written once to ``folder`` as Parquet and read from there ever after.

    A CSV file with quoted line breaks is parsed by one task, and only once. Messages without ``RowID`` get ``start``, start + 1,
    ... in file order: each row is landed with its file, its split and its place in the split. A table without rows stays
    empty. Landing that broke off is done again.
    """
    plain = read_plain(spark, path, form)
    numbered = "RowID" in plain.columns
    target = f"{folder}/{'numbered' if numbered else 'unnumbered'}"
    found = require_columns(plain, REQUIRED if numbered else ("Message",))
    file, block, at = free_names(found, "file", "block", "at")
    if na_tokens:
        found = na_as_null(found, na_tokens) if numbered else found
    if numbered:
        found = found.withColumn("RowID", F.col("RowID").cast("long"))
    else:
        place = {file: F.col("_metadata.file_path"), block: F.col("_metadata.file_block_start"), at: F.monotonically_increasing_id()}
        found = require_columns(plain.withColumns(place), ("Message",))
    if not path_exists(spark, f"{target}/_SUCCESS"):
        found.write.mode("overwrite").parquet(target)
    landed = spark.read.schema(found.schema).parquet(target)
    if numbered:
        return landed
    landed = in_file_order(landed, file, block, at, "RowID", start)
    return na_as_null(landed, na_tokens) if na_tokens else landed


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is a single file, on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isFile()


def read_queue(spark: SparkSession, queue: Sequence[tuple[str, str]],
               na_tokens: Sequence[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """All files of a queue of (path, label) as one table with ``label``, and a status row per file.

    A missing file is reported as ``file_not_found`` and the others go on.
    """
    tables, status = [], []
    for path, label in queue:
        found = path_exists(spark, path)
        status.append((label, path, "found" if found else "file_not_found"))
        if found:
            tables.append(read_messages(spark, path, na_tokens).withColumn("label", F.lit(label)))
    states = spark.createDataFrame(status, "label string, input_file string, status string")
    return (concat_by_name(tables) if tables else None), states
