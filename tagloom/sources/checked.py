"""Saved parts with a ledger of their files, so that damaged ones are found and left out."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.position import row_hash
from ..session import work_folder
from .ledger import append, list_files
from .messages import path_exists
from .parts import PART_KEYS, folder_name, write_parts

FILE_KEYS = ("worker_id", "part_group", "part_file")
LEDGER_SCHEMA = (
    "worker_id int, part_group int, part_file string, rows long, checksum decimal(38,0), columns string, written_at timestamp")
NOTICE_SCHEMA = "worker_id int, part_group int, part_file string, state string, rows_wanted long, rows_found long"


def _folder(path: str, run_id: str, label: str) -> str:
    return f"{path.rstrip('/')}/run_id={folder_name(run_id)}/label={folder_name(label)}"


def _ledger(path: str, run_id: str, label: str) -> str:
    return _folder(f"{path.rstrip('/')}-ledger", run_id, label)


def _rows(spark: SparkSession, path: str, run_id: str, label: str, columns: T.StructType) -> DataFrame:
    """Rows of one run and label with the name of their file; a file that cannot be read gives no rows, or some."""
    schema = T.StructType([*columns.fields, *T.StructType.fromDDL("worker_id int, part_group int").fields])
    read = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(_folder(path, run_id, label))
    return read.withColumn("part_file", F.col("_metadata.file_name"))


def _sums(rows: DataFrame, columns: T.StructType) -> list[Column]:
    """Number of rows and an order-free checksum over them."""
    return [F.count("*").alias("rows"), F.sum(row_hash(rows.select(*[F.col(f"`{c}`") for c in columns.names])).cast("decimal(38,0)")).alias("checksum")]


def write_checked_parts(df: DataFrame, path: str, run_id: str, label: str, parts_per_folder: int = 1) -> None:
    """``write_parts``, then an entry in the ledger for every new file: its rows, checksum and columns.

    The files are read back once for that. A run that breaks off between the two leaves files that the ledger does
    not know; they count as ``unlisted`` until the parts are written again.
    """
    spark = df.sparkSession
    write_parts(df, path, run_id, label, parts_per_folder)
    if not path_exists(spark, _folder(path, run_id, label)):
        return  # no rows, so no parts
    columns = T.StructType([f for f in df.schema.fields if f.name not in PART_KEYS])
    rows = _rows(spark, path, run_id, label, columns)
    found = rows.groupBy(*FILE_KEYS).agg(*_sums(rows, columns))
    if path_exists(spark, _ledger(path, run_id, label)):
        known = spark.read.schema(LEDGER_SCHEMA).parquet(_ledger(path, run_id, label)).select(*FILE_KEYS)
        found = found.join(known, list(FILE_KEYS), "left_anti")
    append(found.select(*FILE_KEYS, "rows", "checksum", F.lit(columns.json()).alias("columns"), F.current_timestamp().alias("written_at")),
           _ledger(path, run_id, label))


def stored_columns(entries: DataFrame) -> T.StructType:
    """All columns that were ever written; few distinct texts, one per change of the columns."""
    written = [T.StructType.fromJson(json.loads(r[0])) for r in entries.select("columns").distinct().orderBy("columns").collect()]
    fields = {f.name: f for schema in written for f in schema.fields}
    changed = [f.name for schema in written for f in schema.fields if f.dataType != fields[f.name].dataType]
    if changed:
        raise ValueError(f"parts were written with other types of {', '.join(sorted(set(changed)))}")
    return T.StructType(list(fields.values()))


def checked_parts(spark: SparkSession, path: str, run_id: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the parts of one label that are as they were written, and a notice per file.

    A notice says ``good``, ``damaged`` (unreadable, or other rows than were written), ``missing`` (in the ledger, not in the
    folder) or ``unlisted`` (in the folder, not in the ledger); only good files give rows. Of a folder that was written again its
    newest entries count. The schema comes from the ledger, and only the folder of the run and label is listed: no footer is read
    for either. The files are read once for the check, whose notices are saved, and once for the rows.
    """
    keys = list(FILE_KEYS)
    entries = spark.read.schema(LEDGER_SCHEMA).parquet(_ledger(path, run_id, label))
    newest = entries.groupBy("worker_id", "part_group").agg(F.max("written_at").alias("written_at"))
    entries = entries.join(newest, ["worker_id", "part_group", "written_at"], "left_semi")
    columns = stored_columns(entries)
    rows = _rows(spark, path, run_id, label, columns)

    # A checksum covers the columns of its own file; columns that came later are not part of it.
    kinds = [r[0] for r in entries.select("columns").distinct().collect()]
    sums = [_sums(rows, T.StructType.fromJson(json.loads(kind)))[1].alias(f"sum_{i}") for i, kind in enumerate(kinds)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("rows_found"), *sums)
    own = reduce(lambda other, i: F.when(F.col("columns") == kinds[i], F.col(f"sum_{i}")).otherwise(other),
                 range(len(kinds)), F.lit(None).cast("decimal(38,0)"))

    pattern = r"worker_id=(\d+)/part_group=(\d+)/([^/]+)$"
    listed = list_files(spark, _folder(path, run_id, label), "*.parquet").select(*[
        F.regexp_extract("path", pattern, i + 1).cast(kind).alias(c)
        for i, (c, kind) in enumerate(zip(keys, ("int", "int", "string")))], F.lit(True).alias("listed"))
    joined = entries.withColumn("written", F.lit(True)).join(listed, keys, "full").join(found, keys, "left")
    intact = (F.col("rows") == F.col("rows_found")) & (F.col("checksum") == own)
    state = (F.when(F.col("listed").isNull(), "missing").when(F.col("written").isNull(), "unlisted")
             .when(intact, "good").otherwise("damaged"))
    notices = joined.select(*keys, state.alias("state"), F.col("rows").alias("rows_wanted"),
                            F.coalesce("rows_found", F.lit(0).cast("long")).alias("rows_found"))
    saved = work_folder(spark, "part-notices")
    notices.write.parquet(saved)
    notices = spark.read.schema(NOTICE_SCHEMA).parquet(saved)
    good = rows.join(notices.filter("state = 'good'").select(*keys), keys, "left_semi").drop("part_file")
    return good.withColumns({"run_id": F.lit(run_id), "label": F.lit(label)}), notices
