"""Helpers shared by the operators: text buffers as numpy arrays, hashing, saved tables, hot join keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, work_folder

#: A key counts as hot with this share of all rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001


#: Rows that Spark hands to Python at once: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) != BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage, and nothing is computed twice."""
    small_batches(df.sparkSession)
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Columns (all of them) as one struct, whatever their names: nothing beside it can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def text_key(name: str = "text") -> Column:
    """With the id, this tells documents apart even where ids are null or repeated."""
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def held_out(id_name: str, modulus: int, remainder: int) -> Column:
    """True for rows whose label must not be learnt; a null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(F.col(id_name).cast("string")) % modulus == remainder, F.lit(False))


def buffers(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and the bytes of a binary column without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every ``data[start:end]``; equal bytes give equal hashes wherever they stand.

    Spans must be in order and not overlap. Only about ``step`` bytes (or one span) are in work at a time.
    """
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        n = max(step, high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data[low:high]] * _powers(_BASE, n)[:high - low], out=sums[1:])
        first, last = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix64((sums[last] - sums[first]) * _powers(_INVERSE, n)[first] + (last - first).astype(np.uint64))
        a = b
    return out


def translated(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def words_table(keep: str, lower: bool = True) -> bytes:
    """A byte translation that lower-cases A-Z and turns all bytes outside words into blanks.

    ``keep`` is "alnum" (letters, digits and all bytes from 0x80) or "visible" (all but ASCII white space).
    """
    out = bytearray(range(256))
    for b in range(256):
        blank = b in (0x20, 9, 10, 11, 12, 13) if keep == "visible" else b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b < 0x80
        if lower and 0x41 <= b <= 0x5A:
            out[b] = b + 32
        elif blank:
            out[b] = 0x20
    return bytes(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a translated buffer, and the row each belongs to; rows are never joined."""
    word = data != 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = word & (edge[:-1] | ~np.concatenate(([False], word[:-1])))
    edge[len(data)] = True
    last = word & (edge[1:] | ~np.concatenate((word[1:], [False])))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def sized(df: DataFrame, most: int = 1 << 17) -> DataFrame:
    """``df`` as the side of a join that is sent around if it has at most ``most`` (short) rows, else shuffled and hashed."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("shuffle_hash")


def hot_join(left: DataFrame, groups: DataFrame, on: list[str], rows: str) -> DataFrame:
    """Inner join of ``left`` with one row per key of ``groups``; ``groups.rows`` counts the left rows of the key.

    Keys with over HOT_SHARE of the rows (and over 10,000) are at most 1 / HOT_SHARE in number, so these are broadcast
    and their rows stay where they are; all other keys are shuffled.
    """
    total = groups.agg(F.sum(rows)).first()[0] or 0
    hot = groups.filter(F.col(rows) > max(10_000, int(total * HOT_SHARE)))
    if not hot.take(1):
        return left.join(groups, on)
    marked = left.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(groups, on)
    return left.join(F.broadcast(hot), on).unionByName(cold)
