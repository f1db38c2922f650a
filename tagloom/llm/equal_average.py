"""Vector codes: every part of a vector becomes the number of the nearest entry of its codebook.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their components. For vectors x and c of
dimension d, (sum x - sum c)^2 / d is never above their squared distance, so the search goes outward from the part's own sum
and ends where the squared gap of sums over d is strictly above the best distance so far; at equality an entry could
still tie with a smaller number. All arithmetic is in whole numbers.

A codebook holds ``entries`` x dimension whole numbers whatever the table's size; it is all that is sent to the tasks. Each
round is one pass in which a task adds up its rows and hands on one partial sum per entry component; partial sums are
combined by Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, saved

#: Up to this size of a component, squares and a task's sums fit 64 bits; larger ones are computed as Python integers.
SMALL = 1 << 26
#: Sums travel as digits in this base, so that no sum of digits over a table leaves 64 bits.
LIMB = 1 << 24
#: Rows that are searched together.
ROWS = 4096


@dataclass(frozen=True)
class Codebooks:
    """``values[part, entry, component]``, whole numbers (64-bit, or Python's own if a component is large)."""

    values: np.ndarray
    small: bool

    @property
    def parts(self) -> int:
        return self.values.shape[0]

    @property
    def dim(self) -> int:
        return self.values.shape[0] * self.values.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for v in self.values.ravel()).encode()).hexdigest()


def whole(vectors: np.ndarray, scale: int, small: bool) -> np.ndarray:
    """floor(scale * x) exactly, as 64-bit or as Python integers."""
    if small:
        return np.floor(vectors.astype(np.float64) * scale).astype(np.int64)
    out = np.empty(vectors.shape, object)
    # Doubles from 2^53 on are whole numbers.
    out[...] = [[int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in row] for row in vectors.tolist()]
    return out


class EqualAverage:
    """Nearest entries of all codebooks, parts sorted by the sum of their entries once."""

    def __init__(self, books: Codebooks):
        sums = books.values.sum(axis=2)
        self.order = np.stack([np.argsort(s, kind="stable") for s in sums])
        at = np.arange(books.parts)[:, None]
        self.sums, self.entries = sums[at, self.order], books.values[at, self.order]
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances of ``x[row, part, component]``; ties go to the smaller code."""
        rows, parts, d = x.shape
        n = self.order.shape[1]
        part = np.tile(np.arange(parts), rows)
        x = x.reshape(rows * parts, d)
        sums = x.sum(axis=1) if d else np.zeros(len(x), np.int64)
        right = np.zeros(len(x), np.int64)
        for p in range(parts):
            right[p::parts] = np.searchsorted(self.sums[p], sums[p::parts])
        left = right - 1
        best, code = np.zeros(len(x), x.dtype), np.full(len(x), n)
        active = np.arange(len(x))
        while len(active):
            p, l, r, s = part[active], left[active], right[active], sums[active]
            gap_l, gap_r = s - self.sums[p, np.maximum(l, 0)], self.sums[p, np.minimum(r, n - 1)] - s
            go_left = (l >= 0) & ((r >= n) | (gap_l <= gap_r))
            gap = np.where(go_left, gap_l, gap_r)
            # Nothing left on either side, or all that is left is too far away.
            on = ((l >= 0) | (r < n)) & ((code[active] == n) | (gap * gap <= best[active] * d)).astype(bool)
            active, p, go_left = active[on], p[on], go_left[on]
            at = np.where(go_left, l[on], r[on])
            left[active[go_left]] -= 1
            right[active[~go_left]] += 1
            diff = x[active] - self.entries[p, at]
            dist, entry = (diff * diff).sum(axis=1), self.order[p, at]
            self.compared += len(active)
            better = ((code[active] == n) | (dist < best[active]) | ((dist == best[active]) & (entry < code[active]))).astype(bool)
            best[active[better]], code[active[better]] = dist[better], entry[better]
        return code.reshape(rows, parts), best.reshape(rows, parts)


def _vectors(batch: pa.RecordBatch, books: Codebooks, scale: int) -> Iterator[np.ndarray]:
    """Blocks of whole-number vectors as ``[row, part, component]``."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, books.dim)
    for i in range(0, len(flat), ROWS):
        x = whole(flat[i:i + ROWS], scale, books.small)
        yield x.reshape(len(x), books.parts, books.values.shape[2])


def limbs(value: int, n: int) -> list[int]:
    """``value`` in base LIMB, lowest first; only the last digit has a sign."""
    out = []
    for _ in range(n - 1):
        out.append(value % LIMB)
        value //= LIMB
    return [*out, value]


def _next(rows: DataFrame, books: Codebooks, scale: int, digits: int) -> Codebooks:
    """Entries replaced by the floor of the mean of their parts; unused ones stay."""
    parts, n, d = books.values.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = EqualAverage(books)
        sums = np.zeros((parts * n, d), np.int64 if books.small else object)
        counts = np.zeros(parts * n, np.int64)
        for batch in batches:
            for x in _vectors(batch, books, scale):
                at = (search.nearest(x)[0] + np.arange(parts) * n).ravel()
                np.add.at(sums, at, x.reshape(-1, d))
                counts += np.bincount(at, minlength=parts * n)
        used = np.flatnonzero(counts)
        # One row per entry: its count, then the digits of each component's sum.
        cells = [[int(counts[e]), *[x for v in sums[e] for x in limbs(int(v), digits)]] for e in used]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(cells, pa.list_(pa.int64()))], names=["entry", "cells"])

    partial = rows.mapInArrow(add, "entry int, cells array<long>")
    total = partial.select("entry", F.posexplode("cells").alias("cell", "n")).groupBy("entry", "cell").agg(F.sum("n").alias("n"))
    values = books.values.reshape(parts * n, d).copy()
    found: dict[int, dict[int, int]] = {}
    # As many rows as the codebooks have numbers, plus one per entry.
    for r in total.toLocalIterator():
        found.setdefault(r.entry, {})[r.cell] = r.n
    for entry, cells in found.items():
        for k in range(d):
            total_k = reduce(lambda high, low: high * LIMB + low, [cells[1 + k * digits + j] for j in reversed(range(digits))])
            values[entry, k] = total_k // cells[0]
    return Codebooks(values.reshape(parts, n, d), books.small)


def usable(vector: Column) -> Column:
    """Vectors that are there and hold neither nulls nor NaN nor infinite components."""
    infinite = [float("inf"), float("-inf")]
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(infinite))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def compress(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
             id_name: str = "vec_id", vector_name: str = "embedding", label_name: str = "label") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` per usable vector.

    Component x counts as floor(scale * x). The codebooks start as the parts of the vectors with the smallest ids (null ids come
    last, and of repeated ids the smaller vector first); with fewer vectors than ``entries`` they have as many entries. ``code``
    holds two hex digits per part, ``error`` the squared distances to the chosen entries, ``label_error`` the errors of
    all rows with that label, null labels together.

    Left out are vectors that are null or empty, hold null or non-finite components, or whose length differs from that of the
    vector with the smallest id. That length must be a multiple of ``parts``, else it is an error. Components may
    be of any size; an error that is no 64-bit number ends the query. Repeated rows are coded one by one; a table without
    usable vectors gives an empty table. Other columns are not read, so their names cannot clash.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vector = F.col(f"`{vector_name}`").cast("array<double>")
    rows = embeddings.select(F.col(f"`{id_name}`").alias("vec_id"), F.col(f"`{label_name}`").alias("label"), vector.alias("v"))
    rows = rows.filter(usable(F.col("v")) & (F.size("v") > 0))
    firsts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(firsts[0].v) if firsts else parts
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows = rows.filter(F.size("v") == dim)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    largest = int(rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0) * scale
    small = largest < SMALL - scale
    # Enough for a component and for the sum over the rows of a task.
    digits = 2 if small else largest.bit_length() // 24 + 4
    start = whole(np.array([r.v for r in first], np.float64).reshape(len(first), dim), scale, small)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, dim // parts).transpose(1, 0, 2)), small)
    for _ in range(rounds if first else 0):
        books = _next(rows.select("v"), books, scale, digits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = EqualAverage(books)
        for batch in batches:
            codes, errors = [], []
            for x in _vectors(batch, books, scale):
                code, dist = search.nearest(x)
                codes += [row.tobytes().hex() for row in code.astype(np.uint8)]
                errors += [int(e) for e in dist.sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    coded = saved(rows.mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    # Null labels are a group of their own.
    on = ["known", "label_key"]
    coded = coded.withColumns({
        "known": F.col("label").isNotNull(), "label_key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = coded.groupBy(*on).agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows"))
    return hot_join(coded, sums, on, "n_rows").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
