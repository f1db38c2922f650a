"""Exact top-k search by inner product on a bit-sliced index.

A block of vectors is stored as bitmaps: for every dimension one bitmap per bit of the (shifted) component, one bit per
row. The inner product with a query is a sum of such slices; adders made of AND and XOR carry it out for all rows of a
block at once and leave the score itself as bit slices. The best rows are then cut out from the most significant slice
downward; rows that tie at the border are resolved by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Components are integers below this size, so that differences of two fit a long. Sums of products may be of any size while they are
#: compared; only the scores that are returned have to be longs.
LIMIT = 1 << 61
INDEX_SCHEMA = "dim int, block long, rows int, ids binary, low binary, bits binary, slices binary"


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vectors: DataFrame, id_name: str, vector_name: str, scale: float) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector of finite components, as whole numbers."""
    fine = F.forall(vector_name, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.filter(F.col(id_name).isNotNull() & F.col(vector_name).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    whole = rows.select(F.col(id_name).cast("long").alias("vec_id"), quantised(F.col(vector_name), scale).alias("v"))
    small = F.forall("v", lambda x: (x > -LIMIT) & (x < LIMIT))
    return whole.select("vec_id", F.when(small, F.col("v")).otherwise(
        F.raise_error(F.lit(f"components must stay below {LIMIT} after scaling"))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def slice_block(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowest value and number of bits per dimension, and all slices: (sum of bits, words) of uint64."""
    n, dim = v.shape
    low = v.min(axis=0)
    bits = np.array([int(x).bit_length() for x in v.max(axis=0) - low], np.int64)
    words = -(-n // 64)
    out = np.zeros((int(bits.sum()), words), np.uint64)
    row = 0
    for d in range(dim):
        shifted = v[:, d] - low[d]
        for b in range(bits[d]):
            flags = np.zeros(words * 64, np.uint8)
            flags[:n] = (shifted >> b) & 1
            out[row] = np.packbits(flags, bitorder="little").view(np.uint64)
            row += 1
    return low, bits, out


def build_index(vectors: DataFrame, id_name: str = "vec_id", vector_name: str = "embedding", scale: float = 256.0,
                block_rows: int = 8192) -> DataFrame:
    """One row per block of at most ``block_rows`` vectors of one length, with its bit slices."""
    rows = usable(vectors, id_name, vector_name, scale)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in waiting[dim]])
            v = np.concatenate([x[1] for x in waiting[dim]])
            waiting[dim] = []
            order = np.argsort(ids, kind="stable")  # within a block, the first rows win ties
            low, bits, slices = slice_block(v[order])
            fields = [dim, int(ids.min()), len(ids), ids[order].tobytes(), low.tobytes(), bits.tobytes(), slices.tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([f], k) for f, k in zip(fields, kinds)],
                                              names=["dim", "block", "rows", "ids", "low", "bits", "slices"])

        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            ids = batch.column("vec_id").to_numpy()
            for dim in np.unique(sizes):
                where = np.flatnonzero(sizes == dim)
                v = _matrix(batch.column("v").take(pa.array(where)), int(dim))
                for a in range(0, len(where), block_rows):
                    waiting.setdefault(int(dim), []).append((ids[where[a:a + block_rows]], v[a:a + block_rows]))
                    have = sum(len(x[0]) for x in waiting[int(dim)])
                    if have >= block_rows:
                        yield block(int(dim))
        for dim, parts in waiting.items():
            if parts:
                yield block(dim)

    return rows.mapInArrow(build, INDEX_SCHEMA)


def add_slices(total: list[np.ndarray], more: list[np.ndarray], shift: int) -> None:
    """total += more << shift; both are bit slices from the least significant one upward."""
    carry = None
    for i, x in enumerate(more):
        at = i + shift
        while len(total) <= at:
            total.append(np.zeros_like(x))
        a = total[at]
        half = a ^ x
        if carry is None:
            total[at], carry = half, a & x
        else:
            total[at], carry = half ^ carry, (a & x) | (half & carry)
    at = shift + len(more)
    while carry is not None and carry.any():
        if len(total) <= at:
            total.append(carry)
            return
        total[at], carry = total[at] ^ carry, total[at] & carry
        at += 1


def scores(slices: np.ndarray, bits: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices of sum over d of weights[q, d] * x[d], for all queries: arrays of (queries, words).

    For each bit of the weights the slices of all dimensions whose weight has that bit are added up first.
    """
    starts = np.concatenate(([0], np.cumsum(bits)))
    total: list[np.ndarray] = []
    everywhere = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(int(weights.max(initial=0)).bit_length()):
        # Sums of equally many dimensions are added pairwise, so that short numbers meet short numbers.
        stack: list[tuple[int, list[np.ndarray]]] = []
        for d in range(len(bits)):
            if not bits[d]:
                continue
            mask = np.where((weights[:, d] >> b) & 1, everywhere, np.uint64(0))[:, None]
            if not mask.any():
                continue
            one = [slices[starts[d] + i][None, :] & mask for i in range(bits[d])]
            size = 1
            while stack and stack[-1][0] == size:
                other = stack.pop()[1]
                add_slices(other, one, 0)
                one, size = other, size * 2
            stack.append((size, one))
        for _, part in reversed(stack):
            add_slices(total, part, b)
    return total


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def select_top(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Bitmaps (queries, words) of at least the k best rows: sure rows and all rows that tie at the border."""
    sure = np.zeros_like(valid)
    open_ = valid.copy()
    for s in reversed(total):
        high = open_ & s
        enough = (_ones(sure) + _ones(high) >= k)[:, None]
        sure = np.where(enough, sure, sure | high)
        open_ = np.where(enough, high, open_ & ~s)
    return sure | open_


def rows_of(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row number of every set bit."""
    flags = np.unpackbits(np.ascontiguousarray(bitmap).view(np.uint8), axis=1, bitorder="little")
    return np.nonzero(flags)


def search_block(q: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, low: np.ndarray, bits: np.ndarray,
                 slices: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of the k best rows of a block for every query, rows with the query's id left out."""
    n = len(ids)
    # Weights and rows are made non-negative: x = low + y, q = base + w; sum q*x = sum w*y + base * sum y + sum q*low.
    # With one common base per query, sum y is itself a sum of slices, the same for all queries.
    base = np.minimum(q.min(axis=1, initial=0), 0)
    weights = q - base[:, None]
    total = scores(slices, bits, weights)
    down: list[np.ndarray] = []
    if (base < 0).any():
        plain = scores(slices, bits, np.ones((1, len(bits)), np.int64))
        for b in range(int((-base).max()).bit_length()):
            mask = np.where((-base >> b) & 1, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None]
            add_slices(down, [p & mask for p in plain], b)
    if down:
        total = subtract(total, down)
    words = -(-n // 64)
    valid = np.zeros(words * 64, np.uint8)
    valid[:n] = 1
    valid = np.repeat(np.packbits(valid, bitorder="little").view(np.uint64)[None, :], len(q), axis=0)
    left, right = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for i in np.flatnonzero(right > left):
        for r in range(left[i], right[i]):
            valid[i, r // 64] &= ~np.uint64(1 << (r % 64))
    who, row = rows_of(select_top(total, valid, k))
    # Where sums could leave a long they are put together as Python's integers.
    largest = max(map(abs, map(int, low)), default=0) + (1 << int(bits.max(initial=0)))
    kind = np.int64 if len(bits) * largest * int(np.abs(q).max(initial=0)) < 1 << 62 and len(total) < 63 else object
    value = np.zeros(len(who), np.int64).astype(kind)
    for i, s in enumerate(total):
        flag = ((s[who, row // 64] >> (row % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind)
        # After a subtraction the top slice is set where the number is not negative.
        value += (flag - 1 if down and i == len(total) - 1 else flag) << i
    value += (q.astype(kind) @ low.astype(kind))[who]
    if kind is object:
        return _longs(who, ids[row], value, k)
    order = np.lexsort((ids[row], -value, who))
    who, row, value = who[order], row[order], value[order]
    first = np.searchsorted(who, who, "left")
    keep = np.arange(len(who)) - first < k
    return who[keep], ids[row[keep]], value[keep]


def _longs(who: np.ndarray, found: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query for scores of any size; one among them that is no long is an error."""
    kept: list[tuple[int, int, int]] = []
    for number in np.unique(who):
        mine = np.flatnonzero(who == number)
        pairs = sorted((-int(v), int(i)) for v, i in zip(value[mine], found[mine]))[:k]
        kept += [(int(number), i, -v) for v, i in pairs]
    if any(not -(1 << 63) <= v < 1 << 63 for _, _, v in kept):
        raise OverflowError("a score among the best does not fit a long")
    out = np.array(kept, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def subtract(total: list[np.ndarray], down: list[np.ndarray]) -> list[np.ndarray]:
    """total - down in two's complement; the added top slice is the inverted sign, so that larger still sorts higher."""
    width = max(len(total), len(down)) + 1
    shape = (total or down)[0].shape
    zero = np.zeros(shape, np.uint64)
    everywhere = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, borrow = [], zero
    for i in range(width):
        a = total[i] if i < len(total) else zero
        b = down[i] if i < len(down) else zero
        half = a ^ b
        out.append(half ^ borrow)
        borrow = (~a & b) | (~half & borrow)
    out[-1] = out[-1] ^ everywhere
    return out


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, id_name: str = "vec_id",
          vector_name: str = "embedding", scale: float = 256.0, block_rows: int = 8192, query_block: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best rows by integer inner product, ties to the smaller id.

    Components x become floor(scale * x), which must stay below ``LIMIT`` in size; a score among a block's best that is no long is
    an error. ``queries`` (default: rows of ``vectors`` whose id is divisible by 50) is a
    table with the same two columns. It is cut into blocks of about ``query_block`` rows, and every block meets every
    block of the index once; no table is broadcast. A row never finds rows with its own id. Vectors that are null, hold
    null, NaN or infinite components, or have no id take no part; only vectors of equal length meet, and those of length
    0 score 0. Repeated ids are separate candidates; a repeated query id is one query per row, and its answers are the
    best k of them together. Fewer than k candidates give fewer rows; empty tables give none. Other columns are not read.
    """
    index = saved(build_index(vectors, id_name, vector_name, scale, block_rows), "bit-slices")
    asked = usable(queries if queries is not None else vectors.filter(F.col(id_name) % 50 == 0), id_name, vector_name, scale)
    n = asked.count()
    groups = max(1, -(-n // query_block))
    packed = (asked.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part"))
              .agg(F.collect_list(F.struct("vec_id", "v")).alias("asked")))
    slots = max(1, -(-index.count() // 4))
    met = (index.withColumn("slot", F.pmod(F.xxhash64("block", "rows"), F.lit(slots)))
           .join(packed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))), ["dim", "slot"]))
    schema = "query_id long, vec_id long, score long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                ids, low, bits = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("ids", "low", "bits"))
                slices = np.frombuffer(batch.column("slices")[r].as_buffer(), np.uint64)
                slices = slices.reshape(int(bits.sum()), -(-len(ids) // 64))
                asked = batch.column("asked")[r].values
                query_ids, q = asked.field("vec_id").to_numpy(), _matrix(asked.field("v"), dim)
                for a in range(0, len(q), query_block):
                    who, found, score = search_block(q[a:a + query_block], query_ids[a:a + query_block], ids, low, bits,
                                                     slices, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[a:a + query_block][who]), pa.array(found),
                                                      pa.array(score)], names=["query_id", "vec_id", "score"])

    return best(met.mapInArrow(search, schema), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: blocks give k each, so a query gathers k rows per block, cut down in two steps."""
    by = [F.col("score").desc(), F.col("vec_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*by)))
    few = few.filter(F.col("rank") <= k).drop("_salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
