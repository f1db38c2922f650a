"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks. Block i of a source of weight w is released at floor(i / w) and due at
ceil((i + 1) / w); a slot goes to the released block with the earliest deadline. Every source then has, at any slot, less
than one block more or less than its weight asks for. Weights are exact fractions. As whole numbers without a common
divisor they sum to a period, after which the schedule repeats; no more than one period of it is computed, and no more
than there are blocks to place.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_key, whole_row

#: Slots of a source that stand together in one row (a power of two), and how many slots are sent to every task.
RUN = 1 << 10
SENT_SLOTS = 1 << 24


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Positive whole numbers that sum to ``period``, nearest to the weights (largest remainders first)."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    i = 0
    while sum(out.values()) < period:
        out[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1, s))] -= 1
    return out


def _turn(order: list[str], weights: dict[str, int], total: int, left: dict[str, int] | None) -> tuple[dict[str, array], int, bool]:
    """The slots of every source, how many there are, and if they are a period: earliest deadline first.

    It ends after one period, or before the first slot that goes to a source without a block ``left``. ``order`` has the
    sources by falling weight, which is how the deadlines of their first blocks rise; ``total`` is the sum of the weights.
    """
    waiting: list[tuple[int, str, int]] = []  # (release, source, block)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    slots: dict[str, array] = {}
    slot, fresh, period = 0, 0, None
    while slot != period:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        if fresh < len(order) and (not ready or -(-total // weights[order[fresh]]) <= ready[0][0]):
            s, i = order[fresh], 0
            fresh += 1
        else:
            _, s, i = heapq.heappop(ready)
        if left is not None and i == left[s]:
            break
        slots.setdefault(s, array("q")).append(slot)
        heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
        slot += 1
        if slot == len(order):  # No period is shorter.
            period = total // math.gcd(*(weights[s] for s in order))
    return slots, slot, slot == period


def one_period(weights: dict[str, int]) -> list[str]:
    """The source of every slot, as many as the weights sum to."""
    total = sum(weights.values())
    slots, n, _ = _turn(sorted(weights, key=lambda s: (-weights[s], s)), weights, total, None)
    out = [""] * n
    for s, places in slots.items():
        for i in places:
            out[i] = s
    return out * (total // n)


@dataclass(frozen=True)
class Phase:
    """A stretch of the schedule with the same sources, which repeats after ``length`` slots.

    Of every source that has blocks in it: ``weights``, its blocks in ``length`` slots; their ``slots``; and ``first``, its
    number of blocks before the phase.
    """

    start: int
    weights: dict[str, int]
    slots: dict[str, array]
    first: dict[str, int]
    length: int

    def slot(self, source: str, block: int) -> int:
        turn, place = divmod(block - self.first[source], self.weights[source])
        return self.start + turn * self.length + self.slots[source][place]


def phases(blocks: dict[str, int], weights: dict[str, float | Fraction], period: int | None = None) -> list[Phase]:
    """One phase until the first source runs out, then one without it, and so on; no block is left over.

    Weights are taken exactly, or with a ``period`` rounded to multiples of 1 / ``period``.
    """
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    exact = {s: Fraction(weights[s]) for s in left}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    total = sum(whole.values())
    order = sorted(left, key=lambda s: (-whole[s], s))
    while left:
        if period is not None:
            whole, total = whole_weights({s: weights[s] for s in left}, period), period
            order = sorted(left, key=lambda s: (-whole[s], s))
        slots, length, repeats = _turn(order, whole, total, left)
        phase = Phase(start, {s: len(x) for s, x in slots.items()}, slots, {s: done[s] for s in slots}, length)
        out.append(phase)
        # The first slot that a source can't fill: the one after these slots, or in a later turn if they are a period.
        end = start + length
        if repeats:
            end = min(phase.slot(s, done[s] + left[s]) for s in left)
        turns, rest = divmod(end - start, length)
        for s, x in slots.items():
            used = turns * len(x) + bisect_left(x, rest)
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s], order[bisect_left(order, (-whole[s], s), key=lambda o: (-whole[o], o))]
                total -= whole[s]
        start = end
    return out


#: The columns that are added.
NEW = ("mix_source", "mix_block", "mix_slot", "mix_place")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 64,
        id_name: str = "doc_id", source_name: str = "source", text_name: str = "text", bucket_rows: int = 50_000,
        columns: list[str] | None = None) -> DataFrame:
    """All columns (or those named in ``columns``) of ``docs`` with ``mix_source, mix_block, mix_slot, mix_place``: the order to read the mixture in.

    The rows of a source are put in the order of a hash of id and text, and cut into blocks of ``block_rows`` rows (the
    last one may be shorter). ``mix_block`` counts a source's blocks from 0, ``mix_slot`` is the block's place in the
    schedule, ``mix_place`` the row's place in its block; sorted by slot and place the rows are the mixture. Up to any
    slot of a phase every source has had its weight's share of blocks, give or take less than one. When a source runs
    out, a new phase shares out its weight among the others. Weights default to equal ones; a source without one gets
    the mean of those given. Weights are not rounded: a float is the fraction it stands for. The driver holds an entry per
    source, and eight bytes per block at most (fewer where a period is shorter than its phase).

    A null source is a source of its own (``mix_source`` is empty). Ids and texts may be null or repeated; equal rows
    get different places. Every row is kept once. An empty table gives an empty table. A column of ``docs`` that is called
    like a new one is replaced by it; all others stay as they are.
    """
    source = F.coalesce(F.col(source_name), F.lit(""))
    order = F.xxhash64(F.col(id_name), text_key(text_name))
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in NEW]
    # The row travels as one column, so that no name can clash with those used here.
    rows = docs.select(whole_row(docs, kept).alias("_row"), F.col(id_name).alias("_id"), source.alias("mix_source"), order.alias("_order"),
                       F.xxhash64(F.lit("tie"), F.col(text_name)).alias("_tie"))
    counts = {r[0]: r[1] for r in rows.groupBy("mix_source").count().collect()}
    given = {s: Fraction(weights[s]) for s in counts if weights and s in weights}
    mean = sum(given.values()) / len(given) if given else Fraction(1)
    shares = {s: given.get(s, mean) for s in counts}
    if any(w <= 0 for w in shares.values()):
        raise ValueError("weights must be positive")
    plan = phases({s: -(-n // block_rows) for s, n in counts.items()}, shares)
    # Rows are numbered within buckets of the hash, and the buckets' counts are summed up: no task holds a source.
    bits = max(0, -(-sum(counts.values()) // bucket_rows) - 1).bit_length()
    rows = rows.withColumn("_part", F.shiftright("_order", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = rows.groupBy("mix_source", "_part").count()
    before = F.sum("count").over(Window.partitionBy("mix_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = saved(sizes.select("mix_source", "_part", F.coalesce(before, F.lit(0)).alias("_begin")), "begins")
    number = F.row_number().over(Window.partitionBy("mix_source", "_part").orderBy("_order", "_id", "_tie"))
    placed = rows.withColumn("_number", number).join(begins, ["mix_source", "_part"])
    place = F.col("_begin") + F.col("_number") - 1
    placed = placed.withColumns({"mix_block": F.floor(place / block_rows).cast("long"), "mix_place": (place % block_rows).cast("int")})
    # One row per source and phase, and the slots of one turn of it, cut into runs that rows meet by number.
    table, runs = [], []
    for p in plan:
        for s, slots in p.slots.items():
            table.append((s, p.first[s], p.start, p.weights[s], p.length, len(runs)))
            runs += [slots[i:i + RUN] for i in range(0, len(slots), RUN)]
    spark = docs.sparkSession
    stretches = spark.createDataFrame(table, "_s string, _first long, _start long, _weight long, _length long, _run0 long")
    latest = stretches.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_first", "_start", "_weight", "_length", "_run0"))).alias("_phases"))
    met = placed.join(F.broadcast(latest), F.col("mix_source") == F.col("_s"))
    phase = F.element_at(F.filter("_phases", lambda p: p["_first"] <= F.col("mix_block")), -1)
    met = met.withColumn("_phase", phase)
    turn = F.col("mix_block") - F.col("_phase._first")
    met = met.withColumns({"_turn": F.floor(turn / F.col("_phase._weight")).cast("long"), "_nth": turn % F.col("_phase._weight")})
    met = met.withColumn("_run", F.col("_phase._run0") + F.shiftright("_nth", RUN.bit_length() - 1))
    lengths = np.array([len(r) for r in runs], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    flat = np.frombuffer(b"".join(runs), np.int64)
    by_run = spark.createDataFrame(pa.table({
        "_r": pa.array(np.arange(len(runs), dtype=np.int64)), "_slots": pa.ListArray.from_arrays(offsets, pa.array(flat))}))
    met = met.join(F.broadcast(by_run) if len(flat) <= SENT_SLOTS else by_run, F.col("_run") == F.col("_r"))
    slot = (F.col("_phase._start") + F.col("_turn") * F.col("_phase._length")
            + F.element_at("_slots", (F.col("_nth") % RUN).cast("int") + 1))
    return met.select(*[F.col(f"_row.`{c}`") for c in kept], "mix_source", "mix_block", slot.alias("mix_slot"), "mix_place")
