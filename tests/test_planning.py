"""Positions, ranges, batches and parts."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.operators import batches, position, ranges


def _positions(df, key, **options):
    return [r["position"] for r in position.with_position(df, key, **options).orderBy(key).collect()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gap_free_ids_need_no_shuffle(spark):
    df = spark.range(-3, 1000).repartition(5)
    stats = position.key_stats(df, "id")
    assert stats.dense and stats.rows == 1003
    numbered = position.with_position(spark.range(-3, 1000), "id", stats=stats)
    assert "Exchange" not in _plan(numbered) and "Window" not in _plan(numbered)
    assert _positions(df, "id") == list(range(1, 1004))


def test_count_equal_to_extent_is_not_enough(spark):
    df = spark.createDataFrame([(1,), (1,), (3,)], "id long")
    assert not position.key_stats(df, "id").dense
    assert sorted(_positions(df, "id")) == [1, 2, 3]


def test_gaps_take_ranges(spark):
    keys = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    assert _positions(df, "id", partitions=50) == list(range(1, 3001)) == _positions(df, "id")
    text = _plan(position.with_position(df, "id"))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "rangepartitioning" not in text


@pytest.mark.parametrize("make", [
    lambda i: i * i * i * 1_000_003,
    lambda i: f"k{i * 7919 % 100_000:05d}",
    lambda i: i / 7.0 if i % 3 else -i * 1000.0,
    lambda i: (1 << 62) + i if i % 2 else -(1 << 62) - i,
])
def test_keys_of_any_type_and_spread(spark, make):
    keys = sorted({make(i) for i in range(2000)})
    df = spark.createDataFrame([(k,) for k in keys], ["id"]).repartition(6)
    assert _positions(df, "id", partitions=40) == list(range(1, len(keys) + 1))


def test_clustered_keys(spark):
    keys = list(range(2900)) + [10 ** 12 + i * 10 ** 9 for i in range(100)]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    assert _positions(df, "id", partitions=20) == list(range(1, 3001))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_hot_key_is_spread_over_ranges(spark, kind):
    """A key that holds half of all rows is numbered by many tasks, and repeated keys are no error of any type."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 500).otherwise(F.col("id")).cast(kind).alias("k"), "id")
    placed = position.with_position(df, "k", partitions=16)
    assert sorted(r.position for r in placed.collect()) == list(range(1, 4001))
    sizes = [r["count"] for r in position.sorted_ranges(df, "k", "at", "part", 16).groupBy("part").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 4 * 4000 / 16
    known = {r.k: (r.low, r.high, r.n) for r in placed.groupBy("k").agg(
        F.min("position").alias("low"), F.max("position").alias("high"), F.count("*").alias("n")).collect()}
    low, high, n = known[500 if kind == "long" else "500"]
    assert n == 2000 and high - low + 1 == n


def test_rows_equal_in_all_columns(spark):
    df = spark.createDataFrame([(i if i < 1000 else 500,) for i in range(2000)], "id long").repartition(5)
    assert _positions(df, "id", partitions=9) == list(range(1, 2001))


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(i * 3, i, i, i, i, i, i) for i in range(20)],
                               "k long, tie long, at long, part long, n long, before long, `a.b` long")
    got = position.with_position(df, "k")
    assert got.columns == [*df.columns, "position"]
    assert all(tuple(r) == (i * 3, *[i] * 6, i + 1) for i, r in enumerate(got.orderBy("k").collect()))
    assert position.slice_by_position(df, "k", 2, 3).columns == df.columns


def test_null_keys_are_reported(spark):
    with pytest.raises(ValueError, match="NULL"):
        position.key_stats(spark.createDataFrame([(1,), (None,)], "id long"), "id")


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long")
    assert position.with_position(df, "id").count() == 0


def test_slices(spark):
    df = spark.createDataFrame([(i * 10,) for i in range(1, 101)], "RowID long")
    assert [r[0] for r in position.slice_by_position(df, "RowID", 3, 5).orderBy("RowID").collect()] == [30, 40, 50]
    assert [r[0] for r in position.slice_by_id(df, 3, 25).orderBy("RowID").collect()] == [10, 20]


def test_assign_row_id(spark):
    df = spark.createDataFrame([("b",), ("a",)], "name string")
    assert {tuple(r) for r in position.assign_row_id(df, "name", start=5).collect()} == {("a", 5), ("b", 6)}
    named = spark.createDataFrame([(9, "a")], "RowID long, name string")
    assert position.assign_row_id(named, "name").first()["RowID"] == 9


def test_running_sums_over_blocks(spark):
    rows = [(g, i, (i * 7 + g) % 13) for g in range(3) for i in range(0, 1000, g + 1)]
    df = spark.createDataFrame(rows, "g int, i long, v long")
    got = {(r["g"], r["i"]): r["s"] for r in position.running_sums(df, ["g"], "i", {"v": "s"}, width=64).collect()}
    for g in range(3):
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == g):
            total += v
            assert got[g, i] == total


def _ranges(spark, n, w):
    return [(r["start"], r["end"]) for r in ranges.plan_ranges(spark.range(n), w).orderBy("worker_id").collect()]


def test_even_ranges(spark):
    assert _ranges(spark, 10, 4) == [(1, 3), (4, 6), (7, 8), (9, 10)]
    assert _ranges(spark, 2, 4) == [(1, 1), (2, 2), (3, 2), (3, 2)]
    assert _ranges(spark, 0, 2) == [(1, 0), (1, 0)]


@settings(max_examples=8, deadline=None)
@given(n=st.integers(1, 300), w=st.integers(1, 40))
def test_closed_form_meets_the_ranges(spark, n, w):
    planned = _ranges(spark, n, w)
    assert [p for s, e in planned for p in range(s, e + 1)] == list(range(1, n + 1))
    rows = spark.range(1, n + 1).withColumnRenamed("id", "position")
    for r in ranges.assign_worker(rows, n, w).collect():
        start, end = planned[r["worker_id"] - 1]
        assert start <= r["position"] <= end and r["pos_in_worker"] == r["position"] - start + 1


def test_strategies(spark):
    df = spark.range(10)
    assert ranges.plan_by_strategy(df, None).collect()[0]["end"] == 10
    assert ranges.plan_by_strategy(df, "auto", 3).count() == 3
    assert ranges.plan_by_strategy(df, "manual", ranges=[(1, 4), (6, 9)]).count() == 2
    with pytest.raises(ValueError, match="unknown split strategy"):
        ranges.plan_by_strategy(df, "magic")


def test_range_join_keeps_overlaps_and_gaps(spark):
    given_ranges = [(1, 5), (4, 3000), (4000, 4000), (10, 2)]
    rows = spark.range(1, 5001).withColumnRenamed("id", "position")
    got = {(r["position"], r["worker_id"]) for r in ranges.range_join(rows, given_ranges).collect()}
    assert got == {(p, w) for w, (s, e) in enumerate(given_ranges, 1) for p in range(s, e + 1)}
    checked = ranges.check_ranges(ranges.plan_manual(spark, given_ranges[:3])).orderBy("worker_id").collect()
    assert [(r["gap"], r["overlap"]) for r in checked] == [(0, 0), (0, 2), (999, 0)]


@pytest.mark.parametrize("most", [1 << 17, 40, 0])
def test_ranges_of_very_unlike_lengths(spark, most):
    """One huge range and many tiny ones, with blocks broadcast, in part, or not at all."""
    rng = random.Random(7)
    given_ranges = [(-5, 1 << 40), (1, 1), (0, 0)] + [(s, s + rng.randrange(-2, 9)) for s in rng.sample(range(-3, 600), 200)]
    rows = spark.range(1, 501).select(F.col("id").alias("position"), F.lit(1).alias("level"), F.lit(2).alias("block"))
    df = ranges.range_join(rows, given_ranges, most=most)
    got = sorted((r["position"], r["worker_id"], r["pos_in_worker"]) for r in df.collect())
    assert got == sorted((p, w, p - s + 1) for w, (s, e) in enumerate(given_ranges, 1) for p in range(max(s, 1), min(e, 500) + 1))
    assert df.columns == ["position", "level", "block", "worker_id", "start", "end", "pos_in_worker"]
    text = _plan(df)
    assert "NestedLoop" not in text and "Cartesian" not in text and text.count("HashJoin") >= 1


def test_dyadic_pieces_are_few_and_exact(spark):
    plan = ranges.plan_manual(spark, [(1, (1 << 40) - 1), (3, 3), (5, 4), (-7, 9), (6, 11)])
    held, count = {}, {}
    for r in ranges.dyadic_pieces(plan).collect():
        count[r.worker_id] = count.get(r.worker_id, 0) + 1
        if r.worker_id > 1:
            held.setdefault(r.worker_id, []).extend(range(r.block << r.level, (r.block + 1) << r.level))
    assert count[1] <= 80 and {w: sorted(p) for w, p in held.items()} == {2: [3], 4: list(range(-7, 10)), 5: list(range(6, 12))}


def test_no_ranges(spark):
    rows = spark.range(1, 9).withColumnRenamed("id", "position")
    assert ranges.range_join(rows, []).count() == 0 == ranges.range_join(rows, [(4, 2)]).count()


def test_batches_and_calls(spark):
    rows = ranges.assign_worker(spark.range(1, 24).withColumnRenamed("id", "position"), 23, 2)
    calls = batches.estimate_calls(batches.chunk_batches(rows, 10), 10).orderBy("worker_id").collect()
    assert [(r["rows"], r["calls"]) for r in calls] == [(12, 2), (11, 2)]
    sizes = batches.chunk_batches(rows, 10).groupBy("worker_id", "batch_id").count().orderBy("worker_id", "batch_id")
    assert [r["count"] for r in sizes.collect()] == [10, 2, 10, 1]


@pytest.mark.parametrize("size, interval, n", [(10, 25, 120), (1, 50, 50), (7, 5, 100), (4, 6, 11), (20, 50, 99), (3, 3, 10)])
def test_parts_close_where_the_save_loop_would_close_them(spark, size, interval, n):
    expected, part, done = {}, 1, 0
    while done < n:
        step = min(size, n - done)
        expected.update({done + i + 1: part for i in range(step)})
        done += step
        if done % interval == 0 or done == n:
            part += 1
    rows = spark.range(1, n + 1).withColumnRenamed("id", "pos_in_worker")
    assert {r["pos_in_worker"]: r["part"] for r in batches.part_number(rows, size, interval).collect()} == expected
    assert max(expected.values()) == math.ceil(n / math.lcm(size, interval))


@pytest.mark.parametrize("size, total", [(10, 1000), (3, 50), (1, 7)])
def test_progress_points(spark, size, total):
    done = [min(d, total) for d in range(size, total + size, size)]
    df = batches.chunk_batches(spark.range(1, total + 1).select(F.lit(1).alias("worker_id"), F.col("id").alias("pos_in_worker")), size)
    step = max(size, total // 20)
    assert {r["done"] for r in batches.progress_points(df, size, F.lit(total).cast("long")).collect()} == {
        d for d in done if d % step == 0 or d == total}


def test_prompts_keep_order_and_fields(spark):
    df = spark.createDataFrame(
        [(i, None if i == 2 else "Neutral", "T" if i == 1 else " ", f"text {i}") for i in range(3, 0, -1)],
        "RowID long, Sentiment string, Title string, Message string")
    df = df.withColumns({"worker_id": F.lit(1), "batch_id": F.lit(0).cast("long"), "pos": F.col("RowID").cast("int")})
    unit = batches.batch_units(df, 5).first()
    assert [r["RowID"] for r in unit["rows"]] == [1, 2, 3]
    prompt = unit["prompt"]
    assert prompt.index("RowID: 1") < prompt.index("RowID: 2") < prompt.index("RowID: 3")
    assert prompt.count("Title: ") == 1 and "exactly 3 objects" in prompt and "message 2 of 3" in prompt
    singles = batches.batch_units(df, 1)
    assert {r["kind"] for r in singles.collect()} == {"row"}
    one = batches.batch_units(df.filter("RowID = 1"), 5).first()
    assert one["kind"] == "batch" and "exactly 1 objects" in one["prompt"]


@pytest.mark.parametrize("partitions", [None, 13])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_equal_keys_have_one_order_at_any_size(spark, kind, partitions):
    """However the rows are dealt out, each gets the same position."""
    rows = spark.range(300).select(
        F.floor(F.col("id") / 3 * 5).cast(kind).alias("k"), F.col("id").alias("v"), F.array("id").alias("a"))
    rows = rows.withColumn("k", F.when(F.col("v") % 50 < 5, F.lit(100).cast(kind)).otherwise(F.col("k")))
    orders = [{r.v: r.position for r in position.with_position(df, "k", partitions=partitions).collect()}
              for df in (rows.coalesce(1).orderBy("v"), rows.coalesce(1).orderBy(F.desc("v")), rows.repartition(7, F.hash("v")))]
    assert orders[0] == orders[1] == orders[2] and sorted(orders[0].values()) == list(range(1, 301))
