"""Distributions, analytics and usage on small tables."""

import random

from pyspark.sql import functions as F

from tagloom.operators import audit, usage


def test_exact_limit_after_the_estimate(spark):
    df = spark.range(1000).select(
        (F.col("id") % 49).alias("few"), (F.col("id") % 50).alias("limit"), (F.col("id") % 60).alias("near"),
        F.col("id").alias("RowID"), F.when(F.col("id") < 3, "x").alias("rare"), F.lit(None).cast("string").alias("never"))
    counts = audit.category_counts(df).collect()
    assert {r["column"] for r in counts} == {"few", "rare"}
    assert {r["value"]: r["n"] for r in counts if r["column"] == "rare"} == {"x": 3}
    assert sum(r["n"] for r in counts if r["column"] == "few") == 1000
    assert audit.category_counts(df.select("RowID")).count() == 0


def test_a_hot_value_is_counted_like_any_other(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(
        F.concat(F.lit("v"), (F.col("id") % 20).cast("string"))).alias("label"))
    counts = {r["value"]: r["n"] for r in audit.category_counts(df).collect()}
    assert counts["hot"] == 20_000 and sum(counts.values()) == 30_000
    text = audit.category_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") + text.count("Range (0") == 1 and "partial_count" in text


def test_counts_need_one_scan_and_no_shuffle_of_values(spark, tmp_path):
    path = str(tmp_path / "coded")
    spark.range(20_000).selectExpr(
        "id AS RowID", "concat('a long text that no other row has ', id) AS Reason", "if(id % 7 = 0, '', concat('k', id % 48)) AS Topic",
        "if(id % 5 = 0, NULL, id % 2 = 0) AS Flag", "concat('long ', repeat('x', 500), id % 3) AS Wide").repartition(13).write.parquet(path)
    out = audit.category_counts(spark.read.parquet(path))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Window" not in text
    counts = {}
    for r in out.collect():
        counts.setdefault(r["column"], {})[r["value"]] = r["n"]
    assert set(counts) == {"Topic", "Flag", "Wide"}
    assert len(counts["Topic"]) == 49 and counts["Topic"][""] == 2858 and sum(counts["Topic"].values()) == 20_000
    assert counts["Flag"] == {"true": 8000, "false": 8000} and sum(counts["Wide"].values()) == 20_000
    assert audit.category_counts(spark.read.parquet(path).limit(0)).collect() == []
    assert {r["column"] for r in audit.category_counts(spark.read.parquet(path), limit=3).collect()} == {"Flag"}


def test_metric_names_that_meet_are_added_up(spark):
    df = spark.createDataFrame([("a b", "ERROR_X"), ("a-b", "y ERROR"), ("a_b", None)], "Key_Point string, Other string")
    row = audit.analytics_row(df, {"run_id": "r"}).first()
    assert row["run_id"] == "r" and row["total_rows"] == 3 and row["keypoint_a_b"] == 3 and row["error_count"] == 2


def test_usage_falls_through_zeros_and_nulls(spark):
    schema = ("prompt_eval_count long, prompt_tokens long, eval_count long, completion_tokens long, total_duration long, "
              "prompt_eval_duration long, eval_duration long")
    df = spark.createDataFrame([
        (5, 9, 7, 9, 100, 1, 1), (0, 9, None, 4, None, 30, 12), (None, None, 0, 0, 0, 50, 50), (None, 0, None, None, None, None, None),
    ], schema)
    assert usage.token_usage(df).first()[:] == (14, 11, 25, 142)


def test_rates_without_time_or_rows(spark):
    df = spark.createDataFrame([(0, 0.0, 5, 0), (10, 2.0, 40, 4_000_000_000)], "rows long, sec double, tokens long, nanos long")
    rows = usage.with_rates(df, "rows", "sec", "tokens", "nanos", 4).orderBy("rows").collect()
    assert [r[4:] for r in rows] == [(0.0, None, None), (5.0, 10.0, 4.0)]


def test_calls_that_overlap_count_once(spark):
    calls = [("a", 10, 20), ("a", 15, 30), ("a", 16, 18), ("a", 30, 35), ("a", 50, 60), ("a", 50, 60), ("a", 70, 70), ("a", 90, 80),
             ("a", None, 5), ("b", 0, 1000), ("b", 999, 1001), ("c", 4, 4), ("d", 7, None), (None, 1, 3), (None, 2, 9)]
    df = spark.createDataFrame(calls, "step string, started_us long, ended_us long")
    wanted = {("a", 8, 52, 35, 2), ("b", 2, 1002, 1001, 1), ("c", 1, 0, 0, 0), (None, 2, 9, 8, 1)}
    for blocks in (1, 7, 1 << 16):
        assert {tuple(r) for r in usage.busy_time(df, ["step"], blocks=blocks).collect()} == wanted
    assert [tuple(r) for r in usage.busy_time(df.filter("step = 'a'")).collect()] == [(8, 52, 35, 2)]
    assert usage.busy_time(df.filter("step = 'd'"), ["step"]).collect() == [] == usage.busy_time(df.limit(0)).collect()


def test_busy_time_against_a_plain_sweep(spark):
    rng = random.Random(5)
    calls = [(rng.choice("hhhhx"), t, t + rng.choice([0, 1, 5, 40, 3000])) for t in (rng.randrange(200_000) for _ in range(3000))]
    wanted = []
    for group in "hx":
        mine, busy, until, n = sorted(c[1:] for c in calls if c[0] == group and c[2] > c[1]), 0, -1, 0
        for a, b in mine:
            n += a > until
            busy += max(0, b - max(a, until))
            until = max(until, b)
        wanted.append((group, sum(c[0] == group for c in calls), sum(b - a for a, b in mine), busy, n))
    df = spark.createDataFrame(calls, "worker_id string, started_us long, ended_us long")
    assert sorted(map(tuple, usage.busy_time(df, ["worker_id"], blocks=50).collect())) == wanted
