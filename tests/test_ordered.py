"""Merging sorted outputs by their extents."""

import pytest
from pyspark.sql import functions as F

from tagloom.sources.ordered import islands, is_merged, merge_sorted, read_extents, read_merged, write_sorted


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, ids, **more):
    df = spark.createDataFrame([(i,) for i in ids], "RowID long")
    return df.withColumns({k: F.lit(v) for k, v in more.items()}).repartition(3)


def _place(spark, tmp_path):
    return str(tmp_path / "outputs"), str(tmp_path / "merged")


def _pairs(df, key="RowID"):
    return [r[key] for r in df.orderBy("merged_pos").collect()], [r[0] for r in df.select("merged_pos").orderBy("merged_pos").collect()]


def test_disjoint_outputs_are_not_moved(spark, tmp_path):
    path, out = _place(spark, tmp_path)
    write_sorted(_rows(spark, range(51, 101), b="x"), path, "w 2", ["RowID"], 4)
    write_sorted(_rows(spark, range(1, 51), a="y"), path, "w/1", ["RowID"], 3)
    merged = merge_sorted(spark, path, ["RowID"], out)
    assert _pairs(merged) == (list(range(1, 101)), list(range(1, 101)))
    assert {(r["a"], r["b"]) for r in merged.collect()} == {("y", None), (None, "x")}
    text = _plan(merged)
    assert "Sort" not in text and "Exchange" not in text.replace("BroadcastExchange", "")
    assert spark.read.parquet(f"{out}/places").filter("again").count() == 0 and is_merged(spark, out)
    some = read_merged(spark, path, out, first=45, last=60)
    assert _pairs(some) == (list(range(45, 61)), list(range(45, 61)))


def test_only_overlapping_files_are_sorted_again(spark, tmp_path):
    path, out = _place(spark, tmp_path)
    write_sorted(_rows(spark, range(1, 201)), path, "a", ["RowID"], 20)
    write_sorted(_rows(spark, [95, 95, 95, 105]), path, "late", ["RowID"], 1)
    write_sorted(_rows(spark, [None, None, 0]), path, "nulls", ["RowID"], 1)
    merged = merge_sorted(spark, path, ["RowID"], out)
    want = [None, None, 0] + sorted([*range(1, 201), 95, 95, 95, 105])
    assert _pairs(merged) == (want, list(range(1, 208)))
    places = spark.read.parquet(f"{out}/places")
    assert 0 < places.filter("again").agg(F.sum("rows")).first()[0] < 60 and places.filter("NOT again").count() >= 15
    # The same output written anew replaces its files.
    write_sorted(_rows(spark, [300]), path, "late", ["RowID"], 1)
    merged = merge_sorted(spark, path, ["RowID"], out)
    assert _pairs(merged)[0] == [None, None, 0, *range(1, 201), 300]
    assert spark.read.parquet(f"{out}/places").filter("again").count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_islands_with_files_between_them(spark, tmp_path, files):
    """Files that are sorted again do not reach from one island over others to the next, however few ranges there are."""
    path, out = _place(spark, tmp_path)
    write_sorted(_rows(spark, range(1, 101)), path, "a", ["RowID"], 10)
    for name, ids in (("x", [5, 6]), ("y", [55, 56]), ("z", [95, 95])):
        write_sorted(_rows(spark, ids, island="i"), path, name, ["RowID"], 1)
    spark.conf.set("spark.sql.shuffle.partitions", files)
    try:
        merged = merge_sorted(spark, path, ["RowID"], out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = sorted([*range(1, 101), 5, 6, 55, 56, 95, 95])
    assert _pairs(merged) == (want, list(range(1, 107))) and merged.columns == ["RowID", "island", "merged_pos"]
    assert spark.read.parquet(f"{out}/places").filter("again").agg(F.sum("rows")).first()[0] < 60


def test_one_key_in_many_files(spark, tmp_path):
    """Half of all rows share a key; with columns that tell them apart they are spread, and the order is definite."""
    path, out = _place(spark, tmp_path)
    for w in (1, 2):
        df = spark.createDataFrame([("same" if i % 2 else f"k{i:03}", w, i) for i in range(100)], "key string, worker int, pos int")
        write_sorted(df, path, str(w), ["key", "worker", "pos"], 8)
    merged = merge_sorted(spark, path, ["key", "worker", "pos"], out)
    found = [(r.key, r.worker, r.pos) for r in merged.orderBy("merged_pos").collect()]
    assert found == sorted(found) and len(found) == 200


def test_touching_extents(spark):
    ext = spark.createDataFrame([("a", "1", 1, 5), ("a", "2", 5, 9), ("b", "3", 8, 8), ("b", "4", 9, 9), ("b", "5", None, None)],
                                "name string, file string, low int, high int")
    found = {r["file"]: r["island"] for r in islands(ext.select("name", "file", F.struct("low").alias("low"), F.struct("high").alias("high"))).collect()}
    assert found == {"5": 1, "1": 2, "2": 3, "3": 3, "4": 4}


def test_odd_outputs(spark, tmp_path):
    path, out = _place(spark, tmp_path)
    write_sorted(_rows(spark, [], name="n", file="f", at=1, first=2, rows=3), path, "empty", ["RowID"], 2)
    with pytest.raises(Exception):
        merge_sorted(spark, str(tmp_path / "nothing"), ["RowID"], out)
    write_sorted(_rows(spark, [3, 1], name="n", file="f", at=1, first=2, rows=3), path, "two", ["RowID"], 2)
    write_sorted(_rows(spark, [2], name="m", file="g", low=1), path, "three", ["RowID"], 1)
    merged = merge_sorted(spark, path, ["RowID"], out)
    assert [(r.RowID, r.name, r.file, r.at, r.low) for r in merged.orderBy("merged_pos").collect()] == [
        (1, "n", "f", 1, None), (2, "m", "g", None, 1), (3, "n", "f", 1, None)]
    assert {r["name"] for r in read_extents(spark, path).collect()} == {"two", "three"}
    with pytest.raises(ValueError, match="RowID already"):
        merge_sorted(spark, path, ["RowID"], out, place="RowID")
