"""Sources, saved parts, ledgers, resuming and merging."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagloom.operators import merge, resume, runs
from tagloom.sources import ledger, messages, parts
from tagloom.queries.saving import harm
from tagloom.sources.checked import checked_parts, write_checked_parts
from tagloom.sources.messages import land_messages


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('RowID,Title,Message,Sentiment\n1,"a ""b""","line\nline, two",\n2,NA,None,"NULL"\n', encoding="utf-8")
    rows = messages.read_messages(spark, str(path)).orderBy("RowID").collect()
    assert [tuple(r) for r in rows] == [(1, 'a "b"', "line\nline, two", None), (2, "NA", "None", "NULL")]
    rows = messages.read_messages(spark, str(path), na_tokens=["NA", "NULL", "None"]).orderBy("RowID").collect()
    assert tuple(rows[1]) == (2, None, None, None)


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "m")], "RowID long, Message string")
    assert messages.require_columns(df).columns == ["RowID", "Message", "Title", "Sentiment"]
    with pytest.raises(ValueError, match="Message"):
        messages.require_columns(df.drop("Message"))


def test_queue_goes_on_after_a_missing_file(spark, tmp_path):
    for name, ids in (("a", [1, 2]), ("b", [1])):
        (tmp_path / f"{name}.csv").write_text("RowID,Message\n" + "".join(f"{i},m\n" for i in ids))
    queue = [(str(tmp_path / f"{n}.csv"), n) for n in ("a", "x", "b")]
    rows, status = messages.read_queue(spark, queue)
    assert {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()} == {"a": 2, "b": 1}
    assert {r["label"]: r["status"] for r in status.collect()} == {"a": "found", "x": "file_not_found", "b": "found"}
    assert messages.read_queue(spark, queue[1:2])[0] is None


def _coded(spark, n=100):
    pos = F.col("id")
    return spark.range(1, n + 1).select(
        pos.alias("RowID"), F.concat(F.lit("t"), pos.cast("string")).alias("Topic"),
        (F.floor((pos - 1) / 50) + 1).cast("int").alias("worker_id"),
        (F.floor((pos - 1) % 50 / 10) + 1).cast("long").alias("part"), ((pos - 1) % 50 + 1).alias("pos_in_worker"))


def test_saving_parts_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = _coded(spark)
    parts.write_parts(rows, path, "r1", "a")
    parts.write_parts(rows.filter("worker_id = 1"), path, "r1", "a")
    parts.write_parts(rows.limit(3), path, "r1", "b")
    parts.write_parts(rows.limit(2), path, "r2", "a")
    merged = parts.merged_parts(spark, path, "r1", "a").collect()
    assert [r["RowID"] for r in merged] == list(range(1, 101))
    assert parts.read_parts(spark, path, "r1").count() == 103
    # Names that look like numbers stay as they are.
    for label in ("007", "7"):
        parts.write_parts(rows.limit(1), str(tmp_path / "numbers"), "01", label)
    assert [r["label"] for r in parts.read_parts(spark, str(tmp_path / "numbers"), "01", "007").collect()] == ["007"]


def test_lost_parts_are_found_and_redone(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = _coded(spark)
    parts.write_parts(rows.filter("not (worker_id = 1 and part in (2, 4)) and not (worker_id = 2 and part = 5)"),
                      path, "r1", "a")
    left = resume.resume_missing(rows, parts.read_parts(spark, path, "r1", "a"))
    assert {(r["worker_id"], r["part"]) for r in left.collect()} == {(1, 2), (1, 4), (2, 5)}
    parts.write_parts(left, path, "r1", "a")
    again = parts.merged_parts(spark, path, "r1", "a").select(*rows.columns).collect()
    assert sorted(again) == sorted(rows.collect())


def test_high_water(spark):
    rows = spark.range(1, 101).withColumnRenamed("id", "RowID")
    saved = spark.createDataFrame([(i, (i - 1) // 10 + 1, i) for i in range(1, 51) if i != 30],
                                  "RowID long, part long, position long")
    assert resume.resume_high_water(rows, saved).agg(F.min("RowID"), F.count("*")).first()[:] == (51, 50)
    assert resume.resume_high_water(rows, saved.limit(0)).count() == 100
    assert {r["RowID"] for r in resume.resume_missing(rows, saved).collect()} == {30, *range(51, 101)}
    # Ids that do not rise: the row saved last decides, not the greatest id.
    unsorted = spark.createDataFrame([(9, 1, 1), (4, 2, 2)], "RowID long, part long, position long")
    assert resume.high_water(unsorted).first()["last_id"] == 4


def test_parts_sort_as_numbers_and_lacking_columns_are_null(spark):
    a = spark.createDataFrame([(9999, 1, "x"), (10000, 1, "y")], "part long, pos_in_worker long, v string")
    b = spark.createDataFrame([(9998, 1)], "part long, pos_in_worker long")
    rows = merge.merge_parts(merge.concat_by_name([a, b])).collect()
    assert [(r["part"], r["v"]) for r in rows] == [(9998, None), (9999, "x"), (10000, "y")]
    with pytest.raises(ValueError):
        merge.concat_by_name([])


def test_merge_sorts_only_by_a_column_that_is_there(spark):
    a = spark.createDataFrame([(2, 1, 1), (1, 1, 2)], "RowID long, worker_id int, pos_in_worker long")
    assert [r["RowID"] for r in merge.merge_outputs([a]).collect()] == [1, 2]
    assert merge.merge_outputs([a], "nothing").count() == 2
    assert merge.merge_outputs(a, None).count() == 2


def test_output_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "q"\nb '), (2, None)], "RowID long, v string")
    parts.write_output(df, str(tmp_path / "out.csv"), single_file=True)
    assert len(list((tmp_path / "out.csv").glob("part-*"))) == 1
    got = messages.read_csv(spark, str(tmp_path / "out.csv")).orderBy("RowID").collect()
    assert [tuple(r) for r in got] == [("1", ' a "q"\nb '), ("2", None)]
    parts.write_output(df, str(tmp_path / "out.parquet"), form="parquet")
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 2
    with pytest.raises(ValueError):
        parts.write_output(df, str(tmp_path / "x"), form="xls")


def test_status_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"worker_{i}.json").write_text(json.dumps({"worker_id": i, "state": "running", "checkpoints": ["c"]},
                                                              indent=2))
    (tmp_path / "worker_3.json").write_text('{"worker_id": 3, "sta')
    (tmp_path / "pause.flag").write_text("x")
    rows = ledger.read_status(spark, str(tmp_path)).orderBy("worker_id").collect()
    assert [(r["worker_id"], r["state"], r["checkpoints"]) for r in rows] == [(1, "running", ["c"]), (2, "running", ["c"])]


def test_run_is_recorded_once(spark, tmp_path):
    path, start = str(tmp_path / "runs"), datetime(2025, 1, 1)
    assert ledger.record_run(spark, path, {"run_id": "r1", "project": "p"}, {"b": 1, "a": [2]}, start)
    assert not ledger.record_run(spark, path, {"run_id": "r1", "project": "other"}, {}, start)
    assert ledger.record_run(spark, path, {"run_id": "r2"}, {}, start)
    rows = spark.read.parquet(path).orderBy("run_id").collect()
    assert [(r["run_id"], r["project"]) for r in rows] == [("r1", "p"), ("r2", None)]
    assert json.loads(rows[0]["config_snapshot"]) == {"a": [2], "b": 1}
    assert resume.latest_run(spark.read.parquet(path)).first()["run_id"] == "r2"


def test_manifest_log(spark, tmp_path):
    path = str(tmp_path / "files")
    for n, (label, status) in enumerate([("a", "pending"), ("b", "pending"), ("a", "completed")]):
        entry = spark.createDataFrame([("r", label, n, status, ["1-5"])],
                                      "run_id string, label string, updated_at long, status string, ranges array<string>")
        ledger.append_run_file(entry, path)
    newest = runs.upsert_run_file(spark.read.parquet(path)).collect()
    assert {r["label"]: r["status"] for r in newest} == {"a": "completed", "b": "pending"}


def test_patches_keep_the_last_given_path(spark):
    df = spark.createDataFrame([("r", "a", 1, "done", "p1"), ("r", "a", 2, "failed", None), ("r", "b", 1, "x", None)],
                               "run_id string, label string, updated_at long, status string, merged_output string")
    got = {r["label"]: (r["status"], r["merged_output"]) for r in runs.patch_run_file(df).collect()}
    assert got == {"a": ("failed", "p1"), "b": ("x", None)}


def test_failed_ranges_are_added(spark, tmp_path):
    path = str(tmp_path / "failed")
    status = spark.createDataFrame([(1, "a", "failed", None), (2, "a", "completed", None), (3, "a", "failed", "boom")],
                                   "worker_id int, label string, state string, last_error string")
    planned = spark.createDataFrame([(1, 1, 5), (2, 6, 9)], "worker_id int, start long, end long")
    failed = runs.failed_ranges(status, planned)
    for run in ("r1", "r2"):
        ledger.append_failed_ranges(failed, run, path)
    rows = spark.read.parquet(path).filter("run_id = 'r2'").orderBy("worker_id").collect()
    assert [(r["worker_id"], r["start"], r["error"]) for r in rows] == [(1, 1, "Unknown error"), (3, None, "boom")]
    assert spark.read.parquet(path).count() == 4


def test_silent_workers_are_not_done(spark):
    planned = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "worker_id int, label string")
    status = spark.createDataFrame([(1, "completed"), (3, "failed")], "worker_id int, state string")
    assert {r["label"]: r["all_done"] for r in runs.all_done(planned, status).collect()} == {"a": False, "b": True}


def test_files_found_and_missing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a_w1.csv", "sub/a_w2.csv", "a_w3.txt"):
        (tmp_path / name).write_text("x")
    found = ledger.list_files(spark, str(tmp_path), "*.csv")
    base = f"file:{tmp_path}"
    assert {r["path"] for r in found.collect()} == {f"{base}/a_w1.csv", f"{base}/sub/a_w2.csv"}
    planned = spark.createDataFrame([("a", [f"{base}/a_w1.csv", f"{base}/a_w3.csv"]), ("b", [])],
                                    "label string, expected_outputs array<string>")
    assert [r["path"] for r in runs.missing_outputs(planned, found).collect()] == [f"{base}/a_w3.csv"]


def test_rows_without_ids_are_numbered_in_file_order(spark, tmp_path):
    """Over many files and splits, and the same whenever it is done again."""
    source = str(tmp_path / "in")
    texts = [f"m{i:04d} " + "x" * 200 for i in range(4000)]
    df = spark.createDataFrame([(t, i, i, i) for i, t in enumerate(texts)], "Message string, file long, block long, at long")
    df.orderBy("file").repartitionByRange(5, "file").sortWithinPartitions("file").write.option("parquet.block.size", 16384).parquet(source)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        landed = land_messages(spark, source, str(tmp_path / "landed"), start=10)
        rows = sorted((r.RowID, r.Message, r.file, r.block, r.at) for r in landed.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(i + 10, t, i, i, i) for i, t in enumerate(texts)]
    again = land_messages(spark, source, str(tmp_path / "landed"), start=10)
    assert sorted((r.RowID, r.Message) for r in again.collect()) == [(i + 10, t) for i, t in enumerate(texts)]
    assert again.columns == ["RowID", "Message", "file", "block", "at", "Title", "Sentiment"]


def test_csv_is_landed_once(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Message,Title\n"a, ""b""\nc",T\nNA,U\nlast,\n')
    first = land_messages(spark, str(path), str(tmp_path / "landed"), na_tokens=["NA"])
    assert [tuple(r) for r in first.select("RowID", "Message", "Title").orderBy("RowID").collect()] == [
        (1, 'a, "b"\nc', "T"), (2, None, "U"), (3, "last", None)]
    ids = tmp_path / "ids.csv"
    ids.write_text("RowID,Message\n7,x\n")
    assert land_messages(spark, str(ids), str(tmp_path / "l2")).first().RowID == 7
    path.write_text("Message,Title\nchanged,T\n")
    assert land_messages(spark, str(path), str(tmp_path / "landed")).count() == 3
    with pytest.raises(ValueError, match="Message"):
        path.write_text("Text\nx\n")
        land_messages(spark, str(path), str(tmp_path / "l3"))
    empty = tmp_path / "empty.csv"
    empty.write_text("Message\n")
    assert land_messages(spark, str(empty), str(tmp_path / "l4")).count() == 0


def test_damaged_parts_are_left_out_with_a_notice(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = _coded(spark)
    write_checked_parts(rows, path, "r 1", "a/b", parts_per_folder=2)
    write_checked_parts(rows.limit(0), path, "r 2", "none")

    def states():
        saved, notices = checked_parts(spark, path, "r 1", "a/b")
        found = {(n["worker_id"], n["part_group"], n["state"]) for n in notices.collect() if n["state"] != "good"}
        return sorted(r["RowID"] for r in saved.collect()), found, notices.count()

    assert states() == (list(range(1, 101)), set(), 6)
    folder = "run_id=r 1/label=a%2Fb/worker_id={}/part_group={}"
    harm(path, folder.format(1, 0), lambda whole: whole[:-20])
    harm(path, folder.format(2, 1), None)
    # A readable file with other rows, and one that the ledger does not know.
    other = rows.filter("worker_id = 2 AND part > 4").withColumn("Topic", F.lit("changed")).drop("worker_id").coalesce(1)
    other.write.parquet(str(tmp_path / "other"))
    text = next((tmp_path / "other").glob("*.parquet")).read_bytes()
    harm(path, folder.format(2, 2), lambda whole: text)
    (tmp_path / "parts" / folder.format(1, 2) / "part-x.parquet").write_bytes(text)
    left = [*range(21, 51), *range(51, 71)]
    assert states() == (left, {(1, 0, "damaged"), (2, 1, "missing"), (2, 2, "damaged"), (1, 2, "unlisted")}, 7)

    # Written again with one more column, all is there; a folder's newest entries count.
    more = rows.filter("worker_id = 1").withColumn("Note.1", F.lit("n"))
    write_checked_parts(more, path, "r 1", "a/b", parts_per_folder=2)
    write_checked_parts(rows.filter("worker_id = 2"), path, "r 1", "a/b", parts_per_folder=2)
    assert states() == (list(range(1, 101)), set(), 6)
    notes = checked_parts(spark, path, "r 1", "a/b")[0].groupBy("worker_id").agg(F.count("`Note.1`")).collect()
    assert {tuple(r) for r in notes} == {(1, 50), (2, 0)}
    with pytest.raises(ValueError, match="Topic"):
        write_checked_parts(rows.withColumn("Topic", F.lit(1)).filter("worker_id = 1"), path, "r 1", "a/b", parts_per_folder=2)
        checked_parts(spark, path, "r 1", "a/b")
