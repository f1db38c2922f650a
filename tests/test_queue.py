"""A run over a queue of files, and the same run again."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest

from tagloom.plans.calls import ClientCaller
from tagloom.plans.label import RunPlan
from tagloom.plans.queue import Manifest, QueueRun, run_queue
from tagloom.queries.saving import harm
from tagloom.sources.checked import write_checked_parts
from tagloom.sources.ledger import Conflict, commit_once
from tests.test_label_run import FAILED, SPEC, Client, _calls


def _write(path, ids):
    path.write_text("RowID,Message,Sentiment\n" + "".join(f'{i},"text, {i}",Neutral\n' for i in ids))
    return str(path)


def test_queue_run(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    queue = [(_write(tmp_path / "a.csv", range(1, 24)), "01"), (str(tmp_path / "b.csv"), "b"),
             (_write(tmp_path / "c.csv", range(10, 100, 10)), "c")]
    run = QueueRun(run_id="run1", out=str(tmp_path / "out"), spec=SPEC, model="echo",
                   caller=ClientCaller(Client(str(calls), bad=[5]), tasks=2),
                   plan=RunPlan(n_workers=2, batch_size=4, retries=2, interval=8), files_at_once=3)
    rows = {r["label"]: r for r in run_queue(spark, run, queue, {"project": "p"}, {"batch": 4}).collect()}
    assert {k: (r["status"], r["total_rows"], r["failed_workers"]) for k, r in rows.items()} == {
        "01": ("completed", 23, 0), "b": ("input_missing", 0, 0), "c": ("completed", 9, 0)}

    merged = spark.read.parquet(rows["01"]["merged_output"]).orderBy("RowID").collect()
    assert [r["RowID"] for r in merged] == list(range(1, 24))
    assert [r["Topic"] for r in merged[3:6]] == ["t4", FAILED, "t6"]
    assert merged[0]["Model_Name"] == "echo" and merged[0]["Batch_Size"] == 4 and merged[0]["run_id"] == "run1"
    # Figures of the worker's calls are on every row; two tasks call at a time, so their times overlap.
    figures = {(r["worker_id"], r["Rows_Per_Sec"] > 0, r["Avg_Tokens_Per_Row"] > 0, r["Tokens_Total"] > 0) for r in merged}
    assert figures == {(1, True, True, True), (2, True, True, True)}
    assert spark.read.parquet(str(tmp_path / "out/notices/run1/01")).count() == 0
    facts = spark.read.parquet(str(tmp_path / "out/analytics/run1/01")).first()
    assert facts["total_rows"] == 23 and facts["error_count"] == 2 and facts["tokens_total"] > 23
    assert facts["validatedsentiment_Positive"] == 22 and facts["sentiment_Neutral"] == 23
    assert facts["total_time_seconds"] > 0 and facts["timestamp"].startswith("20")
    status = {(r["label"], r["worker_id"]): (r["state"], r["rows_processed"], r["errors"]) for r in run.status(spark).collect()}
    assert status == {("01", 1): ("completed", 12, 1), ("01", 2): ("completed", 11, 0),
                      ("c", 1): ("completed", 5, 0), ("c", 2): ("completed", 4, 0)}

    # The missing file turns up: only it is worked on.
    before = _calls(calls)
    _write(tmp_path / "b.csv", range(101, 104))
    rows = {r["label"]: (r["status"], r["total_rows"]) for r in run_queue(spark, run, queue).collect()}
    assert rows == {"01": ("completed", 23), "b": ("completed", 3), "c": ("completed", 9)}
    after = _calls(calls)
    assert {k: n for k, n in after.items() if before.get(k) != n} == {"batch-101-102": 1, "batch-103": 1}
    assert spark.read.parquet(str(tmp_path / "out/runs")).count() == 1


def test_ranges_may_reach_beyond_the_file(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    queue = [(_write(tmp_path / "a.csv", range(1, 7)), "a")]
    run = QueueRun(run_id="r", out=str(tmp_path / "out"), spec=SPEC, caller=ClientCaller(Client(str(calls)), tasks=1),
                   plan=RunPlan(batch_size=2, ranges=((1, 4), (5, 9), (20, 30))), form="csv")
    row = run_queue(spark, run, queue).first()
    assert (row["status"], row["total_rows"], row["failed_workers"]) == ("completed", 6, 0)
    assert spark.read.option("header", True).csv(row["merged_output"]).count() == 6
    status = {r["worker_id"]: (r["state"], r["total_rows"], r["output_file"] is None) for r in run.status(spark).collect()}
    assert status == {1: ("completed", 4, False), 2: ("completed", 2, False), 3: ("completed", 0, True)}


def test_labels_that_are_no_folder_names(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    run = QueueRun(run_id="run1", out=str(tmp_path / "out"), spec=SPEC, caller=ClientCaller(Client(str(calls)), tasks=2),
                   plan=RunPlan(n_workers=2, batch_size=4, retries=2, interval=8))
    labels = ["a/b", "50% = é: x", "{x}"]
    queue = [(_write(tmp_path / f"{i}.csv", range(1, 6)), label) for i, label in enumerate(labels)]
    rows = {r["label"]: r for r in run_queue(spark, run, queue).collect()}
    assert {k: (r["status"], r["total_rows"]) for k, r in rows.items()} == {x: ("completed", 5) for x in labels}
    assert all(spark.read.parquet(r["merged_output"]).count() == 5 for r in rows.values())


def test_going_on_keeps_the_stored_plan(spark, tmp_path, monkeypatch):
    """A run that loses a part on its first start is given another plan: it goes on with the first one and pays for nothing again."""
    calls = tmp_path / "calls"
    calls.mkdir()
    queue = [(_write(tmp_path / "a.csv", range(1, 11)), "a")]
    run = QueueRun(run_id="r", out=str(tmp_path / "out"), spec=SPEC, caller=ClientCaller(Client(str(calls)), tasks=1),
                   plan=RunPlan(n_workers=2, batch_size=5, interval=5), parts_per_folder=1)

    def write_and_lose(df, path, run_id, label, parts_per_folder):
        write_checked_parts(df, path, run_id, label, parts_per_folder)
        harm(path, f"run_id={run_id}/label={label}/worker_id=2/part_group=0", lambda whole: whole[:100])

    with monkeypatch.context() as patch:
        patch.setattr("tagloom.plans.queue.write_checked_parts", write_and_lose)
        row = run_queue(spark, run, queue).first()
    assert (row["status"], row["failed_workers"], row["merged_output"]) == ("completed_with_failures", 1, None)
    failed = spark.read.parquet(str(tmp_path / "out/failed_ranges")).collect()
    assert [(r["worker_id"], r["start"], r["end"], r["error"], r["label"]) for r in failed] == [(2, 6, 10, "rows are missing", "a")]
    notices = spark.read.parquet(str(tmp_path / "out/notices/r/a")).collect()
    assert [(r["worker_id"], r["state"], r["rows_wanted"]) for r in notices] == [(2, "damaged", 5)]

    before = _calls(calls)
    row = run_queue(spark, replace(run, plan=RunPlan(n_workers=5, batch_size=2)), queue).first()
    assert (row["status"], row["total_rows"], row["failed_workers"]) == ("completed", 10, 0)
    assert _calls(calls) == before and spark.read.parquet(row["merged_output"]).count() == 10
    entry = run.files(spark).first()
    assert [tuple(r) for r in entry["ranges"]] == [(1, 1, 5), (2, 6, 10)]


def test_one_of_many_commits_wins(spark, tmp_path):
    path = str(tmp_path / "log" / "00000001.json")

    def commit(i):
        try:
            commit_once(spark, path, f"text {i}")
        except Conflict:
            return None
        return i

    with ThreadPoolExecutor(4) as pool:
        won = [i for i in pool.map(commit, range(4)) if i is not None]
    assert won and open(path).read() in {f"text {i}" for i in won}
    with pytest.raises(Conflict):
        commit_once(spark, path, "late")
    assert open(path).read() != "late" and not [p for p in (tmp_path / "log").iterdir() if p.name.endswith(".part")]


def test_second_driver_stops(spark, tmp_path):
    """Two drivers read the same manifest; the one that is late neither overwrites the entry nor goes on."""
    calls = tmp_path / "calls"
    calls.mkdir()
    run = QueueRun(run_id="r 1", out=str(tmp_path / "out"), spec=SPEC, caller=ClientCaller(Client(str(calls)), tasks=1))
    one, two = (Manifest(spark, run, "a/b", "in.csv") for _ in range(2))
    one.note("pending", [(1, 1, 5), (2, 6, 9)], plan=RunPlan(n_workers=2))
    with pytest.raises(Conflict):
        two.note("pending", [(1, 1, 9)], plan=RunPlan(n_workers=1))
    one.note("completed", [(1, 1, 5), (2, 6, 9)], "out.csv", RunPlan(n_workers=2))
    entry = run.files(spark).first()
    assert (entry["label"], entry["version"], entry["status"], entry["merged_output"]) == ("a/b", 2, "completed", "out.csv")
    assert [tuple(r) for r in entry["ranges"]] == [(1, 1, 5), (2, 6, 9)] and replace(run, run_id="r 2").files(spark) is None
