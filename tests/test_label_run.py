"""The whole run: every row once, attempts within the budget, no call made twice."""

import json
import math
import os
import re

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.operators.position import key_stats
from tagloom.operators.batches import single_units
from tagloom.plans.calls import ClientCaller, ColumnCaller, GiveUp
from tagloom.plans.label import RunPlan, _again, _placed_steps, label_run, label_table
from tagloom.queries import labelling
from tagloom.session import work_folder
from tagloom.sources.commits import SliceLog, by_slice
from tagloom.sources.messages import require_columns
from tagloom.spec import PromptSpec

SPEC = PromptSpec(columns=("Topic", "Sentiment"), rules={"valid_topic": ["t"]}, defaults={"Topic": "-"})
FAILED = "ERROR_ALL_RETRIES_FAILED"


def _messages(spark, n=53):
    return spark.createDataFrame([(i, None, f"m{i}", "Neutral") for i in range(1, n + 1)],
                                 "RowID long, Title string, Message string, Sentiment string").repartition(3)


class Client:
    """Answers by row id; ``bad`` rows never get a usable answer, ``crash`` rows raise. Leaves a mark per call."""

    def __init__(self, folder, bad=(), crash=()):
        self.folder, self.bad, self.crash = folder, set(bad), set(crash)

    def complete(self, model, system, prompt):
        ids = [int(i) for i in re.findall(r"^RowID: (\d+)$", prompt, re.MULTILINE)]
        kind = "batch" if "JSON array" in prompt else "row"
        open(os.path.join(self.folder, f"{kind}-{'-'.join(map(str, ids))}-{os.urandom(6).hex()}"), "w").close()
        if self.crash.intersection(ids):
            raise RuntimeError("no answer")
        found = [{"Topic": 5 if i in self.bad else f"t{i}", "Sentiment": "Positive"} for i in ids]
        return {"content": json.dumps(found if kind == "batch" else found[0]), "eval_count": len(ids)}


def _calls(folder):
    counts = {}
    for name in os.listdir(folder):
        key = name.rsplit("-", 1)[0]
        counts[key] = counts.get(key, 0) + 1
    return counts


def test_run_with_a_client(spark, tmp_path):
    client = Client(str(tmp_path), bad=[7], crash=[31])
    plan = RunPlan(n_workers=3, batch_size=4, retries=2, interval=8)
    folder = work_folder(spark, "run")
    run = label_run(_messages(spark), SPEC, ClientCaller(client, tasks=4, threads=2), plan, folder=folder)
    rows = {r["RowID"]: r for r in run.rows.collect()}
    assert sorted(rows) == list(range(1, 54)) and run.rows.count() == 53
    for i, r in rows.items():
        lost = i in (7, 31)
        assert r["Topic"] == (FAILED if lost else f"t{i}")
        assert r["Validated_Sentiment"] == (FAILED if lost else "Positive") and r["Sentiment"] == "Neutral"
    calls = _calls(tmp_path)
    assert all(n <= 2 for n in calls.values())
    assert sum(k.startswith("batch") for k in calls) == 15
    assert calls["row-7"] == 2 and calls["row-8"] == 1 and "row-1" not in calls
    log = run.log.filter("row_id = 31").orderBy("attempt").collect()
    assert [(r["attempt"], r["error"]) for r in log] == [(1, "RuntimeError: no answer"), (2, "RuntimeError: no answer")]

    # The same run again goes on from what is there, without a call.
    again = label_run(_messages(spark), SPEC, ClientCaller(client, tasks=4), plan, folder=folder)
    assert _calls(tmp_path) == calls
    assert sorted(again.rows.collect()) == sorted(run.rows.collect())


def test_single_row_mode(spark, tmp_path):
    client = Client(str(tmp_path), bad=[3])
    rows = label_table(_messages(spark, 9), SPEC, ClientCaller(client, tasks=2),
                       RunPlan(n_workers=2, batch_size=1, retries=3)).collect()
    assert {r["RowID"]: r["Topic"] for r in rows} == {i: FAILED if i == 3 else f"t{i}" for i in range(1, 10)}
    assert _calls(tmp_path) == {f"row-{i}": 3 if i == 3 else 1 for i in range(1, 10)}


def test_manual_ranges_label_what_they_hold(spark, tmp_path):
    plan = RunPlan(batch_size=3, ranges=((1, 4), (4, 6), (9, 9)))
    rows = label_table(_messages(spark, 12), SPEC, ClientCaller(Client(str(tmp_path)), tasks=2), plan).collect()
    assert sorted((r["worker_id"], r["RowID"]) for r in rows) == [
        (1, 1), (1, 2), (1, 3), (1, 4), (2, 4), (2, 5), (2, 6), (3, 9)]


def test_every_row_once_whatever_comes_back(spark):
    texts = [None, "", "[", "[]", "null", "[null]", '{"x":1}', '[{"Topic":1}]', "[[]]", '["s","s","s"]']

    def answer(attempt):
        return F.element_at(F.array(*[F.lit(t).cast("string") for t in texts]), (F.col("batch_id") + 1).cast("int"))

    n = 2 * 3 * len(texts) - 2
    rows = label_table(_messages(spark, n), SPEC, ColumnCaller(batch=answer, row=answer),
                       RunPlan(n_workers=2, batch_size=3, retries=2)).collect()
    assert sorted(r["RowID"] for r in rows) == list(range(1, n + 1))
    assert {r["Topic"] for r in rows} == {FAILED, "ERROR_BATCH_MISMATCH", "ERROR_MISSING_KEY"}


def test_sparse_ids_and_missing_optional_columns(spark, tmp_path):
    df = spark.createDataFrame([(i * 100, f"m{i}") for i in range(1, 8)], "RowID long, Message string")
    rows = label_table(df, SPEC, ClientCaller(Client(str(tmp_path)), tasks=1), RunPlan(n_workers=2, batch_size=2)).collect()
    assert {r["RowID"]: r["Topic"] for r in rows} == {i * 100: f"t{i * 100}" for i in range(1, 8)}


def test_plan_is_checked():
    for bad in ({"retries": 0}, {"batch_size": 0}, {"n_workers": 0}):
        with pytest.raises(ValueError):
            RunPlan(**bad)


@pytest.mark.parametrize("gap", [1, 10])
def test_steps_are_saved_one_by_one(spark, tmp_path, gap):
    """A run of several steps that breaks off in the second one does not repeat the first."""
    calls, folder = tmp_path / "calls", work_folder(spark, "steps")
    calls.mkdir()
    df = spark.createDataFrame([(i * gap, f"m{i}") for i in range(1, 31)], "RowID long, Message string")
    plan = RunPlan(n_workers=5, batch_size=3, retries=2, workers_per_step=2)
    good = ClientCaller(Client(str(calls), bad=[4 * gap]), tasks=2)

    class Broken:
        partitions, describe = good.partitions, good.describe

        def __call__(self, units, attempt):
            if not units.filter("worker_id > 2").isEmpty():
                raise RuntimeError("lost")
            return good(units, attempt)

    with pytest.raises(RuntimeError, match="lost"):
        label_table(df, SPEC, Broken(), plan, folder=folder)
    first = _calls(calls)
    rows = label_table(df, SPEC, good, plan, folder=folder).collect()
    assert {r["RowID"]: r["Topic"] for r in rows} == {
        i * gap: FAILED if i == 4 else f"t{i * gap}" for i in range(1, 31)}
    assert len(rows) == 30
    after = _calls(calls)
    assert {k: after[k] for k in first} == first and len(after) > len(first)


def test_a_step_reads_only_its_ids(spark):
    path = work_folder(spark, "ids")
    spark.range(1, 101).select(F.col("id").alias("RowID"), F.lit("m").alias("Message")).write.parquet(path)
    df = require_columns(spark.read.parquet(path))
    plan = RunPlan(n_workers=4, workers_per_step=1)
    steps = _placed_steps(df, plan, key_stats(df, "RowID"), path)
    assert [s.count() for s in steps] == [25] * 4
    text = steps[1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(RowID,26)" in text and "LessThanOrEqual(RowID,50)" in text


def test_folder_of_another_run_is_refused(spark, tmp_path, tmp_path_factory):
    folder = str(tmp_path / "waves")
    client = Client(str(tmp_path_factory.mktemp("calls")))
    caller = ClientCaller(client, tasks=1)

    def run(n, plan=RunPlan(n_workers=2, batch_size=3), model=caller):
        return label_table(_messages(spark, n), SPEC, model, plan, folder=folder).count()

    assert run(20) == 20 == run(20)
    for change in ({"n": 40}, {"n": 20, "plan": RunPlan(n_workers=4, batch_size=3)},
                   {"n": 20, "model": ClientCaller(client, model="other", tasks=1)}):
        with pytest.raises(ValueError, match="belongs to a run with other"):
            run(**change)
    assert run(20) == 20


def test_retries_read_saved_prompts_only(spark, tmp_path):
    client = Client(str(tmp_path), bad=[7])
    folder = work_folder(spark, "run")
    run = label_run(_messages(spark, 20), SPEC, ClientCaller(client, tasks=2), RunPlan(n_workers=2, batch_size=5, retries=2),
                    folder=folder)
    assert run.rows.count() == 20
    first = spark.read.parquet(f"{folder}/waves/step=0/kind=batch/attempt=1")
    assert first.filter("ok").filter("prompt IS NOT NULL").count() == 0
    assert first.filter("NOT ok").filter("prompt IS NULL").count() == 0
    plan = _again(first.filter("NOT ok"), "batch", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_folder_of_other_texts_under_the_same_ids_is_refused(spark, tmp_path, tmp_path_factory):
    caller = ClientCaller(Client(str(tmp_path_factory.mktemp("calls"))), tasks=1)
    plan, folder, first = RunPlan(n_workers=2, batch_size=3), str(tmp_path / "waves"), require_columns(_messages(spark, 20))
    first = first.withColumns({"Note": F.lit("a"), "More": F.array(F.lit(1), F.lit(None))})

    def run(messages):
        return label_table(messages, SPEC, caller, plan, folder=folder, keep=("RowID", "Sentiment", "Note", "More")).count()

    assert run(first) == 20 == run(first.orderBy(F.desc("RowID")))
    seventh = F.col("RowID") == 7
    for name, value in (("Message", F.lit("corrected")), ("Title", F.lit("new")), ("Sentiment", F.lit("new")),
                        ("Note", F.lit(None).cast("string")), ("More", F.array(F.lit(None), F.lit(1)))):
        with pytest.raises(ValueError, match="belongs to a run with other texts"):
            run(first.withColumn(name, F.when(seventh, value).otherwise(F.col(name))))


class Tired(Client):
    """Gives up after so many calls of all tasks."""

    def __init__(self, folder, calls):
        super().__init__(folder)
        self.calls = calls

    def complete(self, model, system, prompt):
        if len(os.listdir(self.folder)) >= self.calls:
            raise GiveUp("quota used up")
        return super().complete(model, system, prompt)


@pytest.mark.parametrize("size", [1, 3])
def test_a_wave_that_breaks_off_is_not_paid_again(spark, tmp_path, size):
    """The second start calls only units whose slices were not put away."""
    folder, slice_units = work_folder(spark, "broken"), 3
    plan = RunPlan(n_workers=3, batch_size=size, retries=2)
    total = sum(math.ceil(n / size) for n in (18, 18, 17))

    def run(client, tasks):
        caller = ClientCaller(client, tasks=tasks, name="model", slice_units=slice_units)
        return label_run(_messages(spark), SPEC, caller, plan, folder=folder).rows

    with pytest.raises(PySparkException, match="quota used up"):
        run(Tired(str(tmp_path), total * 2 // 3), 2)
    before = _calls(tmp_path)
    assert len(before) >= total // 2 and set(before.values()) == {1}
    # Also with another number of tasks.
    rows = {r["RowID"]: r["Topic"] for r in run(Client(str(tmp_path)), 3).collect()}
    assert rows == {i: f"t{i}" for i in range(1, 54)}
    after = _calls(tmp_path)
    again = [k for k, n in after.items() if n > 1]
    assert len(after) == total and len(again) < len(before) / 2 and max(after.values()) == 2


def test_answers_of_another_unit_are_not_taken(spark, tmp_path):
    """A file in the log that does not hold the units of its slice is as good as none."""
    log = SliceLog(str(tmp_path / "log"))
    caller = ClientCaller(Client(str(tmp_path / "calls")), slice_units=4)
    (tmp_path / "calls").mkdir()
    units = single_units(spark.createDataFrame([(i, None, f"m{i}", None, 1, 0) for i in range(1, 9)],
                                               "RowID long, Title string, Message string, Sentiment string, worker_id int, batch_id long"),
                         partitions=1, slices=2)
    first = {r.row_id: r.content for r in caller(units, 1, log).collect()}
    assert len(first) == 8 and sum(_calls(tmp_path / "calls").values()) == 8
    assert {r.row_id: r.content for r in caller(units, 1, log).collect()} == first
    assert sum(_calls(tmp_path / "calls").values()) == 8
    log.write(0, log.read(1))
    assert {r.row_id: r.content for r in caller(units, 1, log).collect()} == first
    assert 8 < sum(_calls(tmp_path / "calls").values()) < 16


def test_slices_are_cut_from_any_batches():
    numbers = [0, 0, 0, 2, 2, 5, 5, 5, 5, 7]
    table = pa.table({"slice": numbers, "v": list(range(10))})
    for sizes in (1, 3, 10):
        found = [(n, b.column("v").to_pylist()) for n, b in by_slice(iter(table.to_batches(sizes)), "slice", 1)]
        assert found == [(0, [0, 1, 2]), (2, [3, 4]), (5, [5, 6, 7, 8]), (7, [9])]
    assert [b.num_rows for _, b in by_slice(iter(table.to_batches()), None, 4)] == [4, 4, 2]
    assert list(by_slice(iter([]), "slice", 1)) == []


def test_every_call_has_its_time(spark, tmp_path):
    run = label_run(_messages(spark, 9), SPEC, ClientCaller(Client(str(tmp_path)), tasks=2), RunPlan(n_workers=1, batch_size=2))
    assert run.log.count() == 5 and run.log.filter("started_us <= ended_us AND started_us > 1e15").count() == 5


def test_tasks_grow_with_calls(spark, monkeypatch):
    """A run that is resumed gives no task more calls the larger its table is; a given number of tasks stays a cap."""
    callers = []

    def noted(rows, spec, caller, *more, **options):
        callers.append(caller)
        return label_table(rows, spec, caller, *more, **options)

    monkeypatch.setattr(labelling, "label_table", noted)
    assert labelling.resume_calls(spark, "/root/testdata/sf0.001").count() == 200
    assert len(callers) == 2
    for caller in callers:
        assert caller.partitions(spark, 24) == 4
        assert all(n / caller.partitions(spark, n) <= 500 for n in (5_000, 50_000, 300_000))
    assert ClientCaller(Client("")).partitions(spark, 24) == 4 * spark.sparkContext.defaultParallelism
    assert ClientCaller(Client(""), tasks=3).partitions(spark, 300_000) == 3
