"""Streaming results equal batch results, also after a restart in the middle."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tagloom.plans.calls import ClientCaller, ColumnCaller, GiveUp
from tagloom.plans.label import RunPlan, label_table
from tagloom.queries import ORACLES, QUERIES, streams
from tagloom.spec import PromptSpec
from tagloom.streaming.incremental import label_stream, read_stream
from tagloom.streaming.status import read_status_table, status_stream
from tagloom.streaming.waves import WaveStream
from tests.oracle import compare, connect
from tests.test_label_run import FAILED, SPEC as WAVE_SPEC, Client, _calls

SPEC = PromptSpec(columns=("Topic",))


def _text(attempt):
    items = F.transform("rows", lambda r: F.concat(F.lit('{"Topic":"t'), r["RowID"].cast("string"), F.lit('"}')))
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


CALLER = ColumnCaller(batch=_text, row=lambda attempt: F.lit(None).cast("string"))


def _files(spark, folder, n_files, per_file):
    for f in range(n_files):
        ids = range(f * per_file + 1, (f + 1) * per_file + 1)
        df = spark.createDataFrame([(i, f"m{i}") for i in ids], "RowID long, Message string")
        df.coalesce(1).write.mode("append").parquet(folder)


def test_restart_in_the_middle(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _files(spark, folder, 3, 7)
    schema = spark.read.parquet(folder).schema
    calls = []

    def run(fail_at=None):
        def label(rows, wave_folder):
            calls.append(wave_folder)
            if len(calls) == fail_at:
                raise RuntimeError("lost")
            return label_table(rows, SPEC, CALLER, RunPlan(n_workers=2, batch_size=3), folder=wave_folder)

        stream = read_stream(spark, folder, schema, files_per_trigger=1)
        label_stream(stream, label, out, str(tmp_path / "state"), str(tmp_path / "waves")).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(fail_at=2)
    run()
    got = {r["RowID"]: r["Topic"] for r in spark.read.parquet(out).collect()}
    assert got == {i: f"t{i}" for i in range(1, 22)}
    assert spark.read.parquet(out).count() == 21 and len(calls) == 4
    _files(spark, folder, 1, 2)
    run()
    assert spark.read.parquet(out).count() == 23 and len(calls) == 5


def test_status_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run_id string, worker_id int, updated_at long, event_id long, state string"
    events = [("r", w, t, t * 10 + w, f"s{t}") for t in range(6) for w in range(3) if (t + w) % 2]
    for third in (events[4:], events[:2], events[2:4]):
        spark.createDataFrame(third, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
        status_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    got = {r["worker_id"]: r["state"] for r in read_status_table(spark, out).collect()}
    assert got == {0: "s5", 1: "s4", 2: "s5"}


def _waves(tmp_path, client, **plan):
    return WaveStream(WAVE_SPEC, ClientCaller(client, tasks=2, slice_units=1), RunPlan(**{"n_workers": 2, "batch_size": 3, "retries": 2, "interval": 6, **plan}),
                      str(tmp_path / "out"), str(tmp_path / "run"))


def _stream_of(spark, tmp_path, n_files=4, per_file=10):
    folder = str(tmp_path / "in")
    _files(spark, folder, n_files, per_file)
    return read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


class _Breaks(Client):
    """Gives up once when it comes to a row."""

    def __init__(self, folder, at, **more):
        super().__init__(folder, **more)
        self.at = at

    def complete(self, model, system, prompt):
        mark = os.path.join(self.folder, "..", "broke")
        if f"RowID: {self.at}\n" in prompt and not os.path.exists(mark):
            open(mark, "w").close()
            raise GiveUp("quota")
        return super().complete(model, system, prompt)


@pytest.mark.parametrize("at", [None, 14])
def test_one_wave_per_micro_batch(spark, tmp_path, at):
    """As a batch run, whether or not a micro-batch breaks off; what fails is asked for as often and no oftener."""
    calls = tmp_path / "calls"
    calls.mkdir()
    stream = _waves(tmp_path, _Breaks(str(calls), at, bad=[5, 33], crash=[17]))
    rows = _stream_of(spark, tmp_path)
    if at:
        with pytest.raises(Exception, match="quota"):
            stream.start(rows, str(tmp_path / "state")).awaitTermination()
    stream.start(rows, str(tmp_path / "state")).awaitTermination()
    steps = {p.name for p in (tmp_path / "run/waves").iterdir() if p.name.startswith("step")}
    assert steps == {f"step=b{i}r0" for i in range(4)}
    # The last file holds row 33 or the first does: at most three waves are left.
    assert 0 <= stream.drain(spark) <= 3 and stream.drain(spark) == 0
    found = stream.rows(spark).collect()
    assert sorted(r["RowID"] for r in found) == list(range(1, 41))
    assert {r["RowID"]: r["Topic"] for r in found} == {i: FAILED if i in (5, 17, 33) else f"t{i}" for i in range(1, 41)}
    # A call that was on its way when the stage stopped is made once more.
    counts, lost = _calls(calls), 1 if at else 0
    assert all(n <= 2 + lost for n in counts.values()) and all(2 <= counts[f"row-{k}"] <= 2 + lost for k in (5, 17, 33))
    singles = [k for k in counts if k.startswith("row")]
    assert len(singles) <= 9 and len(singles) + 3 <= sum(counts[k] for k in singles) <= len(singles) + 3 + 2 * lost


def test_waves_go_on_after_a_drain(spark, tmp_path, monkeypatch):
    """A drain breaks off when its answers are written; the next micro-batch finishes it and nothing comes twice."""
    calls = tmp_path / "calls"
    calls.mkdir()
    stream = _waves(tmp_path, Client(str(calls), bad=[2]), batch_size=2)
    rows = _stream_of(spark, tmp_path, 1, 6)
    assert stream.drain(spark) == 0
    stream.start(rows, str(tmp_path / "state")).awaitTermination()

    settle = WaveStream._settle
    with monkeypatch.context() as patch:
        def half(self, wave, step, name):
            settle(self, wave, step, name)
            shutil.rmtree(self._pending(step))
            raise RuntimeError("lost")
        patch.setattr(WaveStream, "_settle", half)
        with pytest.raises(RuntimeError, match="lost"):
            stream.drain(spark)
    paid = _calls(calls)
    spark.createDataFrame([(i, f"m{i}") for i in range(7, 10)], "RowID long, Message string").coalesce(1).write.mode("append").parquet(
        str(tmp_path / "in"))
    stream.start(rows, str(tmp_path / "state")).awaitTermination()
    again = _calls(calls)
    assert paid["batch-1-2"] == again["batch-1-2"] == 2
    stream.drain(spark)
    found = [(r["RowID"], r["Topic"]) for r in stream.rows(spark).collect()]
    assert sorted(found) == [(i, FAILED if i == 2 else f"t{i}") for i in range(1, 10)]
    with pytest.raises(ValueError, match="other plan"):
        _waves(tmp_path, Client(str(calls), bad=[2]), batch_size=3).start(rows, str(tmp_path / "state"))


def test_waves_of_empty_files(spark, tmp_path):
    stream = _waves(tmp_path, Client(str(tmp_path)))
    folder = str(tmp_path / "in")
    spark.createDataFrame([], "RowID long, Message string").write.parquet(folder)
    spark.createDataFrame([(1, None)], "RowID long, Message string").coalesce(1).write.mode("append").parquet(folder)
    rows = read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    stream.start(rows, str(tmp_path / "state")).awaitTermination()
    assert stream.drain(spark) == 0 and [r["Topic"] for r in stream.rows(spark).collect()] == ["t1"]


@pytest.mark.parametrize("name", ["label_stream", "status_stream", "status_stream_files"])
@pytest.mark.parametrize("files", [3, None])
def test_streams_of_tables_in_folders(spark, tmp_path, name, files):
    """A table may be a file or a folder of files."""
    source, folder = "/root/testdata/sf0.001", tmp_path / "some"
    folder.mkdir()
    for table in ("documents", "events"):
        if files:
            spark.read.parquet(f"{source}/{table}.parquet").repartition(files).write.parquet(str(folder / f"{table}.parquet"))
        else:
            shutil.copy(f"{source}/{table}.parquet", folder)
    assert compare(QUERIES[name](spark, str(folder)), connect(source), ORACLES[name]) is None


def test_stream_of_one_file(spark, tmp_path):
    """Only the named file is streamed, whatever lies beside it."""
    _files(spark, str(tmp_path / "some"), 2, 2)
    for n, part in enumerate(sorted((tmp_path / "some").glob("*.parquet"))):
        shutil.copy(part, tmp_path / f"a{n}.parquet")
    schema = spark.read.parquet(str(tmp_path / "some")).schema
    for n in range(2):
        rows, out = read_stream(spark, str(tmp_path / f"a{n}.parquet"), schema), str(tmp_path / f"out{n}")
        label_stream(rows, lambda batch, folder: batch, out, f"{out}-state", f"{out}-waves").awaitTermination()
        assert spark.read.parquet(out).count() == 2


@pytest.mark.parametrize("name", ["label_stream", "label_stream_waves", "status_stream", "status_stream_files"])
def test_streams_of_empty_tables(spark, tmp_path, name):
    for table in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_no_task_holds_a_whole_lot(spark, tmp_path, monkeypatch):
    """However many files a table has, what arrives in four lots is in files no larger than those that were read."""
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/documents.parquet").repartition(8, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    largest = max(spark.read.parquet(str(part)).count() for part in (tmp_path / "documents.parquet").glob("*.parquet"))
    monkeypatch.setattr(streams, "work_folder", lambda spark, name: str(tmp_path / name))
    # A split for every file.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = compare(QUERIES["label_stream_waves"](spark, str(tmp_path)), connect(source), ORACLES["label_stream_waves"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found is None
    arrived = [spark.read.parquet(str(part)).count() for part in (tmp_path / "label-waves/in").rglob("*.parquet")]
    assert sum(arrived) == 200 and max(arrived) <= largest < 200 / streams.LOTS
    steps = {p.name for p in (tmp_path / "label-waves/run/waves").iterdir() if p.name.startswith("step=b")}
    assert {f"step=b{i}r0" for i in range(streams.LOTS)} <= steps and f"step=b{streams.LOTS}r0" not in steps
