"""Plans that have to stay as they are: pushed filters, pruned columns, no cross products, no Python in the JVM part."""

import pytest

from pyspark.sql import functions as F

from tagloom.operators.batches import batch_units
from tagloom.queries import QUERIES, common
from tagloom.queries.labelling import ECHO

SF_DIR = "/root/testdata/sf0.001"
LAZY = sorted(set(QUERIES) - {
    "read_messages", "read_queue", "read_status", "write_parts", "merge_parts", "write_output", "failed_ranges", "label_documents", "label_unnumbered",
    "infer_batches", "infer_rows", "resume_calls", "label_stream", "label_stream_waves", "status_stream", "merge_sorted", "merge_late",
    "status_stream_files", "parts_with_damage", "record_run"})


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = _plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInArrow"):
        assert word not in text


@pytest.mark.parametrize("name", ["row_position", "slice_position", "assign_worker", "chunk_batches", "render_single"])
def test_gap_free_ids_are_placed_without_shuffle(spark, name):
    text = _plan(QUERIES[name](spark, SF_DIR))
    assert "Window" not in text and "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text


def test_slice_by_id_is_pushed_down(spark):
    text = _plan(QUERIES["slice_id"](spark, SF_DIR))
    assert "GreaterThanOrEqual(doc_id,100)" in text and "LessThanOrEqual(doc_id,600)" in text


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint>" in _plan(QUERIES["chunk_batches"](spark, SF_DIR))
    assert "ReadSchema: struct<lang:string>" in _plan(QUERIES["preview_plan"](spark, SF_DIR))
    assert "text" not in _plan(QUERIES["part_number"](spark, SF_DIR))


def test_answers_are_parsed_once(spark):
    """One strict parse and one of the slice per text: nothing is repeated by a pushed filter."""
    text = _plan(QUERIES["align"](spark, SF_DIR))
    assert text.count("parseJson") == 2


def test_texts_are_shuffled_once(spark):
    """The shuffle that makes the batches also gives the model calls their partitions."""
    rows = common.placed(common.as_messages(common.table(spark, SF_DIR, "documents")).withColumn("Sentiment", F.lit(None).cast("string")))
    units = batch_units(rows, 10, partitions=13)
    text = _plan(ECHO(units, 1))
    assert text.count("Exchange") == 1 and "hashpartitioning(worker_id" in text and ", 13)" in text


def test_latest_wins_without_a_window(spark):
    for name in ("status_latest", "manifest_upsert", "manifest_patch", "resolve_attempts"):
        text = _plan(QUERIES[name](spark, SF_DIR))
        assert "Window" not in text and text.count("Exchange") == 1


def test_messages_join_reads_each_table_once(spark):
    assert _plan(common.messages(spark, SF_DIR)).count("FileScan") == 2
