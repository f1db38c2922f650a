"""The corpus pipeline: stages over documents, each on all that its predecessor kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, mixing, partenum, quality, suffix_dedup
from tagloom.llm.common import hot_join, saved, sized, table, text_bytes, whole_row


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the quality classifier takes for bad ones: those more likely bad than good."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, docs.columns).filter("score >= 0.5").select("doc.*")


def _without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``docs`` whose id and text (or text alone) are not listed; ``gone`` holds short keys, few or many."""
    of = {"gone_id": F.col("doc_id"), "gone_key": F.xxhash64(text_bytes())}
    listed = sized(saved(gone, "gone"))
    same = [of[k].eqNullSafe(F.col(f"g.{k}")) if k == "gone_id" else of[k] == F.col(f"g.{k}") for k in keys]
    return docs.join(listed.alias("g"), reduce(Column.__and__, same), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 the one with the smallest id stays.

    Rows are told apart by id and text: where ids repeat, a row goes only if its own text is a copy, and of rows of the smallest id
    the one with the smallest text hash stays, once. Rows without an id or without words are no one's copy and stay.
    """
    found = partenum.jaccard_components(docs, n=5, num=80, den=100, task_shingles=1 << 22).filter("root IS NOT NULL")
    found = saved(found.select("doc_id", "doc_key", "root"), "copies")
    pair = F.struct("doc_id", "doc_key")
    groups = found.groupBy("root").agg(F.min(pair).alias("kept"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    copies = hot_join(found, groups, ["root"], "n_rows")
    gone = copies.filter(pair != F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key"))
    left = _without(docs, gone.distinct(), ["gone_id", "gone_key"])
    again = copies.filter(pair == F.col("kept")).groupBy("doc_id", "doc_key").count().filter("count > 1")
    again = saved(again.select(F.col("doc_id").alias("gone_id"), F.col("doc_key").alias("gone_key")), "again")
    if not again.take(1):
        return left
    # Rows equal in id and text: one of each.
    same = [F.col("doc_id") == F.col("g.gone_id"), F.xxhash64(text_bytes()) == F.col("g.gone_key")]
    one = left.join(sized(again).alias("g"), same, "left_semi")
    one = one.groupBy("doc_id", F.xxhash64(text_bytes()).alias("gone_key")).agg(
        F.any_value(whole_row(docs)).alias("row")).select("row.*")
    return _without(left, again, ["gone_id", "gone_key"]).unionByName(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings are cut out of the texts, in whole characters; every document stays."""
    found = suffix_dedup.remove_repeats(docs, whole_characters=True)
    text = F.when(F.col("doc.text").isNotNull(), F.decode("kept", "UTF-8"))
    columns = [text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars"
               else F.col(f"doc.`{c}`") for c in docs.columns]
    return found.select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold ten consecutive words of a benchmark item, or all of a shorter one.

    That depends on the text alone, so texts are judged and removed by their hash: ids may be null or repeated.
    """
    texts = docs.select(F.xxhash64(text_bytes()).alias("doc_id"), "text")
    found = decontaminate.decontaminate(texts, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated").select(F.col("doc_id").alias("gone_key")).distinct(), ["gone_key"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in a mixture in which every source has the same weight."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good), ("near-copies", drop_near_copies), ("repeats", cut_repeats),
    ("benchmark", drop_contaminated), ("mixture", mix_sources)]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
