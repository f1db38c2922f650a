"""Prompt text and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog
from ..operators.batches import batch_units, single_units
from .common import BATCH, MESSAGES_SQL, messages, placed, placed_sql, table

RUN_STAMP = "yyyyMMdd_HHmmss"
PATTERN = "{project}_{version}_{label}_{date}"


def title_clause(spark, sf_dir):
    """Sources as titles, with blank, missing and ``nan`` ones among them."""
    n = F.col("doc_id") % 5
    title = (F.when(n == 0, "").when(n == 1, "  ").when(n == 2, "nan")
             .when(n == 3, F.concat(F.lit(" "), F.col("source"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"))
    return docs.select("doc_id", T.title_clause(F.col("title")).alias("clause"))


def _digest(units, *keys):
    return units.select(*keys, F.length("prompt").alias("prompt_len"), F.md5("prompt").alias("prompt_md5"))


def render_single(spark, sf_dir):
    return _digest(single_units(placed(messages(spark, sf_dir))), F.col("row_id").alias("RowID"))


def render_batch(spark, sf_dir):
    return _digest(batch_units(placed(messages(spark, sf_dir)), BATCH), "worker_id", "batch_id")


def slug(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = F.concat("o_orderpriority", F.lit(" / é_"), "o_orderstatus")
    return orders.select("o_orderkey", T.slug(text).alias("slug"))


def _catalog(parts):
    """Large parts as model entries; names repeat, so the first one per name counts."""
    return parts.filter("p_size > 45").select(
        F.col("p_name").alias("name"), F.col("p_size").alias("id"), F.col("p_partkey").alias("position"))


def model_tag(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    tagged = catalog.with_model_tag(parts, _catalog(parts), "p_name")
    return tagged.select("p_partkey", "p_name", "model_tag")


def catalog_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = parts.select("p_partkey", F.col("p_name").alias("name"))
    return catalog.catalog_lookup(rows, _catalog(parts)).select("p_partkey", "name", "id", "position")


def run_ids(orders):
    stamp = F.date_format("o_orderdate", RUN_STAMP)
    tag = T.model_tag(F.nullif(F.col("o_custkey") % 3, F.lit(0)), F.col("o_orderstatus"))
    return T.run_id(F.col("o_orderpriority"), F.lit("v 1.0"), tag, stamp)


def run_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", run_ids(orders).alias("run_id"))


def output_name(spark, sf_dir):
    """Worker output, merged output, versioned names, and job and part names."""
    key, worker = F.col("o_orderkey"), F.col("o_custkey") % 9
    fields = {"project": F.lit("demo"), "version": F.lit("v2"), "label": F.col("o_orderpriority"),
              "date": F.date_format("o_orderdate", "yyyyMMdd"), "run_id": F.lit("r1")}
    job = T.job_id(key, key + 9, worker, F.lit("r1"))
    optional = F.when(key % 2 == 0, F.concat(F.lit("r1-"), key.cast("string")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        T.output_name(PATTERN, worker, **fields).alias("worker_file"),
        T.output_name(PATTERN, **fields).alias("merged_file"),
        T.versioned_name(F.lit(""), F.lit("run"), optional, "csv").alias("run_file"),
        T.stamped_name(F.lit("out"), F.date_format("o_orderdate", RUN_STAMP), worker, F.lit(10), optional, ".csv")
        .alias("stamped_file"),
        T.part_name(job, key * 7).alias("part_file"))


def format_duration(spark, sf_dir):
    """Event values as tens of seconds, so that some pass one hour."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", T.format_duration(F.col("value") * 10).alias("duration"))


def metric_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.metric_key(F.lit("Order_Priority"), F.col("o_orderpriority")).alias("metric"))


W = T.Wording()


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The same wording in SQL; {n} and {i} are filled by concatenation.
_BODY = f"""concat({_sql_text(W.row_id)}, RowID, {_sql_text(chr(10) + W.sentiment)}, coalesce(Sentiment, ''),
    {_sql_text(W.sentiment_hint + chr(10) * 2)},
    CASE WHEN Title IS NULL OR trim(Title) = '' OR Title = 'nan' THEN '' ELSE concat({_sql_text(W.title)}, Title, chr(10)) END,
    {_sql_text(W.content)}, Message, chr(10))"""


def _sql_template(template: str, **values: str) -> str:
    parts = [_sql_text(template)]
    out = parts[0]
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', CAST({value} AS VARCHAR))"
    return out


_CATALOG = """cat AS (
  SELECT p_name AS name, arg_min(p_size, p_partkey) AS id, min(p_partkey) AS position FROM part WHERE p_size > 45
  GROUP BY p_name)"""
RUN_ID_SQL = """concat_ws('_', regexp_replace(o_orderpriority, '[^\\p{L}\\p{N}_-]', '_', 'g'), 'v_1_0',
    'm' || CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE CAST(o_custkey % 3 AS VARCHAR) END,
    strftime(o_orderdate, '%Y%m%d_%H%M%S'))"""

QUERIES = {f.__name__: f for f in (
    title_clause, render_single, render_batch, slug, model_tag, catalog_lookup, run_id, output_name, format_duration,
    metric_key)}

ORACLES = {
    "title_clause": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN 'Title:  ' || source || chr(10) ELSE '' END AS clause
        FROM documents""",
    "render_single": f"""WITH {MESSAGES_SQL},
        p AS (SELECT RowID, concat({_sql_text(W.single_intro)}, {_BODY}) AS prompt FROM messages)
        SELECT RowID, CAST(length(prompt) AS INTEGER) AS prompt_len, md5(prompt) AS prompt_md5 FROM p""",
    "render_batch": f"""WITH {MESSAGES_SQL}, {placed_sql()},
        sized AS (SELECT *, count(*) OVER (PARTITION BY worker_id, batch_id) AS n FROM placed),
        items AS (SELECT worker_id, batch_id, pos, n,
                         concat({_sql_template(W.item_head, i='pos', n='n')}, {_BODY}) AS item FROM sized),
        p AS (SELECT worker_id, batch_id, concat({_sql_template(W.batch_intro, n='max(n)')},
                     string_agg(item, '' ORDER BY pos), {_sql_template(W.batch_close, n='max(n)')}) AS prompt
              FROM items GROUP BY worker_id, batch_id)
        SELECT CAST(worker_id AS INTEGER) AS worker_id, batch_id, CAST(length(prompt) AS INTEGER) AS prompt_len,
               md5(prompt) AS prompt_md5 FROM p""",
    "slug": """
        SELECT o_orderkey, regexp_replace(o_orderpriority || ' / é_' || o_orderstatus, '[^\\p{L}\\p{N}_-]', '_', 'g')
               AS slug FROM orders""",
    "model_tag": f"""WITH {_CATALOG}
        SELECT p_partkey, p_name, 'm' || coalesce(CAST(id AS VARCHAR),
               nullif(left(regexp_replace(p_name, '[^\\p{{L}}\\p{{N}}]', '', 'g'), 10), ''), 'unknown') AS model_tag
        FROM part LEFT JOIN cat ON name = p_name""",
    "catalog_lookup": f"""WITH {_CATALOG}
        SELECT p_partkey, p_name AS name, id, position FROM part LEFT JOIN cat ON name = p_name""",
    "run_id": f"SELECT o_orderkey, {RUN_ID_SQL} AS run_id FROM orders",
    "output_name": """
        SELECT o_orderkey,
               concat('demo_v2_', o_orderpriority, '_', strftime(o_orderdate, '%Y%m%d'), '_w', o_custkey % 9, '.csv')
                 AS worker_file,
               concat('demo_v2_', o_orderpriority, '_', strftime(o_orderdate, '%Y%m%d'), '.csv') AS merged_file,
               CASE WHEN o_orderkey % 2 = 0 THEN 'run_r1-' || o_orderkey || '.csv' ELSE 'run.csv' END AS run_file,
               concat('out_v', strftime(o_orderdate, '%Y%m%d_%H%M%S'), '_m', o_custkey % 9, '_b10_r',
                      CASE WHEN o_orderkey % 2 = 0 THEN 'r1-' || o_orderkey ELSE 'unknown' END, '.csv') AS stamped_file,
               concat('checkpoint_', o_orderkey, '-', o_orderkey + 9, '_w', o_custkey % 9, '_r1_part',
                      CASE WHEN o_orderkey * 7 < 10000 THEN lpad(CAST(o_orderkey * 7 AS VARCHAR), 4, '0')
                           ELSE CAST(o_orderkey * 7 AS VARCHAR) END) AS part_file
        FROM orders""",
    "format_duration": """
        SELECT event_id, CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END
               || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration
        FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS s FROM events)""",
    "metric_key": """
        SELECT o_orderkey, 'orderpriority_' || replace(replace(o_orderpriority, ' ', '_'), '-', '_') AS metric
        FROM orders""",
}
