"""JSON answers: strict and tolerant parsing, alignment, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators.answers import AnswerReader
from ..operators.batches import batch_units
from ..spec import PromptSpec
from .common import BATCH, MESSAGES_SQL, messages, placed, placed_sql, table

# Event properties with all kinds of damage around them; one SQL text that both engines read the same way.
DAMAGED = """
CASE event_id % 23
  WHEN 0 THEN props
  WHEN 1 THEN concat('  ', props, chr(10))
  WHEN 2 THEN concat('Sure: ', props, ' ok')
  WHEN 3 THEN concat(props, ' ', props)
  WHEN 4 THEN concat('[', props, ',', props, ']')
  WHEN 5 THEN concat('Sure: [', props, '] ok')
  WHEN 6 THEN concat('see [1] ', props)
  WHEN 7 THEN concat('see [a] ', props)
  WHEN 8 THEN concat('[', props, ',null]')
  WHEN 9 THEN left(props, length(props) - 1)
  WHEN 10 THEN ''
  WHEN 11 THEN concat('{"results":[', props, ']}')
  WHEN 12 THEN '[]'
  WHEN 13 THEN 'null'
  WHEN 14 THEN '12'
  WHEN 15 THEN '"s"'
  WHEN 16 THEN concat('[', props, ',', props, ',null]')
  WHEN 17 THEN 'x } y { z'
  WHEN 18 THEN '[1,2]'
  WHEN 19 THEN concat(props, ',')
  WHEN 20 THEN concat('[', props, ',]')
  WHEN 21 THEN concat(props, ']')
  ELSE concat('text ', props, ' and [ more ')
END"""

# An answer to two rows each, over every kind of value the type check meets.
TYPED = """
CASE event_id % 9
  WHEN 0 THEN concat('{"flag":"Y","label":"', event_type, '"}')
  WHEN 1 THEN '{"flag":"Y","label":3}'
  WHEN 2 THEN '{"flag":"Y","label":null}'
  WHEN 3 THEN '{"flag":"Y","label":["x"]}'
  WHEN 4 THEN '{"flag":"Y"}'
  WHEN 5 THEN '{"flag":"N","label":3}'
  WHEN 6 THEN '{"flag":"NOT_APPLICABLE","label":true}'
  WHEN 7 THEN '{"flag":7,"label":"x"}'
  ELSE '{"flag":null,"label":"x"}'
END"""

K_SPEC = PromptSpec(columns=("k",))
TYPED_SPEC = PromptSpec(columns=("flag", "label"), rules={"valid_labels": ["click", "view"]},
                        defaults={"flag": "-", "label": "none"})


def _texts(spark, sf_dir, text=DAMAGED):
    return table(spark, sf_dir, "events").select("event_id", F.expr(text).alias("content"))


def _k(value):
    return A.value_text(F.try_element_at(A.as_object(value), F.lit("k")))


def parse_strict(spark, sf_dir):
    parsed = _texts(spark, sf_dir).select("event_id", A.parse_strict(A.stripped(F.col("content"))).alias("v"))
    return parsed.select("event_id", F.col("v").isNotNull().alias("parsed"), _k(F.col("v")).alias("k"))


def parse_object(spark, sf_dir):
    parsed = AnswerReader(K_SPEC, "row").elements(_texts(spark, sf_dir))
    first = F.get("elements", F.lit(0))
    return parsed.select("event_id", F.col("elements").isNotNull().alias("parsed"),
                         A.as_object(first).isNotNull().alias("is_object"), _k(first).alias("k"))


def parse_array(spark, sf_dir):
    parsed = AnswerReader(K_SPEC).elements(_texts(spark, sf_dir))
    return parsed.select("event_id", F.when(F.col("elements").isNotNull(), F.size("elements")).alias("n"),
                         _k(F.get("elements", F.lit(0))).alias("k"))


def _two_rows(df):
    return df.withColumn("rows", F.array(*[F.struct(F.lit(i).alias("pos")) for i in (1, 2)]))


def admissible(spark, sf_dir):
    """Whether an answer can be used for two rows."""
    read = AnswerReader(K_SPEC)(_two_rows(_texts(spark, sf_dir)))
    values = F.transform("answers", lambda a: F.coalesce(a["values"]["k"], F.lit("null")))
    return read.select("event_id", "ok", F.when(F.col("ok"), F.array_join(values, "|")).alias("k_values"))


def project_coded(spark, sf_dir):
    """Values of single-row answers: missing keys are marked, JSON nulls are NULL, surplus keys are left out."""
    keys = A.as_object(A.parse_strict(F.col("content")))
    cells = _texts(spark, sf_dir, TYPED).select("event_id", keys.alias("keys"))
    return cells.select("event_id", A.coded_text(F.col("keys"), "flag").alias("flag"),
                        A.coded_text(F.col("keys"), "label").alias("label"),
                        A.coded_text(F.col("keys"), "other").alias("other"))


def typed_ok(spark, sf_dir):
    """The type check with its exemptions, and the repaired values of usable answers."""
    one = _texts(spark, sf_dir, TYPED).withColumn("rows", F.array(F.struct(F.lit(1).alias("pos"))))
    read = AnswerReader(TYPED_SPEC, "row")(one)
    values = F.when(F.col("ok"), F.get("answers", F.lit(0))["values"])
    return read.select("event_id", "ok", values["flag"].alias("flag"), values["label"].alias("label"))


TOPIC_SPEC = PromptSpec(columns=("Topic", "Size"))


def _units_with_answers(spark, sf_dir):
    """Batches of documents, answered with language and length; some answers lack their last element or have one more.

    The ids inside the answers are wrong on purpose.
    """
    rows = placed(messages(spark, sf_dir, "lang", "n_chars"))
    units = batch_units(rows, BATCH, ("RowID", "lang", "n_chars"))
    texts = F.transform("rows", lambda r: F.to_json(F.struct(
        F.lit(1).alias("RowID"), r["lang"].alias("Topic"), r["n_chars"].cast("string").alias("Size"))))
    g = F.col("worker_id") * 1000 + F.col("batch_id")
    short = F.slice(texts, F.lit(1), F.size(texts) - 1)
    longer = F.concat(texts, F.array(F.lit('{"Topic":"none"}'), F.lit("null")))
    chosen = F.when(g % 7 == 3, short).when(g % 5 == 2, longer).otherwise(texts)
    return units.withColumn("content", F.concat(F.lit("["), F.array_join(chosen, ","), F.lit("]")))


def _aligned(spark, sf_dir):
    checked = AnswerReader(TOPIC_SPEC)(_units_with_answers(spark, sf_dir))
    return checked.select("worker_id", "batch_id", F.inline_outer("answers"))


def reconcile_pad(spark, sf_dir):
    """Cells per batch after padding and cutting."""
    rows = _aligned(spark, sf_dir)
    padded = F.count_if(F.col("values.Topic") == A.BATCH_MISMATCH)
    return rows.groupBy("worker_id", "batch_id").agg(F.count("*").alias("rows"), padded.alias("padded"))


def align(spark, sf_dir):
    rows = _aligned(spark, sf_dir)
    return rows.select(F.col("row.RowID").alias("RowID"), F.col("values.Topic").alias("topic"),
                       F.col("values.Size").alias("size"))


NA_SPEC = PromptSpec(columns=("Relevant", "Topic", "Tone"),
                     defaults={"Relevant": "no", "Topic": "Other", "Hint": "by default"})


def not_applicable(spark, sf_dir):
    """Defaults replace rows that do not apply: a column without one is NULL, a default without column is added."""
    docs = table(spark, sf_dir, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, "NOT_APPLICABLE").when(F.col("doc_id") % 3 == 1, "Y")
    values = {"Relevant": first, "Topic": F.col("lang"), "Tone": F.col("source")}
    out = A.apply_defaults(values, NA_SPEC)
    return docs.select("doc_id", *[c.alias(n) for n, c in out.items()])


_TEXTS = f"t AS (SELECT event_id, trim({DAMAGED}, chr(10) || ' ') AS c FROM events)"


def _valid(text):
    """DuckDB takes a comma before a closing bracket as valid, JSON does not."""
    return f"(json_valid({text}) AND NOT regexp_matches({text}, ',\\s*[]}}]'))"


_BRACES = """CASE WHEN contains(c, '{') AND contains(c, '}') AND strpos(c, '{') <= length(c) - strpos(reverse(c), '}') + 1
    THEN substring(c, strpos(c, '{'), length(c) - strpos(reverse(c), '}') + 2 - strpos(c, '{')) END"""
_BRACKETS = _BRACES.replace("'{'", "'['").replace("'}'", "']'")
_OBJECT = f"""s AS (SELECT event_id, c, {_BRACES} AS b FROM t),
    o AS (SELECT event_id, CASE WHEN {_valid('c')} THEN c WHEN {_valid('b')} THEN b END AS j FROM s)"""
_ARRAY = f"""s AS (SELECT event_id, c, {_BRACES} AS b, {_BRACKETS} AS q FROM t),
    o AS (SELECT event_id, CASE WHEN {_valid('c')} THEN c
                                WHEN contains(c, '[') AND contains(c, ']') THEN CASE WHEN {_valid('q')} THEN q END
                                WHEN {_valid('b')} THEN b END AS j FROM s),
    a AS (SELECT event_id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN '[' || j || ']' END AS j FROM o)"""
_PLACED = f"WITH {MESSAGES_SQL}, {placed_sql()}"
_BATCHED = f"""{_PLACED}, g AS (SELECT *, worker_id * 1000 + batch_id AS g,
    pos = count(*) OVER (PARTITION BY worker_id, batch_id) AS is_last FROM placed)"""

QUERIES = {f.__name__: f for f in (
    parse_strict, parse_object, parse_array, admissible, reconcile_pad, align, project_coded, typed_ok, not_applicable)}

ORACLES = {
    "parse_strict": f"""WITH {_TEXTS}
        SELECT event_id, {_valid('c')} AS parsed,
               CASE WHEN {_valid('c')} THEN json_extract_string(c, '$.k') END AS k FROM t""",
    "parse_object": f"""WITH {_TEXTS}, {_OBJECT}
        SELECT event_id, j IS NOT NULL AS parsed, coalesce(json_type(j) = 'OBJECT', false) AS is_object,
               json_extract_string(j, '$.k') AS k FROM o""",
    "parse_array": f"""WITH {_TEXTS}, {_ARRAY}
        SELECT event_id, CAST(json_array_length(j) AS INTEGER) AS n, json_extract_string(j, '$[0].k') AS k FROM a""",
    "admissible": f"""WITH {_TEXTS}, {_ARRAY},
        e AS (SELECT event_id, j, json_array_length(j) AS n, json_type(j, '$[0]') AS t0, json_type(j, '$[1]') AS t1,
                     json_extract_string(j, '$[0].k') AS k0, json_extract_string(j, '$[1].k') AS k1 FROM a),
        f AS (SELECT *, coalesce(n = 0 OR (t0 = 'OBJECT' AND (n = 1 OR t1 = 'OBJECT')), false) AS ok FROM e)
        SELECT event_id, ok, CASE WHEN ok THEN
               CASE WHEN n = 0 THEN 'ERROR_BATCH_MISMATCH' ELSE coalesce(k0, 'ERROR_MISSING_KEY') END || '|' ||
               CASE WHEN n < 2 THEN 'ERROR_BATCH_MISMATCH' ELSE coalesce(k1, 'ERROR_MISSING_KEY') END END AS k_values
        FROM f""",
    "reconcile_pad": f"""{_BATCHED}
        SELECT CAST(worker_id AS INTEGER) AS worker_id, batch_id, count(*) AS rows,
               count(*) FILTER (is_last AND g % 7 = 3) AS padded FROM g GROUP BY worker_id, batch_id""",
    "align": f"""{_BATCHED}
        SELECT RowID, CASE WHEN is_last AND g % 7 = 3 THEN 'ERROR_BATCH_MISMATCH' ELSE lang END AS topic,
               CASE WHEN is_last AND g % 7 = 3 THEN 'ERROR_BATCH_MISMATCH' ELSE CAST(n_chars AS VARCHAR) END AS size
        FROM g""",
    "project_coded": """
        SELECT event_id, CASE WHEN m <= 4 THEN 'Y' WHEN m = 5 THEN 'N' WHEN m = 6 THEN 'NOT_APPLICABLE'
                              WHEN m = 7 THEN '7' END AS flag,
               CASE WHEN m = 0 THEN event_type WHEN m IN (1, 5) THEN '3' WHEN m = 2 THEN NULL WHEN m = 3 THEN '["x"]'
                    WHEN m = 4 THEN 'ERROR_MISSING_KEY' WHEN m = 6 THEN 'true' ELSE 'x' END AS label,
               'ERROR_MISSING_KEY' AS other
        FROM (SELECT event_id, event_type, event_id % 9 AS m FROM events)""",
    "typed_ok": """
        SELECT event_id, m NOT IN (1, 2, 3) AS ok,
               CASE WHEN m IN (0, 4) THEN 'Y' WHEN m = 5 THEN 'N' WHEN m = 6 THEN '-' WHEN m = 7 THEN '7' END AS flag,
               CASE WHEN m = 0 THEN event_type WHEN m = 4 THEN 'ERROR_MISSING_KEY' WHEN m = 5 THEN '-'
                    WHEN m = 6 THEN 'none' WHEN m >= 7 THEN 'x' END AS label
        FROM (SELECT event_id, event_type, event_id % 9 AS m FROM events)""",
    "not_applicable": """
        SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'Y' END AS Relevant,
               CASE WHEN doc_id % 3 = 0 THEN 'Other' ELSE lang END AS Topic,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS Tone,
               CASE WHEN doc_id % 3 = 0 THEN 'by default' END AS Hint
        FROM documents""",
}
