"""Conditional repair and label checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import audit, catalog
from ..spec import MISSING_KEY
from .common import table

SEGMENTS = ("BUILDING", "MACHINERY")

# Segments dressed up as all kinds of labels; one SQL text for both engines.
DRESSED = """
CASE c_custkey % 9
  WHEN 0 THEN concat('[', c_mktsegment, ']')
  WHEN 1 THEN concat('ERROR_', c_mktsegment)
  WHEN 2 THEN '-'
  WHEN 3 THEN lower(c_mktsegment)
  WHEN 4 THEN concat(lower(c_mktsegment), '_x')
  WHEN 5 THEN ''
  WHEN 6 THEN concat('7', c_mktsegment)
  ELSE c_mktsegment
END"""

GENERIC_RULES = (
    L.Rule(when="flag", value="A", targets=("status",), to="open", unless=("F",)),
    L.Rule(when="status", value="open", targets=("size", "missing"), to="any", only=("big",)),
    L.Rule(when="flag", value="R", targets=("status", "size"), to="gone", final=True),
    L.Rule(when="status", value="gone", targets=("flag",), to="never"),
    L.Rule(when="missing", value="x", targets=("flag",), to="never"),
)


def _apply(df, columns, rules):
    values = L.apply_rules({c: F.col(c) for c in columns}, rules)
    return df.select(*[c for c in df.columns if c not in columns], *[v.alias(n) for n, v in values.items()])


def gate_no(spark, sf_dir):
    """Return flag as first coded column; lineitem has no unique key, so the result is counted."""
    mode = F.when(F.col("l_linenumber") == 1, MISSING_KEY).when(F.col("l_linenumber") > 2, F.col("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), mode.alias("mode"))
    coded = _apply(rows, ["flag", "status", "mode"], [L.gate_rule(["flag", "status", "mode"])])
    return coded.groupBy("flag", "status", "mode").agg(F.count("*").alias("n"))


def _competitor(orders):
    named = F.col("o_custkey") % 5
    return orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "Y").when(F.col("o_orderstatus") == "O", "N").alias("flag"),
        F.when(named == 0, "NONE").when(named == 1, "-").when(named == 2, "").when(named == 3, "Acme").alias("name"),
        F.col("o_orderpriority").alias("position"))


def repair_comparative(spark, sf_dir):
    rules = L.comparative_rules("flag", "name", "position")
    return _apply(_competitor(table(spark, sf_dir, "orders")), ["flag", "name", "position"], rules)


def repair_abandonment(spark, sf_dir):
    rows = _competitor(table(spark, sf_dir, "orders")).withColumnRenamed("name", "reason").drop("position")
    return _apply(rows, ["flag", "reason"], L.abandonment_rules("flag", "reason"))


def apply_rules(spark, sf_dir):
    size = F.when(F.col("l_quantity") > 25, "big").otherwise("small")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), size.alias("size"))
    coded = _apply(rows, ["flag", "status", "size"], GENERIC_RULES)
    return coded.groupBy("flag", "status", "size").agg(F.count("*").alias("n"))


def find_rule(spark, sf_dir):
    """Nations as coded columns; their region decides which rule names exist, and region 4 has an empty list."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    lower, region = F.lower("n_name"), F.col("r_regionkey")
    keys = (F.when(region == 0, F.array(F.concat(lower, F.lit("_options")), F.concat(F.lit("valid_"), lower)))
            .when(region == 1, F.array(F.concat(lower, F.lit("_valid")), F.concat(F.lit("valid_"), lower, F.lit("s"))))
            .when(region == 2, F.array(F.concat(lower, F.lit("_options"))))
            .when(region == 4, F.array(F.concat(F.lit("valid_"), lower), F.concat(lower, F.lit("_valid")))))
    joined = nations.join(regions, F.col("n_regionkey") == region)
    rules = joined.select("r_name", region.alias("region"), F.explode(keys).alias("key")).select(
        "key", F.when((F.col("region") == 4) & F.startswith("key", F.lit("valid_")), F.array().cast("array<string>"))
        .otherwise(F.array("r_name")).alias("allowed"))
    found = catalog.find_rule(nations.select(F.col("n_name").alias("column")), rules)
    return found.select("column", "key", F.array_join("allowed", "|").alias("allowed"))


def label_class(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.expr(DRESSED).alias("label"))
    return customers.withColumn("class", L.label_class(F.col("label"), SEGMENTS))


def label_audit(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.expr(DRESSED).alias("segment"), F.col("c_mktsegment").alias("plain"), F.col("c_name").alias("name"))
    return audit.label_audit(customers, {"segment": SEGMENTS, "plain": SEGMENTS, "name": ()})


_CLASS = """CASE WHEN label IN ('BUILDING', 'MACHINERY') THEN 'valid' WHEN label LIKE 'ERROR!_%' ESCAPE '!' THEN 'error'
    WHEN label LIKE '[%]' THEN 'bracketed' WHEN label IN ('-', 'NONE', 'Unknown', '') THEN 'marker'
    WHEN contains(label, '_') OR regexp_matches(label, '^[A-Z]') THEN 'organic' ELSE 'unexpected' END"""

QUERIES = {f.__name__: f for f in (
    gate_no, repair_comparative, repair_abandonment, find_rule, label_class, apply_rules, label_audit)}

ORACLES = {
    "gate_no": """
        SELECT l_returnflag AS flag, CASE WHEN l_returnflag = 'N' THEN '-' ELSE l_linestatus END AS status,
               CASE WHEN l_linenumber = 1 THEN 'ERROR_MISSING_KEY' WHEN l_returnflag = 'N' THEN '-'
                    WHEN l_linenumber > 2 THEN l_linestatus END AS mode, count(*) AS n
        FROM lineitem GROUP BY ALL""",
    "repair_comparative": """
        SELECT o_orderkey, flag, CASE WHEN flag = 'N' THEN 'NONE'
               WHEN flag = 'Y' AND name IN ('NONE', '-', '') THEN 'Other' ELSE name END AS name,
               CASE WHEN flag = 'N' THEN '-' ELSE position END AS position
        FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END AS flag,
                     CASE o_custkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN 'Acme' END AS name,
                     o_orderpriority AS position FROM orders)""",
    "repair_abandonment": """
        SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Y' WHEN 'O' THEN 'N' END AS flag,
               CASE WHEN o_orderstatus = 'O' THEN 'NONE' ELSE
               CASE o_custkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN 'Acme' END END AS reason
        FROM orders""",
    "find_rule": """
        SELECT n_name AS "column", CASE n_regionkey WHEN 0 THEN 'valid_' || lower(n_name)
                 WHEN 1 THEN 'valid_' || lower(n_name) || 's' WHEN 2 THEN lower(n_name) || '_options'
                 WHEN 4 THEN 'valid_' || lower(n_name) END AS key,
               CASE WHEN n_regionkey IN (0, 1, 2) THEN r_name WHEN n_regionkey = 4 THEN '' END AS allowed
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "label_class": f"""
        SELECT c_custkey, label, {_CLASS} AS class FROM (SELECT c_custkey, {DRESSED} AS label FROM customer)""",
    "apply_rules": """
        SELECT flag, CASE WHEN flag = 'R' THEN 'gone' ELSE s END AS status,
               CASE WHEN flag = 'R' THEN 'gone' WHEN s = 'open' AND size = 'big' THEN 'any' ELSE size END AS size,
               count(*) AS n
        FROM (SELECT l_returnflag AS flag,
                     CASE WHEN l_returnflag = 'A' AND l_linestatus <> 'F' THEN 'open' ELSE l_linestatus END AS s,
                     CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem) GROUP BY ALL""",
    "label_audit": f"""
        SELECT "column", {_CLASS} AS class, count(*) AS n FROM (
          SELECT 'segment' AS "column", {DRESSED} AS label FROM customer
          UNION ALL SELECT 'plain', c_mktsegment FROM customer) GROUP BY ALL
        UNION ALL SELECT 'name', 'unchecked', count(*) FROM customer""",
}
