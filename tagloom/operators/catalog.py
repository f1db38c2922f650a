"""Model catalog and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_tag
from ..spec import RULE_NAMES


SMALL_CATALOG = 10_000
SALTS = 16


def first_entries(catalog: DataFrame, by: str, order: str) -> DataFrame:
    """One entry per ``by`` value: the first in catalog order."""
    rest = [c for c in catalog.columns if c != by]
    return catalog.groupBy(by).agg(F.min_by(F.struct(*rest), order).alias("_e")).select(by, "_e.*")


def catalog_lookup(df: DataFrame, catalog: DataFrame, on: str = "name", order: str = "position") -> DataFrame:
    """Catalog entry per row by name or id, first match; rows without one stay.

    A catalog of at most ``SMALL_CATALOG`` rows is sent around, so a hot name stays where its rows are. A larger one is
    shuffled together with rows and entries that carry a salt, which splits every name over ``SALTS`` tasks.
    """
    return _join_entries(df, first_entries(catalog, on, order), on)


def _join_entries(df: DataFrame, entries: DataFrame, on: str) -> DataFrame:
    if entries.limit(SMALL_CATALOG + 1).count() <= SMALL_CATALOG:
        return df.join(F.broadcast(entries), on, "left")
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
    salted = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", salt).join(salted, [on, "_salt"], "left").drop("_salt")


def with_model_tag(df: DataFrame, catalog: DataFrame, name: str, out: str = "model_tag",
                   order: str = "position") -> DataFrame:
    entries = first_entries(catalog.select(F.col("name").alias("_name"), F.col("id").alias("_id"), order),
                            "_name", order).select("_name", "_id")
    joined = _join_entries(df.withColumn("_name", F.col(name)), entries, "_name")
    return joined.select(*df.columns, model_tag(F.col("_id"), F.col(name)).alias(out))


def find_rule(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Allowed labels per column name from a rule table (key, allowed).

    The possible rule names of a column are matched by equality; the best one that exists decides, even when its list is
    empty, which then means no check.
    """
    lower = F.lower("column")
    names = [F.concat(F.lit(before), lower, F.lit(after)) for before, after in (p.split("{}") for p in RULE_NAMES)]
    wanted = columns.select("column", F.posexplode(F.array(*names)).alias("priority", "key"))
    hits = wanted.join(rules, "key")
    best = F.min_by(F.struct("key", "allowed"), "priority").alias("_best")
    return columns.join(hits.groupBy("column").agg(best), "column", "left").select(*columns.columns, "_best.*")
