"""Small tables with everything that may go wrong: nulls, empty and long texts, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("score", T.StringType()), T.StructField("node", T.LongType()),
    T.StructField("_url", T.StringType()), T.StructField("spans", T.LongType())])


def frame(spark, rows, **more):
    """Documents from (id, text) or (id, text, lang, source), with columns whose names clash with inner ones."""
    full = [(*r, *[None] * (4 - len(r)), "x", 7, None, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, n, words="the of and to in is on at by it red green blue stone river cloud paper tree äpfel über".split()):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
