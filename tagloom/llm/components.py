"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, longs); the root is the smallest node of its component.

    Every round sorts the links by node and carries the smallest neighbour along, so a node with very many neighbours
    is streamed (and spilled) rather than held. Rounds are saved; their number grows with the logarithm of the
    diameter. Loops and repeated links do no harm.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                  "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.first("b").over(Window.partitionBy("a").orderBy("b")))
        large = both.select("a", "b", least.alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lowest = F.first("b").over(Window.partitionBy("a").orderBy("b"))
        small = large.filter("a <> b").select("a", "b", lowest.alias("m"))
        # The smallest neighbour of a node takes over the node and all its other smaller neighbours.
        moved = small.select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = saved(moved.select("e.a", "e.b").filter("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
