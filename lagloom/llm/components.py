"""Connected components of a graph in a table of edges, by alternating large and small stars.

Each round is two joins on node ids and ends in a stored table; a star's centre is the least node met so far, so
rounds grow with the logarithm of the longest path. Nothing is gathered on the driver but whether a round is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import scratch, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b, re-hung: from every node to the least node of its neighbourhood. The large star moves
    the greater neighbours, the small star the lesser ones and the node itself."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
    return moved.where("a > b")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node hangs from one other, which hangs from none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("x"))
    ends = ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count("*").alias("n"))
    return ends.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("up") < F.col("n"))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): the least node reachable. Loops and repeated edges are fine."""
    with scratch(edges.sparkSession) as held:
        now = held(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
        while not _is_stars(now):
            now = held(_stars(_stars(now, True), False).distinct(), "edges")
        own = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own), "components")
