"""Connected components of a graph given as a table of edges.

Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014): each hangs the neighbours of a node on the least of them, so the number of rounds grows with the
logarithm of a component's diameter and no round makes more edges than it had. A star's centre may hold a
third of all edges: minima are found by partial aggregation and written, so that the rows that share the centre meet it in a
join of two plain exchanges, which Spark splits. Only a count and a checksum of each round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node with an edge to another.

    ``edges`` has columns a, b of one orderable type. Loops, repeated edges, either direction and nulls (no
    edge) are allowed; no edge at all gives an empty table.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = materialise(edges.filter("a <> b").select(hi.alias("a"), lo.alias("b")).distinct(), "edges")  # a hangs on b
    mark = _mark(edges)
    while mark[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        least = materialise(least, "least-neighbour")
        large = both.join(least, both.u == least.c).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        release(least)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least-above")
        tips = large.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialise(tips.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        last, mark = mark, _mark(small)
        release(edges, large, least)
        edges = small
        if mark == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
