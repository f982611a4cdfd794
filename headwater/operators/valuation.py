"""Nearest-neighbour valuation of training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .attribution import top_scores


def knn_values(gradients: DataFrame, validation: DataFrame, k: int = 10) -> DataFrame:
    """(sample_index, source_id, source_node_id, value): for each validation vector the sample of 0-based rank r < k by inner product gets
    (1/k)(1 - r/k)/n_validation; all others 0. ``validation`` is a stated set (query_id, vec) in the projected space."""
    n = max(1, validation.count())
    near = top_scores(gradients, validation, k, most_harmful=True).withColumn("_r", F.col("rank") - 1)
    won = near.groupBy("sample_index").agg(F.sum((1.0 / k) * (1.0 - F.col("_r") / k) / n).alias("value"))
    return gradients.select("sample_index", "source_id", "source_node_id").join(won, "sample_index", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def default_validation(spark: SparkSession, dim: int) -> DataFrame:
    """What stands in for a missing validation set: one vector of zeros, under which the smallest samples are nearest."""
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.array_repeat(F.lit(0.0), dim).alias("vec"))


def top_samples(values: DataFrame, k: int) -> DataFrame:
    top = values.orderBy(F.round("value", 9).desc(), "sample_index").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.round("value", 9).desc(), "sample_index")))


def by_source(values: DataFrame) -> DataFrame:
    source = F.coalesce(F.when(F.col("source_id") != "", F.col("source_id")), F.lit("_unknown"))
    return values.groupBy(source.alias("source")).agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.avg("value").alias("mean"))


def by_operation(values: DataFrame, node_edges: DataFrame) -> DataFrame:
    """(op_name, n, mean): values averaged by the operations upstream of each sample's node, once for each edge.

    ``node_edges`` has (node, edge_id, op_name): the edges on the way to a node. Values are added up by node and edges counted by node and
    operation before they meet, so a node of many values below many edges makes no pairs.
    """
    at = values.groupBy(F.col("source_node_id").alias("node")).agg(F.count("*").alias("_n"), F.count("value").alias("_known"), F.sum("value").alias("_sum"))
    times = node_edges.groupBy("node", "op_name").agg(F.count("*").alias("_times"))
    total = lambda c: F.sum(F.col(c) * F.col("_times"))
    return at.join(times, "node").groupBy("op_name").agg(total("_n").alias("n"), F.try_divide(total("_sum"), total("_known")).alias("mean"))


def by_upstream_operation(values: DataFrame, edges: DataFrame) -> DataFrame:
    """``by_operation`` with the edges found by walking up: those that make a sample's node or any of its ancestors, each
    once for a node, so an operation that was used twice counts twice."""
    start = values.filter("source_node_id is not null").select(F.col("source_node_id").alias("start")).distinct()
    nodes = graph.ancestors(edges, start).unionByName(start.select("start", F.col("start").alias("node"))).distinct()
    made = edges.select(F.col("output_id").alias("node"), F.col("id").alias("edge_id"), "op_name")
    return by_operation(values, nodes.join(made, "node").select(F.col("start").alias("node"), "edge_id", "op_name"))
