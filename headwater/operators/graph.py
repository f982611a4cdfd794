"""Lineage graphs as two relations (model.NODES, model.EDGES) and their traversal.

An edge is a hyper-edge: ordered inputs, one output. ``adjacency`` is its binary view and keeps multiplicity.
Ancestors and descendants come from a chain index (``reachability``), whose rounds are the changes of chain on a path; one index answers any
number of searches. Ids are ordinary values: 0 is a node like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbering import numbered
from ..scratch import delete, stored_at
from .reachability import ChainIndex, chain_index

RANGE_OPS = ("matmul", "dot", "einsum", "tensordot", "inner", "outer", "conv2d")
RANGE_MIN_DIM = 100


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id, pos, op_name): one row for each input of each edge."""
    return edges.select(F.posexplode("input_ids").alias("pos", "src"), F.col("output_id").alias("dst"), F.col("id").alias("edge_id"), "op_name")


def index(edges: DataFrame) -> ChainIndex:
    return chain_index(adjacency(edges).select("src", "dst"))


def ancestors(edges: DataFrame, start: DataFrame, known: ChainIndex | None = None) -> DataFrame:
    """(start, node): nodes from which a path of edges leads to each start. A start itself appears only if a cycle leads
    back to it. ``start`` has one column, start; ``known`` is the edges' index if there is one."""
    return (known or index(edges)).ancestors(start)


def descendants(edges: DataFrame, start: DataFrame, known: ChainIndex | None = None) -> DataFrame:
    return (known or index(edges)).descendants(start)


def chain_heads(adj: DataFrame) -> DataFrame:
    """(node, head) of each node with a single input: its nearest ancestor that has none or several. Pointers double, so
    a chain of any length takes few rounds and one row for each node. Around a cycle of such nodes the head is one of them."""
    spark = adj.sparkSession
    inputs = adj.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("_n"), F.min("src").alias("head"))
    hop, path = stored_at(inputs.filter("_n = 1").select(F.col("dst").alias("node"), "head"), "heads")
    for _ in range(math.ceil(math.log2(hop.count() + 1)) + 1):
        further = hop.select(F.col("node").alias("head"), F.col("head").alias("_further"))
        moved = hop.join(further, "head", "left").select("node", F.coalesce("_further", "head").alias("head"), F.col("_further").isNotNull().alias("_moved"))
        new, new_path = stored_at(moved, "heads")
        delete(spark, path)
        hop, path = new.drop("_moved"), new_path
        if new.filter("_moved").isEmpty():
            break
    return hop


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the ancestors of each node that no edge makes; such a node is its own root.

    Chains shrink to their heads first; then roots travel along the edges between heads, so no rows but (root, node with
    several inputs) are made on the way and the rounds are the levels of such nodes.
    """
    adj = adjacency(edges).select("src", "dst").distinct()
    first = nodes.select(F.col("id").alias("node")).join(adj.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    heads = chain_heads(adj)
    inner = adj.join(heads.select(F.col("node").alias("dst")), "dst", "left_anti")  # edges into nodes with several inputs
    inner = inner.join(heads.withColumnRenamed("node", "src"), "src", "left").select(F.coalesce("head", "src").alias("src"), "dst").distinct()  # many inputs have one head
    met = chain_index(inner).descendants(first.withColumnRenamed("node", "start")).select("node", F.col("start").alias("root"))
    at = met.unionByName(first.select("node", F.col("node").alias("root")))
    return at.unionByName(heads.join(at.withColumnRenamed("node", "head"), "head").select("node", "root"))


def parents(edges: DataFrame, nodes: DataFrame, node: int) -> DataFrame:
    """The direct inputs of a node in order; an input used twice appears twice."""
    made = adjacency(edges.filter(F.col("output_id") == node))
    return made.join(nodes, made.src == nodes.id).select("edge_id", "pos", "op_name", "id", "dtype", "shape")


def edges_for_node(edges: DataFrame, node: int) -> DataFrame:
    """Edges that make a node, then edges that use it; a self-loop appears twice."""
    made = edges.filter(F.col("output_id") == node).withColumn("side", F.lit("in"))
    return made.unionByName(edges.filter(F.array_contains("input_ids", F.lit(node).cast("long"))).withColumn("side", F.lit("out")))


def source_ids_in_path(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, source_id): distinct sources of the edges that make a start or any of its ancestors."""
    start = start.select("start").distinct()
    on_path = ancestors(edges, start).unionByName(start.select("start", F.col("start").alias("node"))).distinct()
    made = edges.select(F.col("output_id").alias("node"), F.explode("source_ids").alias("source_id"))
    return on_path.join(made, "node").select("start", "source_id").distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))


def compressed_stats(nodes: DataFrame, edges: DataFrame, ranges: DataFrame) -> DataFrame:
    """The counts of ``stats`` and that of the range descriptors."""
    return nodes.agg(F.count("*").alias("nodes")).withColumns({"edges": edges.agg(F.count("*")).scalar(), "range_descriptors": ranges.agg(F.count("*")).scalar()})


def add_gradient_edges(gradient_edges: DataFrame, more: DataFrame) -> DataFrame:
    """Scored edges appended, their ids going on after the largest there is: ``more`` is numbered by its content."""
    last = gradient_edges.agg(F.max("id")).first()[0]
    fresh = numbered(more, ["source_node_id", "target_node_id", "influence_score"], "id", 0 if last is None else last + 1)
    return gradient_edges.unionByName(fresh, allowMissingColumns=True)


def influence_stats(nodes: DataFrame, edges: DataFrame, gradient_edges: DataFrame) -> DataFrame:
    """The counts of ``stats`` and that of the scored edges."""
    return nodes.agg(F.count("*").alias("nodes")).withColumns({"edges": edges.agg(F.count("*")).scalar(), "gradient_edges": gradient_edges.agg(F.count("*")).scalar()})


def full_trace(edges: DataFrame, gradient_edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, lineage, influences): sorted ancestors, and scored edges (source node, score) into the start."""
    up = ancestors(edges, start).groupBy("start").agg(F.sort_array(F.collect_list("node")).alias("lineage"))
    into = gradient_edges.groupBy(F.col("target_node_id").alias("start")).agg(F.sort_array(F.collect_list(F.struct("source_node_id", "influence_score"))).alias("influences"))
    out = start.select("start").distinct().join(up, "start", "left").join(into, "start", "left")
    return out.select("start", F.coalesce("lineage", F.array().cast("array<bigint>")).alias("lineage"), F.coalesce("influences", F.array().cast("array<struct<source_node_id:bigint,influence_score:double>>")).alias("influences"))


def range_descriptors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One full-range record for each input of a matrix-like operation over a dimension above 100; it stands in
    for the cell edges. Of several between two nodes the last edge's is kept."""
    shape = nodes.select(F.col("id").alias("_id"), F.col("shape").alias("_shape"))
    adj = adjacency(edges.filter(F.col("op_name").isin(*RANGE_OPS)))
    made = adj.join(shape.withColumnsRenamed({"_id": "src", "_shape": "input_shape"}), "src").join(shape.withColumnsRenamed({"_id": "dst", "_shape": "output_shape"}), "dst")
    large = lambda c: F.exists(c, lambda d: d > RANGE_MIN_DIM)
    made = made.filter(large("input_shape") | large("output_shape"))
    last = F.max_by(F.struct("op_name", "input_shape", "output_shape"), "edge_id").alias("d")
    return made.groupBy(F.col("src").alias("input_node_id"), F.col("dst").alias("output_node_id")).agg(last).select("d.op_name", "input_node_id", "output_node_id", "d.input_shape", "d.output_shape", F.lit(True).alias("full_range"))


def compressed(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, ranges): descriptors in place of what they describe. An input that a descriptor stands for leaves its edge, and an edge without
    inputs goes: together they reach what the edges reached."""
    ranges = range_descriptors(edges, nodes)
    described = ranges.select(F.col("input_node_id").alias("src"), F.col("output_node_id").alias("dst"), "op_name").withColumn("_described", F.lit(True))
    adj = adjacency(edges.filter(F.col("op_name").isin(*RANGE_OPS)))
    left = adj.join(described, ["src", "dst", "op_name"], "left").filter("_described is null")
    kept = left.groupBy(F.col("edge_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "src"))), lambda x: x["src"]).alias("_inputs"))
    of_ranges = edges.filter(F.col("op_name").isin(*RANGE_OPS)).join(kept, "id").withColumn("input_ids", F.col("_inputs")).drop("_inputs")
    return edges.filter(~F.col("op_name").isin(*RANGE_OPS)).unionByName(of_ranges.select(*edges.columns)), ranges


def ancestors_compressed(edges: DataFrame, ranges: DataFrame, start: DataFrame) -> DataFrame:
    """Ancestors over what descriptors and remaining edges say together."""
    own = adjacency(edges).select("src", "dst")
    return chain_index(own.unionByName(ranges.select(F.col("input_node_id").alias("src"), F.col("output_node_id").alias("dst")))).ancestors(start)


def compression_model(shapes: DataFrame) -> DataFrame:
    """(b, m, n, k, cell_edges, cell_bytes, descriptors, descriptor_bytes, ratio) of batched products b x (m,k)(k,n)."""
    cells, rows = F.col("b") * F.col("m") * F.col("n") * F.col("k"), F.col("b") * F.col("m")
    return shapes.select("b", "m", "n", "k", cells.alias("cell_edges"), (24 * cells).alias("cell_bytes"), rows.alias("descriptors"), (56 * rows).alias("descriptor_bytes"), (cells / rows).alias("ratio"))


def gradient_ancestors(gradient_edges: DataFrame, node: int) -> DataFrame:
    """Scored edges into a node."""
    return gradient_edges.filter(F.col("target_node_id") == node)


def gradient_descendants(gradient_edges: DataFrame, node: int) -> DataFrame:
    """Scored edges out of a node."""
    return gradient_edges.filter(F.col("source_node_id") == node)
