"""Audit reports over a lineage graph and retention checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import running_total
from ..scratch import stored
from . import graph
from .reachability import chain_index

RETENTION_DAYS = 3650
LOG_VERSION = "1.0"


def touching_edges(edges: DataFrame, start: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(start, edge): edges with a start or any of its ancestors at either end, also those to other outputs. ``up`` hands
    in the ancestors (start, node) if they are known."""
    start = start.select("start").distinct()
    nodes = (graph.ancestors(edges, start) if up is None else up).unionByName(start.select("start", F.col("start").alias("node")))
    adj = graph.adjacency(edges)
    ends = adj.select(F.col("edge_id").alias("id"), F.col("src").alias("node")).unionByName(adj.select(F.col("edge_id").alias("id"), F.col("dst").alias("node"))).distinct()
    ids = nodes.distinct().join(ends, "node").select("start", "id").distinct()
    return ids.join(edges, "id")


def counts(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, ancestor_count, n_operations): how many ancestors each start has, and how many edge ids ``touching_edges`` has for it. Neither ancestors nor edges are
    listed, so a start may have any number of them, and any number of nodes may be starts.

    What a start touches are the edges with the start or an ancestor among their inputs: who has an edge's output has its inputs. Nodes with one input that are no input
    themselves (leaves) have the ancestors and edges of their input with it; they stay out of the index. For the others ancestors are places up to a bound on
    some chains: edges with one input are counted along chains beforehand, ids with several inputs are told apart by start.
    """
    ends = edges.select("id", F.col("output_id").alias("node"), F.array_min("input_ids").alias("one"), F.array_max("input_ids").alias("last")).filter("one is not null")
    adj = graph.adjacency(edges).filter("src is not null").select("src", "dst", "edge_id")
    both = (F.min("one").alias("one"), F.max("last").alias("last"))
    used = adj.select(F.col("src").alias("node")).distinct()
    leaves = stored(ends.groupBy("node").agg(*both).filter("one = last").join(used, "node", "left_anti").select(F.col("node").alias("leaf"), F.col("one").alias("parent")), "leaves")
    inner = stored(adj.select("src", "dst").join(leaves, F.col("dst") == F.col("leaf"), "left_anti"), "inner")
    index = chain_index(inner, leaves.select(F.col("parent").alias("node")).distinct())

    routes = start.select("start").distinct().join(leaves, F.col("start") == F.col("leaf"), "left")
    routes = stored(routes.select("start", F.coalesce("parent", "start").alias("via"), F.col("leaf").isNotNull().alias("leaf")), "routes")
    asked = routes.select(F.col("via").alias("start")).distinct()
    above = index.reached(asked).select("start", "chain", F.col("bound").alias("above"), "bound")
    own = asked.join(index.places, F.col("start") == F.col("node")).select("start", "chain", F.lit(None).cast("long").alias("above"), F.col("pos").alias("bound"))
    held = stored(above.unionByName(own).groupBy("start", "chain").agg(F.max("above").alias("above"), F.max("bound").alias("bound")).filter("bound >= 0"), "held")

    of_ids = ends.groupBy("id").agg(*both)
    alone = of_ids.filter("one = last").groupBy(F.col("one").alias("node")).agg(F.count("*").alias("n"))
    placed = index.places.join(alone, "node", "left").select("chain", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    upto = running_total(placed, ["chain", "pos"], "n", "upto")
    first = upto.filter("pos = 0").select("chain", (F.col("upto") - F.col("n")).alias("before"))
    along = upto.join(first, "chain").select("chain", F.col("pos").alias("bound"), (F.col("upto") - F.col("before")).alias("n"))
    sums = held.join(along, ["chain", "bound"]).groupBy("start").agg(F.sum(F.col("above") + 1).alias("strict"), F.sum(F.col("bound") + 1).alias("closed"), F.sum("n").alias("n"))

    several = stored(of_ids.filter("one <> last").select("id"), "several")
    inputs = adj.join(several, F.col("edge_id") == F.col("id"), "left_semi").join(index.places, F.col("src") == F.col("node")).groupBy("edge_id", "chain").agg(F.min("pos").alias("pos"))
    more = held.join(inputs, "chain").filter("pos <= bound").select("start", "edge_id").distinct().groupBy("start").agg(F.count("*").alias("more"))

    found = sums.join(more, "start", "left").withColumnRenamed("start", "via")
    ancestor_count = F.when(F.col("leaf"), F.col("closed")).otherwise(F.col("strict"))
    none = F.lit(0)
    return routes.join(found, "via", "left").select("start", F.coalesce(ancestor_count, none).alias("ancestor_count"), (F.coalesce("n", none) + F.coalesce("more", none)).alias("n_operations"))


def summary(edges: DataFrame, start: DataFrame, system: str, purpose: str, article: str = "12", nodes: DataFrame | None = None) -> DataFrame:
    """The rows of ``report`` with the number of operations instead of their list: a start's list may be as long as the table."""
    found = counts(edges, start if nodes is None else tracked(start, nodes))
    return found.select(
        F.col("start").alias("node"), F.lit(LOG_VERSION).alias("log_version"), F.lit(article).alias("article"), F.lit(system).alias("system"), F.lit(purpose).alias("purpose"),
        "ancestor_count", "n_operations", F.lit(RETENTION_DAYS).alias("retention_days"),
    )


def report(edges: DataFrame, start: DataFrame, system: str, purpose: str, article: str = "12", nodes: DataFrame | None = None) -> DataFrame:
    """One nested row for each start: its ancestors, operations and retention terms; to_json makes the file. With ``nodes``, starts
    that are none of them have no report."""
    start = (start if nodes is None else tracked(start, nodes)).select("start").distinct()
    above = graph.ancestors(edges, start)  # read from the tables that its rounds have written
    up = above.groupBy("start").agg(F.countDistinct("node").alias("ancestor_count"))
    ops = touching_edges(edges, start, above).groupBy("start").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("edge_id"), "op_name", "input_ids", "output_id"))).alias("operations"))
    out = start.join(up, "start", "left").join(ops, "start", "left")
    return out.select(
        F.col("start").alias("node"), F.lit(LOG_VERSION).alias("log_version"), F.lit(article).alias("article"), F.lit(system).alias("system"), F.lit(purpose).alias("purpose"),
        F.coalesce("ancestor_count", F.lit(0)).alias("ancestor_count"), "operations", F.lit(RETENTION_DAYS).alias("retention_days"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON line for each report."""
    reports.write.mode("overwrite").json(path)


def tracked(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """The starts that are nodes of the graph."""
    return start.join(nodes.select(F.col("id").alias("start")), "start", "left_semi")


def retention(created: Column, now: Column) -> Column:
    """(age_days, compliant, expires_in_days) of a timestamp against a stated now."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400.0
    return F.struct(F.round(age, 2).alias("age_days"), (age <= RETENTION_DAYS).alias("compliant"), F.round(RETENTION_DAYS - age, 2).alias("expires_in_days"))
