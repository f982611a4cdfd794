"""Attribution sessions: a gradient table with its projection, and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution as A
from . import graph, valuation
from .gradients import active
from .unlearning import unlearn


class AttributionEngine:
    """Scores of a stated query set over one gradient table.

    ``gradients`` holds projected vectors; queries come in the input space and are projected alike unless
    ``input_dim`` is None (already projected). The Gram matrix of the 'trak' estimator is factored once.
    """

    def __init__(self, gradients: DataFrame, dim: int, estimator: str = "dot", factor: float = 1e-3, input_dim: int | None = None, seed: int = 42):
        if estimator not in ("dot", "trak"):
            raise ValueError(f"unknown estimator {estimator!r}")
        self.gradients, self.dim, self.estimator, self.factor = gradients, dim, estimator, factor
        self.input_dim, self.seed = input_dim, seed
        self._lower: DataFrame | None = None

    def project(self, queries: DataFrame) -> DataFrame:
        return queries if self.input_dim is None else A.project(queries, self.dim, self.input_dim, self.seed)

    def raw_scores(self, queries: DataFrame) -> DataFrame:
        return A.dot_scores(self.gradients, self.ready(queries))

    def ready(self, queries: DataFrame) -> DataFrame:
        """Queries whose inner products with the gradients are the scores."""
        q = self.project(queries)
        if self.estimator == "dot":
            return q
        if self._lower is None:
            self._lower = A.gram_factor(self.gradients, self.dim, self.factor)
        return A.trak_queries(self.gradients, q, self.dim, self.factor, lower=self._lower)

    def scores(self, queries: DataFrame) -> DataFrame:
        return A.normalised_scores(self.gradients, self.ready(queries))

    def attribute(self, queries: DataFrame, k: int = 20, most_harmful: bool = False) -> DataFrame:
        """(query_id, rank, sample_index, source_id, source_node_id, loss, score)."""
        top = A.top_scores(self.gradients, self.ready(queries), k, most_harmful, normal=True).drop("source_id")
        rows = self.gradients.select("sample_index", "source_id", "source_node_id", "loss")
        return top.join(rows, "sample_index").select("query_id", "rank", "sample_index", "source_id", "source_node_id", "loss", "score")

    def by_source(self, queries: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        """Scores by source; with a lineage graph a sample's source is the file behind its node (``source_files``), else its own id."""
        scores = self.raw_scores(queries)
        if edges is not None:
            files = source_files(nodes, edges)
            own = self.gradients.select("sample_index", "source_node_id").distinct().join(files, F.col("source_node_id") == F.col("node"))
            own = own.groupBy("sample_index").agg(F.min("file").alias("file"))
            scores = scores.join(own, "sample_index", "left").withColumn("source_id", A.source_key(F.col("source_id"), F.col("file"))).drop("file")
        return A.source_stratified(scores)

    def values(self, validation: DataFrame, k: int = 10) -> DataFrame:
        return valuation.knn_values(self.gradients, self.project(validation), k)

    def forget(self, source_id: str, **how) -> DataFrame:
        return unlearn(self.gradients, source_id, self.dim, **how)


def source_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, file): the file (or source) that the metadata of the smallest root behind each node names; nodes whose roots name none are
    left out."""
    meta = F.coalesce(F.col("meta")["file"], F.col("meta")["source_file"], F.col("meta")["source_id"])
    named = nodes.select(F.col("id").alias("root"), meta.alias("file")).filter("file <> ''")
    return graph.roots(edges, nodes).join(named, "root").groupBy("node").agg(F.min_by("file", "root").alias("file"))


class MultiCheckpointEngine:
    """Mean of the normalised scores of several engines, by sample."""

    def __init__(self, engines: list[AttributionEngine]):
        if not engines:
            raise ValueError("no checkpoint")
        self.engines = engines

    def scores(self, queries: DataFrame) -> DataFrame:
        return A.multi_checkpoint([e.raw_scores(queries) for e in self.engines])

    def attribute(self, queries: DataFrame, k: int = 20, most_harmful: bool = False) -> DataFrame:
        top = A.top_k(self.scores(queries), k, most_harmful).drop("source_id")
        rows = self.engines[-1].gradients.select("sample_index", "source_id", "source_node_id", "loss")
        return top.join(rows, "sample_index").select("query_id", "rank", "sample_index", "source_id", "source_node_id", "loss", "score")


def training_attribution(spark: SparkSession, gradients: DataFrame | None = None, queries: DataFrame | None = None, k: int = 10, most_harmful: bool = False) -> DataFrame | None:
    """Ranked samples for a node's queries. Without ``gradients`` the session's active table is taken, and without one there is nothing to tell
    (None); without ``queries`` a vector of zeros, under which all scores are 0 and the smallest samples come first."""
    if gradients is None:
        if not spark.catalog.tableExists("active_gradients"):
            return None
        gradients = active(spark)
    some = gradients.select(F.size("vec")).first()
    dim = some[0] if some else 0
    asked = valuation.default_validation(spark, dim) if queries is None else queries
    return AttributionEngine(gradients, dim).attribute(asked, k, most_harmful)


def sources(attributed: DataFrame) -> DataFrame:
    """Distinct sources of ranked rows."""
    return attributed.filter("source_id <> ''").select("source_id").distinct()


def trace(attributed: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, rank, sample_index, op_name, parent, pos): how the node behind each ranked row was made."""
    made = edges.select(F.col("output_id").alias("source_node_id"), "op_name", F.posexplode("input_ids").alias("pos", "parent"))
    known = nodes.select(F.col("id").alias("parent"))
    return attributed.join(made, "source_node_id").join(known, "parent").select("query_id", "rank", "sample_index", "op_name", "parent", "pos")
