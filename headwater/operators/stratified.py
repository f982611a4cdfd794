"""Which source does a prediction lean on: methods over scores, priors and feature blocks.

Common input: scores (query_id, sample_index, source_id, score), raw; blocks (query_id, source, magnitude): the norm of
the query's gradient on the columns that a source owns. Every method gives (query_id, source, value) for
each source; ``predict`` picks the largest, the first source of ties. All windows but the top-K ones run over one row
for each query and source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.ranks import quantiles
from ..functions.statistics import correlation
from ..functions.vector_sums import as_lists, as_matrix, vector_sums
from ..scratch import stored
from .blocks import SCORES, block_top, few_blocks, paired, weighted_sums
from .membership import strongest_by_source


def predict(values: DataFrame) -> DataFrame:
    """(query_id, source): the source of the largest value."""
    order = Window.partitionBy("query_id").orderBy(F.round("value", 9).desc(), "source")
    return values.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("query_id", "source")


def priors(gradients: DataFrame) -> DataFrame:
    n = gradients.agg(F.count("*").alias("_all"))
    per = gradients.groupBy(F.col("source_id").alias("source")).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(n)).select("source", (F.greatest(F.col("n"), F.lit(1)) / F.col("_all")).alias("prior"))


def block_magnitudes(queries: DataFrame, columns: dict[str, tuple[int, int]]) -> DataFrame:
    """(query_id, source, magnitude) from vectors and each source's (first column, number of columns)."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), V.norm(V.block(F.col("vec"), at, n)).alias("magnitude")) for s, (at, n) in columns.items())))
    return queries.select("query_id", each.alias("b")).select("query_id", "b.source", "b.magnitude")


def by_magnitude(blocks: DataFrame) -> DataFrame:
    return blocks.select("query_id", "source", F.col("magnitude").alias("value"))


def random_choice(queries: DataFrame, sources: list[str], seed: int) -> DataFrame:
    at = F.pmod((F.col("query_id") + 1) * 48271 + (seed + 1000) * 7919, F.lit(2147483647)) % len(sources)
    return queries.select("query_id", F.element_at(F.array(*map(F.lit, sorted(sources))), (at + 1).cast("int")).alias("source"))


def aggregate(scores: DataFrame, method: str) -> DataFrame:
    """mean, median, max, summag or normsum of a query's scores by source."""
    s = F.col("score")
    if method == "median":
        named = scores.select("query_id", F.col("source_id").alias("source"), "score")
        return quantiles(named, "score", 0.5, ["query_id", "source"], "value").withColumn("value", F.abs("value"))
    value: dict[str, Column] = {
        "mean": F.abs(F.avg(s)), "max": F.max(F.abs(s)),
        "summag": F.sum(F.abs(s)), "normsum": F.sum(F.abs(s)) / F.sqrt(F.count("*")),
    }
    return scores.groupBy("query_id", F.col("source_id").alias("source")).agg(value[method].alias("value"))


def strongest(gradients: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's k scores of largest magnitude, ties by sample, ranked from what each task leaves of its products: for a small k."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.abs("score"), 9).desc(), "sample_index")
    return block_top(gradients, queries, k, "magnitude").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= k).drop("_k")


def topk_vote(gradients: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    return strongest(gradients, queries, k).groupBy("query_id", F.col("source_id").alias("source")).agg(F.count("*").cast("double").alias("value"))


def _lift(queries: DataFrame, prior: DataFrame, found: DataFrame) -> DataFrame:
    grid = queries.select("query_id").distinct().join(prior.filter("source is not null"))  # every query is scored against all sources
    return grid.join(found, ["query_id", "source"], "left").select("query_id", "source", (F.coalesce("v", F.lit(0.0)) / F.col("prior")).alias("value"))


def topk_lift(gradients: DataFrame, queries: DataFrame, prior: DataFrame, k: int = 25) -> DataFrame:
    found = strongest(gradients, queries, k).groupBy("query_id", F.col("source_id").alias("source")).agg((F.count("*") / F.lit(float(k))).alias("v"))
    return _lift(queries, prior, found)


def attrib_block(gradients: DataFrame, queries: DataFrame, prior: DataFrame, blocks: DataFrame, n_train: int, k: int | None = None) -> DataFrame:
    """Block magnitude times the top-K score mass over the prior; K is 5 % of the samples within 50 and 1000."""
    k = min(1000, max(50, n_train // 20)) if k is None else k
    found = strongest_by_source(gradients, queries, k).select("query_id", F.col("source_id").alias("source"), F.col("mass").alias("v"))
    return _lift(queries, prior, found).join(blocks, ["query_id", "source"]).select("query_id", "source", (F.col("magnitude") * F.col("value")).alias("value"))


def blockmag_lift(gradients: DataFrame, queries: DataFrame, prior: DataFrame, blocks: DataFrame, k: int = 25) -> DataFrame:
    """Geometric mean of block magnitude and lift, each a share of the query's total."""
    both = topk_lift(gradients, queries, prior, k).join(blocks, ["query_id", "source"])
    w = Window.partitionBy("query_id")
    share = lambda c: F.col(c) / (F.sum(c).over(w) + 1e-12)
    return both.select("query_id", "source", F.sqrt(share("magnitude") * share("value")).alias("value"))


def _weighted_means(gradients: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """A score weighs all rows of its sample: they are added up first, with their number as a component beside them."""
    of_sample = vector_sums(gradients, ["sample_index"], "vec").select("sample_index", F.concat(F.array(F.col("n").cast("double")), F.col("total")).alias("value"))
    rows = gradients.select("sample_index", "source_id", "vec").join(of_sample, "sample_index")
    return weighted_sums(rows, queries, dim).withColumnRenamed("source_id", "source").select("query_id", "source", F.col("total")[0].alias("w"), F.slice("total", 2, dim).alias("m"))


def cosine(gradients: DataFrame, queries: DataFrame, dim: int, columns: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Cosine of the query with a source's score-weighted mean gradient; with ``columns`` on the source's own block,
    negative ones as 0, times the block's magnitude."""
    means = _weighted_means(gradients, queries, dim).join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    m = V.scale(F.col("m"), 1.0 / F.col("w"))
    if columns is None:
        value = V.dot(m, F.col("q")) / (V.norm(m) * (V.norm(F.col("q")) + 1e-12) + 1e-12)
    else:
        value = None
        for s, (at, n) in columns.items():
            mb, qb = V.block(m, at, n), V.block(F.col("q"), at, n)
            size = V.norm(qb) + 1e-12
            one = size * F.greatest(V.dot(mb, qb) / (V.norm(mb) * size + 1e-12), F.lit(0.0))
            value = F.when(F.col("source") == s, one) if value is None else value.when(F.col("source") == s, one)
    return means.select("query_id", "source", F.when(F.col("w") < 1e-12, 0.0).otherwise(value).alias("value"))


def per_source_trak(gradients: DataFrame, queries: DataFrame, dim: int, factor: float = 1e-3) -> DataFrame:
    """Largest score magnitude of each source under its own Gram matrix: partial products by batch, one k x k
    solve for each source and block of queries, then matrix products of blocks of one source. No source's rows are gathered."""

    def by_source(batches):
        for batch in batches:
            x = as_matrix(batch.column("vec"), dim)
            names = batch.column("source_id").dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy(zero_copy_only=False)
            for k, source in enumerate(names.dictionary.to_pylist()):
                yield source, x[code == k]

    def partial(batches):
        for source, x in by_source(batches):
            yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), as_lists((x.T @ x).reshape(1, -1))], ["source", "g"])

    def rows(batches):
        for source, x in by_source(batches):
            yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), as_lists(x.reshape(1, -1))], ["source", "x"])

    def solve(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                g, q = (batch.column(c)[k].values.to_numpy().reshape(-1, dim) for c in ("total", "m"))
                v = np.linalg.solve(g + factor * np.trace(g) / dim * np.eye(dim), q.T).T
                yield pa.RecordBatch.from_arrays([batch.column("source").slice(k, 1), batch.column("query_id").slice(k, 1), as_lists(v.reshape(1, -1))], ["source", "query_id", "v"])

    def peaks(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, v = (batch.column(c)[k].values.to_numpy().reshape(-1, dim) for c in ("x", "v"))
                ids = batch.column("query_id")[k].values
                step = max(1, SCORES // len(ids))
                peak = np.max([np.abs(x[lo : lo + step] @ v.T).max(0) for lo in range(0, len(x), step)], axis=0)
                yield pa.RecordBatch.from_arrays([ids, pa.array([batch.column("source")[k].as_py()] * len(ids), pa.string()), pa.array(peak)], ["query_id", "source", "value"])

    named = gradients.select("source_id", F.col("vec").cast("array<double>").alias("vec"))
    grams = vector_sums(named.mapInArrow(partial, "source string, g array<double>"), ["source"], "g")
    q, size = few_blocks(queries)
    ready = stored(paired(grams.select("source", "total"), q, size).mapInArrow(solve, "source string, query_id array<long>, v array<double>"), "by-source")
    met = named.mapInArrow(rows, "source string, x array<double>").join(ready, "source")
    return met.mapInArrow(peaks, "query_id long, source string, value double").groupBy("query_id", "source").agg(F.max("value").alias("value"))


def precision_at_1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(micro, macro, size_bias): accuracy over queries, mean over true sources, and the correlation of a source's
    accuracy with its number of queries (0 where undefined)."""
    both = truth.select("query_id", F.col("source").alias("true")).join(predicted, "query_id")
    hit = F.when(F.col("true") == F.col("source"), 1.0).otherwise(0.0)
    per = both.groupBy("true").agg(F.avg(hit).alias("p1"), F.count("*").alias("n"), F.sum(hit).alias("hits"))
    bias = F.coalesce(correlation("n", "p1"), F.lit(0.0))
    return per.agg((F.sum("hits") / F.sum("n")).alias("micro"), F.avg("p1").alias("macro"), bias.alias("size_bias"))


def per_segment(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    both = truth.select("query_id", F.col("source").alias("segment")).join(predicted, "query_id")
    return both.groupBy("segment").agg(F.count("*").alias("n"), F.avg(F.when(F.col("segment") == F.col("source"), 1.0).otherwise(0.0)).alias("p1"))
