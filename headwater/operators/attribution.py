"""Projection, influence scores and rankings over gradient tables (see model.GRADIENTS).

Queries stay a table. They and the gradients are packed into blocks, which meet by a broadcast of checked size or in a shuffle, and tasks
multiply matrices (``blocks``). Gram matrices and their factors are tables of blocks as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.vector_sums import as_lists, as_matrix, vector_means
from ..scratch import stored
from . import blocks as B
from .blocks import block_scores

TINY = 1e-10


def projection(spark, input_dim: int, proj_dim: int, seed: int = 42) -> DataFrame:
    """(i, row): the rows of a sparse sign projection scaled by sqrt(3 / proj_dim)."""
    unit = math.sqrt(3.0 / proj_dim)
    row = F.transform(F.sequence(F.lit(0), F.lit(input_dim - 1)), lambda j: V.coin(F.col("id"), j.cast("long"), seed) * F.lit(unit))
    return spark.range(proj_dim).select(F.col("id").alias("i"), row.alias("row"))


def projection_matrix(input_dim: int, proj_dim: int, seed: int = 42) -> np.ndarray:
    """The same matrix as an array for the tasks that multiply blocks; its size is fixed by the dimensions."""
    i, j = np.arange(proj_dim, dtype=np.int64)[:, None], np.arange(input_dim, dtype=np.int64)[None, :]
    mixed = ((i * 7919 + 13) * (j * 104729 + 17) + seed * 31337 + i * j * 31) % 1000003 % 6
    return np.where(mixed == 0, -1.0, np.where(mixed == 5, 1.0, 0.0)) * math.sqrt(3.0 / proj_dim)


def project(df: DataFrame, proj_dim: int, input_dim: int, seed: int = 42, column: str = "vec") -> DataFrame:
    """Replace ``column`` by its projection: one matrix product for each Arrow batch. Wrong widths raise."""
    matrix = projection_matrix(input_dim, proj_dim, seed)

    @F.arrow_udf("array<double>")
    def times(v: pa.Array) -> pa.Array:
        return as_lists(as_matrix(v, input_dim) @ matrix.T)

    return df.withColumn(column, times(F.col(column)))


def dot_scores(gradients: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, sample_index, source_id, score) for every query (query_id, vec) of a stated set against all samples."""
    return block_scores(gradients, queries)


def label_aware_scores(gradients: DataFrame, queries: DataFrame, own: DataFrame) -> DataFrame:
    """``dot_scores`` of which those with samples of another source than the query's, ``own`` (query_id, source_id), change sign. The queries carry their
    source into the product: no score is joined with it."""
    return block_scores(gradients, queries.join(own.select("query_id", F.col("source_id").alias("_own")), "query_id"), alike="_own")


def scores_unprojected(gradients: DataFrame, queries: DataFrame, proj_dim: int, input_dim: int, seed: int = 42) -> DataFrame:
    """``dot_scores`` of projected gradients with queries in the projected space, without a projected table: (P g) q = g (P' q), so the
    queries are pulled back once and the gradients are read as they are."""
    matrix = projection_matrix(input_dim, proj_dim, seed)

    @F.arrow_udf("array<double>")
    def back(v: pa.Array) -> pa.Array:
        return as_lists(as_matrix(v, proj_dim) @ matrix)

    return block_scores(gradients, queries.withColumn("vec", back(F.col("vec").cast("array<double>"))))


def normalised(scores: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Divide a query's scores by their largest magnitude unless that is tiny.

    The maximum is aggregated and joined back: no window gathers all samples of a query in one task.
    """
    peak = scores.groupBy(*by).agg(F.max(F.abs("score")).alias("_peak"))
    joined = scores.join(peak, list(by))
    return joined.withColumn("score", F.when(F.col("_peak") > TINY, F.col("score") / F.col("_peak")).otherwise(F.col("score"))).drop("_peak")


def normalised_scores(gradients: DataFrame, queries: DataFrame) -> DataFrame:
    """``normalised(dot_scores(...))`` without moving a score: peaks are taken inside tasks, and the queries carry them into a second product."""
    return block_scores(gradients, _with_unit(gradients, queries), unit="_unit")


def _with_unit(gradients: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries with ``_unit``, what ``normalised`` divides their scores by."""
    peak = stored(B.block_peaks(gradients, queries), "peaks")
    unit = F.when(F.col("peak") > TINY, F.col("peak")).otherwise(1.0)
    return queries.select("query_id", "vec").join(peak.select("query_id", unit.alias("_unit")), "query_id")


def gram_factor(gradients: DataFrame, dim: int, factor: float = 1e-3, floor: float = 0.0) -> DataFrame:
    """Blocks (i, j, m) of the Cholesky factor of G + lambda I, G the inner products of columns and lambda = factor * trace / dim, at
    least ``floor``. It stays in the executors."""
    return B.factor(B.gram_blocks(gradients, dim), dim, factor, floor)


def trak_scores(gradients: DataFrame, queries: DataFrame, dim: int, factor: float = 1e-3, floor: float = 0.0, lower: DataFrame | None = None) -> DataFrame:
    """Inverse-Gram influence of every sample on every query of a stated set; ``lower`` reuses a ``gram_factor``."""
    return block_scores(gradients, trak_queries(gradients, queries, dim, factor, floor, lower))


def trak_queries(gradients: DataFrame, queries: DataFrame, dim: int, factor: float = 1e-3, floor: float = 0.0, lower: DataFrame | None = None) -> DataFrame:
    """Queries (query_id, vec) times the inverse Gram matrix: their inner products are the scores of ``trak_scores``."""
    lower = gram_factor(gradients, dim, factor, floor) if lower is None else lower
    return stored(B.solved(queries.select("query_id", "vec"), lower, dim), "preconditioned")


def multi_checkpoint(scores: list[DataFrame]) -> DataFrame:
    """Mean of the normalised scores of several checkpoints, by sample."""
    every = None
    for k, s in enumerate(scores):
        one = normalised(s).withColumn("checkpoint", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query_id", "sample_index", "source_id").agg(F.avg("score").alias("score"))


def multi_checkpoint_scores(gradients: DataFrame, columns: list[str], queries: list[DataFrame]) -> DataFrame:
    """``multi_checkpoint`` of checkpoints that one table holds as ``columns``, with the queries of each: no score is moved.

    The mean of inner products over repeated rows is that of their mean vectors, and the mean of normalised scores is one inner product of
    the checkpoints' vectors end to end with queries divided by their peaks. Vectors alone are added up.
    """
    asked = None
    for k, (c, q) in enumerate(zip(columns, queries, strict=True)):
        q = _with_unit(gradients.select("sample_index", F.col(c).alias("vec")), q)
        q = vector_means(q.select("query_id", V.scale(F.col("vec"), 1.0 / (F.col("_unit") * len(columns))).alias("vec")), ["query_id"], "vec").select("query_id", F.col("mean").alias(f"_{k}"))
        asked = q if asked is None else asked.join(q, "query_id")
    asked = stored(asked.select("query_id", F.concat(*(f"_{k}" for k in range(len(columns)))).alias("vec")), "checkpoints")
    ends = gradients.select("sample_index", "source_id", F.concat(*columns).alias("vec"))
    return block_scores(vector_means(ends, ["sample_index", "source_id"], "vec").withColumnRenamed("mean", "vec"), asked)


def top_scores(gradients: DataFrame, queries: DataFrame, k: int, most_harmful: bool = False, normal: bool = False) -> DataFrame:
    """``top_k`` of all scores, ranked from what each task leaves of its products. ``normal`` divides the scores by their peak, after which ties are
    those of the quotients."""
    order = "largest" if most_harmful else "least"
    if normal:  # the queries are divided, not the scores: what is ranked is what the tasks compared
        asked = _with_unit(gradients, queries)
        queries = stored(asked.select("query_id", V.scale(F.col("vec"), 1.0 / F.col("_unit")).alias("vec")), "queries")
    return top_k(B.block_top(gradients, queries, k, order), k, most_harmful)


def top_k(scores: DataFrame, k: int, most_harmful: bool = False) -> DataFrame:
    """The first k samples of each query with their rank: the most negative scores, or with ``most_harmful`` the
    largest; ties by sample. Spark limits each partition's groups before the shuffle (WindowGroupLimit)."""
    s = F.round("score", 9)
    order = Window.partitionBy("query_id").orderBy(s.desc() if most_harmful else s.asc(), "sample_index")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def self_influence(gradients: DataFrame) -> DataFrame:
    return gradients.select("sample_index", "source_id", V.dot(F.col("vec"), F.col("vec")).alias("score"))


def self_influence_trak(gradients: DataFrame, dim: int, factor: float = 1e-3) -> DataFrame:
    """g' (G + lambda I)^-1 g of each sample: the squared norm of g after half of the substitution."""
    half = B.solved(gradients, gram_factor(gradients, dim, factor), dim, back=False, names=("sample_index", "source_id"))
    return self_influence(half)


def cosine_scores(gradients: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of every sample and query; norms under 1e-9 count as that."""
    unit = lambda c: V.scale(F.col(c), 1.0 / F.greatest(V.norm(F.col(c)), F.lit(1e-9)))
    return dot_scores(gradients.withColumn("vec", unit("vec")), queries.withColumn("vec", unit("vec")))


def source_key(source: Column, root: Column | None = None) -> Column:
    """The root file of a sample, else its source id, else 'unknown'."""
    own = F.when(source != "", source)
    return F.coalesce(root, own, F.lit("unknown")) if root is not None else F.coalesce(own, F.lit("unknown"))


def source_stratified(scores: DataFrame) -> DataFrame:
    """(query_id, source, n, total, mean, std, norm_mean, norm_total, rank): raw scores by source.

    Mean and total are divided by the largest mean magnitude of the query; sources rank by it, ties by name. All is
    partial aggregation; the window runs over one row for each query and source.
    """
    per = scores.groupBy("query_id", source_key(F.col("source_id")).alias("source")).agg(
        F.count("*").alias("n"), F.sum("score").alias("total"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )
    peak = F.max(F.abs("mean")).over(Window.partitionBy("query_id"))
    per = per.withColumn("_p", peak)
    unit = lambda c: F.when(F.col("_p") > TINY, F.col(c) / F.col("_p")).otherwise(F.col(c))
    order = Window.partitionBy("query_id").orderBy(F.round(F.abs("mean"), 9).desc(), "source")
    return per.withColumns({"norm_mean": unit("mean"), "norm_total": unit("total"), "rank": F.row_number().over(order)}).drop("_p")


def source_means(gradients: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, source, n, mean): the mean score of each source on every query.

    A mean of inner products is the inner product with the mean: vectors are added by source, and the queries meet one
    vector for each source instead of all samples.
    """
    named = gradients.select(source_key(F.col("source_id")).alias("source"), "vec")
    means = vector_means(named, ["source"], "vec").withColumnRenamed("mean", "vec")
    return block_scores(means, queries, ("n", "source")).withColumnRenamed("score", "mean")
