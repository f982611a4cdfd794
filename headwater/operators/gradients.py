"""Gradient tables: logging, batch means, per-sample gradients of simple models, and store access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model
from ..functions import vectors as V
from ..functions.numbering import numbered
from ..functions.vector_sums import as_lists, as_matrix, vector_means, vector_sums
from ..scratch import stored
from .attribution import project


def log_batch(df: DataFrame, vec: Column, sample_index: Column | None, source_id: Column, node: Column | None = None, loss: Column | None = None, start: int = 0, first_sample: int = 0) -> DataFrame:
    """Rows of a gradient table from any DataFrame; entries are never overwritten, so repeats stay.

    Entries are numbered from ``start`` in the order of their content, whatever the partitions. Without a sample index
    they are samples of their own, numbered from ``first_sample``.
    """
    null = F.lit(None)
    rows = df.select(
        (null if sample_index is None else sample_index).cast("long").alias("sample_index"), source_id.cast("string").alias("source_id"),
        (null if node is None else node).cast("long").alias("source_node_id"), (F.lit(0.0) if loss is None else loss).cast("double").alias("loss"), V.as_double(vec).alias("vec"),
    )
    out = numbered(rows, ["sample_index", "source_id", "source_node_id", "loss", "vec"], "entry_seq", start)
    own = F.col("entry_seq") - start + first_sample if sample_index is None else F.col("sample_index")
    return out.select("entry_seq", own.alias("sample_index"), "source_id", "source_node_id", "loss", "vec")


class TrainingContext:
    """Logs the gradients of one source into a table under a path, projected on the way in if ``input_dim`` is given.

    Entries, and samples where none is given, are numbered on after those that the table holds. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, source_id: str, dim: int, input_dim: int | None = None, seed: int = 42):
        self.spark, self.path, self.source_id = spark, path, source_id
        self.dim, self.input_dim, self.seed = dim, input_dim, seed
        path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._next = (0, 0)
        if path_.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path_):
            top = self.gradients().agg(F.max("entry_seq"), F.max("sample_index")).first()
            self._next = tuple(0 if x is None else x + 1 for x in top)

    def log(self, df: DataFrame, vec: Column, sample_index: Column | None = None, node: Column | None = None, loss: Column | None = None) -> None:
        rows = log_batch(df, vec, sample_index, F.lit(self.source_id), node, loss, *self._next)
        if self.input_dim is not None:
            rows = project(rows, self.dim, self.input_dim, self.seed)
        rows = append_checked(rows.limit(0), rows, self.dim)
        rows.write.mode("append").parquet(self.path)
        top = self.gradients().agg(F.max("entry_seq"), F.max("sample_index")).first()
        self._next = tuple(0 if x is None else x + 1 for x in top)

    def gradients(self) -> DataFrame:
        return self.spark.read.schema(model.GRADIENTS).parquet(self.path)

    def activate(self, name: str = "active_gradients") -> None:
        """Make the table the session's active one; the last context wins. ``active`` reads it."""
        self.gradients().createOrReplaceTempView(name)


def active(spark: SparkSession, name: str = "active_gradients") -> DataFrame:
    return spark.table(name)


def append_checked(gradients: DataFrame, more: DataFrame, dim: int) -> DataFrame:
    """Union of already projected rows; another width fails the job."""
    fits = F.assert_true(F.size("vec") == dim, F.lit(f"projected vectors must have {dim} elements"))
    return gradients.unionByName(more.filter(fits.isNull()))


def ordered(gradients: DataFrame) -> DataFrame:
    return gradients.orderBy("sample_index", "entry_seq")


def entry(gradients: DataFrame, sample_index: int) -> DataFrame:
    return gradients.filter(F.col("sample_index") == sample_index).orderBy("entry_seq").limit(1)


def stats(gradients: DataFrame) -> DataFrame:
    return gradients.agg(F.count("*").alias("n_entries"), F.countDistinct("source_id").alias("n_sources"), F.avg("loss").alias("mean_loss"))


def batch_means(gradients: DataFrame, batch: Column, dim: int) -> DataFrame:
    """(batch, sample_index, n, vec): one mean gradient for each batch, under its first sample."""
    means = vector_means(gradients.withColumn("batch", batch), ["batch"], "vec", "sample_index")
    return means.select("batch", F.col("least").alias("sample_index"), "n", F.col("mean").alias("vec"))


def trajectory_sum(gradients: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Sum over steps for each of ``samples`` (sample_index); a sample that was never logged has zeros."""
    sums = vector_sums(gradients, ["sample_index"], "vec").select("sample_index", F.col("total").alias("vec"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return samples.select("sample_index").join(sums, "sample_index", "left").withColumn("vec", F.coalesce("vec", zeros))


def logistic_gradient(x: Column, y: Column, w: list[float], bias: float = 0.0) -> Column:
    """(sigmoid(w x + b) - y) x with the margin held within 500."""
    z = V.dot(x, F.array(*map(F.lit, w))) + bias
    return V.scale(x, V.sigmoid(z) - y)


def margin(x: Column, y: Column, w: list[float], bias: float = 0.0) -> Column:
    return (V.dot(x, F.array(*map(F.lit, w))) + bias) * (2 * y - 1)


def gradient_descent(df: DataFrame, x: str, y: str, dim: int, steps: int, rate: float, w: list[float] | None = None, ascent: bool = False, key: str | None = None, batches: int = 1) -> list[float]:
    """Steps of logistic regression: each is one aggregation that sends ``dim`` numbers to the driver. With ``key`` and
    ``batches`` the steps take turns on the rows whose whole-number key leaves the same rest."""
    w = [0.0] * dim if w is None else list(w)
    for step in range(steps):
        rows = df if batches == 1 else df.filter(F.pmod(F.col(key), F.lit(batches)) == step % batches)
        g = vector_means(rows.select(logistic_gradient(F.col(x), F.col(y), w).alias("g")), [], "g").first()["mean"]
        w = [a + (rate if ascent else -rate) * b for a, b in zip(w, g, strict=True)]
    return w


def latest(gradients: DataFrame) -> DataFrame:
    """The last entry of each sample."""
    order = Window.partitionBy("sample_index").orderBy(F.desc("entry_seq"))
    return gradients.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def last_layer_gradient(hidden: Column, p: Column, y: Column) -> Column:
    """Gradient of a sigmoid output layer for one sample: error times hidden activations."""
    return V.scale(hidden, p - y)


def mlp_gradients(df: DataFrame, x: str, y: str, w1: list[list[float]], b1: list[float], w2: list[float], b2: float, name: str = "g") -> DataFrame:
    """``df`` with the gradient of each row's log loss under a network of one hidden layer (relu(x W1 + b1) w2 + b2, through a sigmoid): the cells of
    W1 by row, b1, w2 and b2 in one vector. One pass of matrix products for each Arrow batch."""
    first, shift, last = np.asarray(w1, float), np.asarray(b1, float), np.asarray(w2, float)

    @F.arrow_udf("array<double>")
    def gradient(v: pa.Array, t: pa.Array) -> pa.Array:
        rows = as_matrix(v, len(first))
        h = np.maximum(rows @ first + shift, 0.0)
        error = 1.0 / (1.0 + np.exp(-np.clip(h @ last + b2, -500.0, 500.0))) - t.to_numpy(zero_copy_only=False)
        down = error[:, None] * last * (h > 0)
        cells = (rows[:, :, None] * down[:, None, :]).reshape(len(rows), -1)
        return as_lists(np.hstack([cells, down, error[:, None] * h, error[:, None]]))

    return df.withColumn(name, gradient(F.col(x).cast("array<double>"), F.col(y).cast("double")))


def mlp_descent(df: DataFrame, x: str, y: str, weights: tuple, steps: int, rate: float) -> tuple:
    """Full-batch steps of that network; each sends one mean gradient to the driver. ``weights`` is (w1, b1, w2, b2)."""
    for _ in range(steps):
        w1, b1, w2, b2 = (np.asarray(w, float) for w in weights)
        g = np.array(vector_means(mlp_gradients(df, x, y, w1, b1, w2, float(b2), "_g"), [], "_g").first()["mean"])
        n, k = w1.shape
        cut = np.split(g, [n * k, n * k + k, n * k + 2 * k])
        weights = (w1 - rate * cut[0].reshape(n, k), b1 - rate * cut[1], w2 - rate * cut[2], float(b2 - rate * cut[3][0]))
    return weights


def hidden_layer(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """tanh(W x + b) with a small, fixed W."""
    rows = F.array(*(F.array(*map(F.lit, r)) for r in weights))
    b = F.array(*map(F.lit, bias))
    return F.zip_with(F.transform(rows, lambda r: V.dot(r, x)), b, lambda z, c: F.tanh(z + c))


def retrain_subsets(df: DataFrame, masks: DataFrame, dim: int, steps: int = 50, rate: float = 0.5) -> DataFrame:
    """(subset, weights): logistic regression on the samples of each subset by full-batch descent.

    ``masks`` is (subset, sample_index). The rows of each subset are joined once, in a shuffle, and written; all subsets step together,
    and each step reads them once: a task gives one sum for each subset that it meets, and the driver gets one for each subset.
    """
    rows = masks.select("subset", "sample_index").hint("merge").join(df.select("sample_index", "x", "y"), "sample_index")  # a broadcast would pass the driver
    rows = stored(rows.select("subset", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")), "subsets")
    weights = {r.subset: np.zeros(dim) for r in masks.select("subset").distinct().orderBy("subset").collect()}

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = as_matrix(batch.column("x"), dim), batch.column("y").to_numpy(zero_copy_only=False)
            names = batch.column("subset").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            for k, subset in enumerate(names.dictionary.to_pylist()):
                own = code == k
                error = 1.0 / (1.0 + np.exp(-np.clip(x[own] @ weights[subset], -500.0, 500.0))) - y[own]
                sums[subset] = sums.get(subset, 0.0) + np.append(error @ x[own], own.sum())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), as_lists(np.stack(list(sums.values())))], ["subset", "g"])

    for _ in range(steps):
        for r in vector_sums(rows.mapInArrow(partial, "subset long, g array<double>"), ["subset"], "g").collect():
            weights[r.subset] = weights[r.subset] - rate * np.array(r.total[:dim]) / r.total[dim]
    return df.sparkSession.createDataFrame([(s, w.tolist()) for s, w in weights.items()], "subset long, weights array<double>")
