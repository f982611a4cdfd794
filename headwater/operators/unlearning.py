"""Forget sets, gradient-level correction and its verification.

The correction works on gradients, never on a model. Each step takes c from all target rows and shrinks c by
``decay``, so n steps take a geometric series: one expression, no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.numbering import quantile
from ..functions.vector_sums import vector_means, vector_sums


def forget_by_source(gradients: DataFrame, source_id: str) -> DataFrame:
    return gradients.filter(F.col("source_id") == source_id)


def forget_top(gradients: DataFrame, dim: int, k: int) -> DataFrame:
    """The k samples with the largest magnitude of inner product with the sum of all gradients."""
    total = vector_sums(gradients, [], "vec").select(F.col("total").alias("_t"))
    scored = gradients.join(F.broadcast(total)).withColumn("score", F.abs(V.dot(F.col("vec"), F.col("_t")))).drop("_t")
    return scored.orderBy(F.round("score", 9).desc(), "sample_index").limit(k)


def corrected(gradients: DataFrame, source_id: str, dim: int, steps: int = 100, rate: float = 1e-4, decay: float = 0.95) -> DataFrame:
    """The gradient table with the target's rows moved by ``steps`` shrinking steps along their mean."""
    mean = vector_means(forget_by_source(gradients, source_id), [], "vec").select(F.col("mean").alias("_mean"))
    moved = rate * (1.0 - decay**steps) / (1.0 - decay)
    joined = gradients.join(F.broadcast(mean), how="left")  # one row, none without targets
    new = V.add(F.col("vec"), V.scale(F.col("_mean"), F.lit(-moved)))
    return joined.withColumn("vec", F.when(F.col("source_id") == source_id, new).otherwise(F.col("vec"))).drop("_mean")


def unlearn(gradients: DataFrame, source_id: str, dim: int, steps: int = 100, rate: float = 1e-4, threshold: float = 0.05) -> DataFrame:
    """One audit row: mean normalised magnitude of the target's influence before and after, and the verdict.

    The query is the target's mean gradient. Without targets nothing remains to forget: verified, no steps.
    """
    query = vector_means(forget_by_source(gradients, source_id), [], "vec").select(F.col("mean").alias("_q"))

    def influence(df: DataFrame, name: str) -> DataFrame:
        s = df.join(F.broadcast(query)).select("source_id", V.dot(F.col("vec"), F.col("_q")).alias("s"))
        peak = F.max(F.abs("s"))
        mean = F.avg(F.when(F.col("source_id") == source_id, F.abs("s")))
        return s.agg(F.when(peak > 1e-10, mean / peak).otherwise(mean).alias(name))

    n = forget_by_source(gradients, source_id).agg(F.count("*").alias("n_targets"))
    out = n.join(influence(gradients, "before")).join(influence(corrected(gradients, source_id, dim, steps, rate), "after"))
    none = F.col("n_targets") == 0
    return out.select(
        F.lit(source_id).alias("source_id"), "n_targets", F.coalesce("before", F.lit(0.0)).alias("influence_before"), F.coalesce("after", F.lit(0.0)).alias("influence_after"),
        F.when(none, 0).otherwise(steps).alias("n_steps"), F.when(none, True).otherwise(F.col("after") < threshold).alias("verified"),
    )


def audit_json(result: DataFrame, article: str = "17", disclaimer: str = "Gradient-level correction; not a proof of deletion from a trained model.") -> DataFrame:
    return result.select(F.to_json(F.struct(F.lit(article).alias("article"), *result.columns, F.lit(disclaimer).alias("disclaimer"))).alias("report"))


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    return -F.avg(y * F.log(p + eps) + (1 - y) * F.log(1 - p + eps))


def gap_closed(loss: Column, original: Column, gold: Column) -> Column:
    return 100.0 * (loss - original) / (gold - original + 1e-12)


def threshold_attack_quality(losses: DataFrame) -> DataFrame:
    """1 - share of forgotten rows (group 'forget') whose loss is below the median training loss ('train')."""
    mid = quantile(losses.filter("grp = 'train'"), "loss", 0.5)
    hit = F.avg(F.when(F.col("loss") < F.lit(mid), 1.0).otherwise(0.0))
    return losses.filter("grp = 'forget'").agg(F.count("*").alias("n_forget"), (1.0 - hit).alias("quality"))


def retain(gradients: DataFrame, forget: DataFrame) -> DataFrame:
    return gradients.join(forget.select("sample_index").distinct(), "sample_index", "left_anti")


def ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "sample_index")))


def shadow_attack(rows: DataFrame) -> DataFrame:
    """(n, quality): a classifier of members (member = 1) from loss and margin; 1 is chance, 0 a sure attack.

    ``rows`` has (sample_index, loss, margin, member); it is fitted on even samples and judged on odd ones.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=["loss", "margin"], outputCol="features").transform(rows.withColumn("label", F.col("member").cast("double")))
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(made.filter("sample_index % 2 = 0"))
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * (1.0 - hit)))
    return model.transform(made.filter("sample_index % 2 = 1")).agg(F.count("*").alias("n"), quality.alias("quality"))
