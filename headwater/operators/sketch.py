"""Factored gradient sketches of low-rank adapters, from tables of logged activations and output gradients.

Factors come as (sample_index, module, token, a, g): an activation and an output gradient for each token.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vector_sums import vector_sums
from ..scratch import stored
from .attribution import projection_matrix

BLOCK = r"(?:^|\.)(?:h|layers|blocks)\.(\d+)\."


def block_index(name: Column) -> Column:
    found = F.regexp_extract(name, BLOCK, 1)
    return F.when(found != "", found.cast("long"))


def select_modules(modules: DataFrame, patterns: list[str], last_n: int | None = None) -> DataFrame:
    """Names that contain a pattern, of the last n blocks; names without a block number stay."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains("name", F.lit(p))
    found = modules.filter(hit).withColumn("block", block_index(F.col("name")))
    if last_n is None:
        return found
    top = found.select(F.col("block").alias("_b")).filter("_b is not null").distinct().orderBy(F.desc("_b")).limit(last_n)
    return found.join(F.broadcast(top), F.col("block") == F.col("_b"), "left").filter("block is null or _b is not null").drop("_b")


def _outer(g: Column, a: Column) -> Column:
    return F.transform(g, lambda x: F.transform(a, lambda y: x * y))


def sample_gradients(factors: DataFrame) -> DataFrame:
    """(sample_index, module, o, i, value): the sum over tokens of g_o a_i, in coordinate form."""
    cells = factors.select("sample_index", "module", F.posexplode(_outer(F.col("g"), F.col("a"))).alias("o", "row"))
    cells = cells.select("sample_index", "module", "o", F.posexplode("row").alias("i", "x"))
    return cells.groupBy("sample_index", "module", "o", "i").agg(F.sum("x").alias("value"))


def project_factors(factors: DataFrame, dim_out: int, dim_in: int, k: int, seed: int = 0) -> DataFrame:
    """Both factors projected to min(dimension, k) before anything is multiplied out."""
    p, q = (projection_matrix(d, min(d, k), seed + s) for d, s in ((dim_out, 1), (dim_in, 2)))
    rows = lambda m: F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in m))
    times = lambda m, c: F.transform(rows(m), lambda r: V.dot(r, F.col(c)))
    return factors.withColumns({"g": times(p, "g"), "a": times(q, "a")})


def covariances(factors: DataFrame) -> DataFrame:
    """(module, side, i, j, value): sums over all tokens of g g' and a a'."""
    out = None
    for side in ("g", "a"):
        cells = factors.select("module", F.posexplode(_outer(F.col(side), F.col(side))).alias("i", "row")).select("module", "i", F.posexplode("row").alias("j", "x"))
        one = cells.groupBy("module", F.lit(side).alias("side"), "i", "j").agg(F.sum("x").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def inverse_root(m: np.ndarray, damping: float = 0.1) -> np.ndarray:
    """(M + lambda I)^(-1/2) with lambda = damping * trace / k."""
    m = (m + m.T) / 2
    w, v = np.linalg.eigh(m + damping * np.trace(m) / len(m) * np.eye(len(m)))
    return v @ np.diag(1.0 / np.sqrt(np.maximum(w, 1e-300))) @ v.T


def whiten(blocks: DataFrame, cov: DataFrame, damping: float = 0.1) -> DataFrame:
    """(sample_index, module, o, i, value) whitened on both sides. A covariance is k x k, k the width of one side of one module: a task takes
    its inverse root, and each sample's block meets its module's two roots in a join."""

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((max(pdf.i.max(), pdf.j.max()) + 1,) * 2)
        m[pdf.i, pdf.j] = pdf.value
        return pd.DataFrame({"module": [pdf.module.iloc[0]], "side": [pdf.side.iloc[0]], "root": [inverse_root(m, damping).ravel()]})

    roots = stored(cov.groupBy("module", "side").applyInPandas(root, "module string, side string, root array<double>"), "roots")
    of = lambda side: roots.filter(F.col("side") == side).select("module", F.col("root").alias(f"_{side}"))
    own = blocks.groupBy("sample_index", "module").agg(F.collect_list(F.struct("o", "i", "value")).alias("cells"))  # k x k cells
    met = own.join(of("g"), "module").join(of("a"), "module")

    @F.pandas_udf("array<struct<o:int,i:int,value:double>>")
    def both(cells: pd.Series, g: pd.Series, a: pd.Series) -> pd.Series:
        def one(own, left, right):
            left, right = (np.reshape(m, (round(len(m) ** 0.5), -1)) for m in (left, right))
            s = np.zeros((len(left), len(right)))
            for c in own:
                s[c["o"], c["i"]] = c["value"]
            w = left @ s @ right
            return [{"o": o, "i": i, "value": w[o, i]} for o, i in np.ndindex(w.shape)]

        return pd.Series([one(*x) for x in zip(cells, g, a, strict=True)])

    return met.select("sample_index", "module", F.inline(both("cells", "_g", "_a")))


def hook_counts(modules: DataFrame, factors: DataFrame) -> DataFrame:
    """(module, n): logged samples of each module; one that never fired has 0."""
    n = factors.groupBy("module").agg(F.countDistinct("sample_index").alias("n"))
    return modules.select(F.col("name").alias("module")).join(n, "module", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def bytes_by_module(factors: DataFrame, k: int, item: int = 4) -> DataFrame:
    """(module, n, dense_bytes, factored_bytes): what its samples' gradients take whole and with both sides at most k wide."""
    dims = factors.groupBy("module").agg(F.countDistinct("sample_index").alias("n"), F.max(F.size("g")).alias("o"), F.max(F.size("a")).alias("i"))
    small = F.least("o", F.lit(k)) * F.least("i", F.lit(k))
    return dims.select("module", "n", (F.col("o") * F.col("i") * item * F.col("n")).alias("dense_bytes"), (small * item * F.col("n")).alias("factored_bytes"))


def dense_sketch(factors: DataFrame, widths: dict[str, tuple[int, int]], k: int, seed: int = 0) -> DataFrame:
    """(sample_index, vec): the projection to k of each sample's whole gradient, its modules' blocks one after the other.

    ``widths`` gives (outputs, inputs) of each module in order; a module that isn't named raises. Cells are projected as
    they come and summed by sample and element, so neither a sample's gradient nor a buffer of sketches is ever held
    whole: partial sums are what a flush by a budget of bytes would write.
    """
    starts, at = {}, 0
    for name, (out, inn) in widths.items():
        starts[name] = (at, inn)
        at += out * inn
    cells = modules_checked(sample_gradients(factors), list(widths))
    place = F.coalesce(*(F.when(F.col("module") == name, F.lit(start) + F.col("o") * inn + F.col("i")) for name, (start, inn) in starts.items())).cast("long")
    cells = cells.select("sample_index", "value", place.alias("_j"))
    unit = (3.0 / k) ** 0.5
    parts = cells.select("sample_index", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda i: V.coin(i, F.col("_j"), seed) * F.col("value") * unit).alias("_v"))
    return vector_sums(parts, ["sample_index"], "_v").select("sample_index", F.col("total").alias("vec"))


def modules_checked(rows: DataFrame, modules: list[str]) -> DataFrame:
    """The rows; one of a module outside the stated set fails the job."""
    known = F.col("module").isin(*modules)
    return rows.filter(F.assert_true(known, F.concat(F.lit("unknown module "), F.coalesce("module", F.lit("null")))).isNull())


def project_by_shape(factors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``project_factors`` where modules differ in shape: those of equal shape go through one expression. The driver sees
    the distinct shapes, a handful in any model."""
    shapes = sorted(tuple(r) for r in factors.select(F.size("g"), F.size("a")).distinct().collect())
    out = None
    for o, i in shapes:
        one = project_factors(factors.filter((F.size("g") == o) & (F.size("a") == i)), o, i, k, seed)
        out = one if out is None else out.unionByName(one)
    return factors if out is None else out
