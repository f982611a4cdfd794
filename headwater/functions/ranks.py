"""Ranks, quantiles and rank correlations of groups of any size.

Equal values are counted first; the counts are dealt to ranges of (group, value), added up inside each range and moved by the sums of the ranges
before it. No group meets in one task, and a value that a third of all rows share is one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored


def running_total(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of a whole-number column over the rows up to each in the given order. Rows should differ in ``order``."""
    at = df.columns.index(amount)

    def run(batches):
        total = 0
        for batch in batches:
            sums = total + np.cumsum(batch.column(at).to_numpy())
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "_local"])

    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _local long"
    parts = stored(sorted_.mapInArrow(run, schema).withColumn("_part", F.spark_partition_id()), "running")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.groupBy("_part").agg(F.max("_local").alias("_n"))  # a row for each range
    offsets = ends.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(offsets, "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def _same(a: DataFrame, b: DataFrame, names: list[str]):
    """``a`` joined with ``b`` on columns that may be null; ``b``'s are dropped."""
    b = b.withColumnsRenamed({n: f"_j_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_j_{n}")) for n in names]
    return (a.join(b, on) if on else a.join(F.broadcast(b))).drop(*(f"_j_{n}" for n in names))  # no names: b is one row


def placed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, _n, _below, _all): how often each value occurs in its group, how many rows are below it, and how many there are."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = running_total(counts, [*by, value], "_n", "_upto")
    group = upto.groupBy(*by).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_all"))
    return _same(upto, group, by).select(*by, value, "_n", (F.col("_upto") - F.col("_n") - F.col("_start")).alias("_below"), "_all")


def with_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``df`` with average ranks from 1; nulls rank first, as one value."""
    rank = placed(df, value, by).select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    return _same(df, rank, [*by, value])


def quantiles(df: DataFrame, value: str, p: float, by: list[str], name: str = "quantile") -> DataFrame:
    """(by, name): the exact quantile of each group's values, linear between neighbours; groups of nulls alone are left out, and no ``by``
    gives one row."""
    at = placed(df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), "_v", by)
    place = (F.col("_all") - 1) * F.lit(float(p))
    holds = lambda i: (F.col("_below") <= i) & (i < F.col("_below") + F.col("_n"))
    low, high = F.floor(place), F.ceil(place)
    ends = at.filter(holds(low) | holds(high)).groupBy(*by).agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"), F.max(place - low).alias("_w"))
    return ends.select(*by, (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_w")).alias(name))


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Pairs of a larger value before a smaller one, each as often as its weights say: by merging ever larger halves."""
    n, total, half = len(y), 0, 1
    place = np.arange(n)
    while half < n:
        pair, right = place // (2 * half), (place // half) % 2
        order = np.lexsort((right, y, pair))
        left = np.where(right[order] == 0, weight[order], 0)
        upto = np.cumsum(left)  # left ones that are no larger stand before a right one
        ends = np.flatnonzero(np.diff(pair[order], append=-1))
        of_pair = upto[ends]
        larger = of_pair[pair[order]] - upto  # left ones of the pair that are larger
        total += int((larger * weight[order])[right[order] == 1].sum())
        half *= 2
    return total


def kendall(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, tau): tau-b of each group in n log n; null where a side is constant.

    Rows in order of (x, y) are cut into blocks, and in order of y into bins. A discordant pair has a larger y before a smaller one: both in one block (counted
    there), in two blocks and one bin (counted in the bin), or in two of each (told by how many rows each block has in each bin).
    """
    group = "_g"
    code = F.xxhash64(*by) if by else F.lit(0).cast("long")
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, code.alias(group), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    counts = rows.groupBy(*by, group, "_x", "_y").agg(F.count("*").alias("_w"))
    blocks = counts.repartitionByRange(*by, "_x", "_y").sortWithinPartitions(*by, "_x", "_y").withColumn("_block", F.spark_partition_id())
    blocks = stored(blocks, "kendall")
    bins = blocks.groupBy(*by, group, "_block", "_y").agg(F.sum("_w").alias("_w")).repartitionByRange(*by, "_y").withColumn("_bin", F.spark_partition_id())
    bins = stored(bins, "kendall")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([pdf.columns[1], "_y"] if pdf.columns[1] == "_block" else ["_x", "_y"], kind="stable")
        return pd.DataFrame({group: [pdf[group].iloc[0]], "d": [str(inversions(pdf._y.to_numpy(), pdf._w.to_numpy()))]})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="_block", columns="_bin", values="n", aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1).to_numpy().astype(object)
        earlier = np.cumsum(grid, axis=0) - grid  # of each bin in the blocks before
        higher = np.cumsum(earlier[:, ::-1], axis=1)[:, ::-1] - earlier  # in the bins above
        return pd.DataFrame({group: [pdf[group].iloc[0]], "d": [str((grid * higher).sum())]})

    schema = f"{group} long, d string"
    one = blocks.select(group, "_x", "_y", "_w", "_block").groupBy(group, "_block").applyInPandas(inside, schema)
    two = bins.select(group, "_block", "_y", "_w", "_bin").groupBy(group, "_bin").applyInPandas(inside, schema)
    far = bins.groupBy(group, "_block", "_bin").agg(F.sum("_w").alias("n")).groupBy(group).applyInPandas(between, schema)  # blocks x bins, whatever the rows
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    discordant = one.unionByName(two).unionByName(far).groupBy(group).agg(wide("d").alias("_d"))

    def tied(*columns: str) -> DataFrame:
        n = F.col("_n").cast("decimal(38,0)")
        per = counts.groupBy(group, *columns).agg(F.sum("_w").alias("_n"))
        return per.groupBy(group).agg(F.sum(F.expr("cast(_n as decimal(38,0)) * (_n - 1) div 2").cast("decimal(38,0)")).alias("_t_" + "".join(columns)), F.sum(n).alias("_all_" + "".join(columns)))

    every = counts.select(*by, group).distinct().join(tied("_x"), group).join(tied("_y"), group).join(tied("_x", "_y"), group).join(discordant, group)
    n = F.col("_all__x").cast("double")
    pairs = n * (n - 1) / 2
    f = lambda c: F.col(c).cast("double")
    s = pairs - f("_t__x") - f("_t__y") + f("_t__x_y") - 2 * f("_d")
    nx, ny = pairs - f("_t__x"), pairs - f("_t__y")
    return every.select(*by, F.when(nx * ny > 0, s / F.sqrt(nx * ny)).alias("tau"))
