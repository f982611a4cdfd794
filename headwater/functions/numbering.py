"""Consecutive numbers in the order of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import stored


def numbered(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name``: start, start + 1, ... in the given order, however the rows were partitioned.

    Rows are range partitioned, sorted and written with their place in the partition; a running sum over one count
    for each partition gives the rest. Rows that are equal in ``order`` should be equal altogether.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = stored(parts.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return parts.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_place") + start).drop("_part", "_place", "_before")


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    """The exact quantile of a column's values, linear between neighbours; null without values. Values are ranked over
    range partitions: no buffer holds them all."""
    ranked = numbered(df.select(F.col(column).cast("double").alias("_v")).filter("_v is not null"), ["_v"], "_i")
    n = ranked.count()
    at = (n - 1) * p
    ends = ranked.filter(F.col("_i").isin(math.floor(at), math.ceil(at))).agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    return ends.low + (ends.high - ends.low) * (at - math.floor(at)) if n else None
