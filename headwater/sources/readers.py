"""Reading tables with their origin."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import quantiles


def with_origin(df: DataFrame, source_id: str | None = None) -> DataFrame:
    """Add source_id (the file's path unless given) and row_id."""
    source = F.lit(source_id) if source_id is not None else F.col("_metadata.file_path")
    return df.select("*", source.alias("source_id"), F.monotonically_increasing_id().alias("row_id"))


def from_csv(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", header: bool = True, source_id: str | None = None) -> DataFrame:
    """A numeric CSV: every cell is a double and any other cell fails the read."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    return with_origin(spark.read.csv(path, schema=schema, sep=delimiter, header=header, mode="FAILFAST"), source_id)


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, source_id: str | None = None) -> DataFrame:
    df = spark.createDataFrame(pdf)
    return df.select("*", F.lit(source_id).alias("source_id"), F.monotonically_increasing_id().alias("row_id"))


def from_array(spark: SparkSession, rows, source_id: str | None = None) -> DataFrame:
    """(row_id, vec, source_id) of a local array's rows; also takes what has a ``numpy`` method."""
    if hasattr(rows, "detach"):
        rows = rows.detach().cpu()
    data = rows.numpy() if hasattr(rows, "numpy") else rows
    made = [(i, [float(x) for x in (r if hasattr(r, "__len__") else [r])]) for i, r in enumerate(data)]
    return spark.createDataFrame(made, "row_id long, vec array<double>").withColumn("source_id", F.lit(source_id))


def from_gradient_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A stored gradient table and the projection's settings that were stored beside it."""
    setting = spark.read.text(f"{path}/projection").first()
    return spark.read.parquet(f"{path}/gradients"), json.loads(setting.value) if setting else {}


def json_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows parsed from the JSON objects that stand on lines of a text log."""
    lines = spark.read.text(path)
    found = lines.select(F.from_json(F.regexp_extract("value", r"(\{.*\})", 1), schema).alias("j")).filter("j is not null")
    return found.select("j.*")


OVERLAPS = ("shared", "disjoint_imputed", "disjoint_zero")
RULES = ("linear", "interaction", "nonlinear")


def _normal(key: Column, seed: int, column: int) -> Column:
    """A standard normal number by key: the same for a row however the rows are partitioned."""
    unit = lambda salt: (F.xxhash64(F.lit(seed), F.lit(column), F.lit(salt), key).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.log(unit(0))) * F.cos(2.0 * math.pi * unit(1))


def synthetic_sources(spark: SparkSession, segments: dict[str, int], dim: int, seed: int = 0, noise: float = 0.1, owned: int = 2, overlap: str = "shared", rule: str = "linear") -> DataFrame:
    """(row_id, source_id, vec, label) of several sources, each of which owns ``owned`` neighbouring columns.

    Owned columns are normal around 0.4. ``overlap`` says what a source's rows have elsewhere: normal columns like all others ('shared'), small noise in place of
    structural zeros ('disjoint_imputed'), or zeros ('disjoint_zero'). The score of a row is made of the first two owned columns, their sum ('linear'),
    product ('interaction') or tanh of one times sine of the other ('nonlinear'), plus noise; the label is whether it is
    above its source's median, which is exact and taken for all sources at once.
    """
    if overlap not in OVERLAPS or rule not in RULES:
        raise ValueError(f"overlap is one of {OVERLAPS}, rule one of {RULES}")
    if owned < 2 or len(segments) * owned > dim:
        raise ValueError("each source needs two columns of its own")
    out, at = None, 0
    for k, (name, n) in enumerate(segments.items()):
        mine = range(k * owned, (k + 1) * owned)
        elsewhere = {"shared": 1.0, "disjoint_imputed": 0.3, "disjoint_zero": 0.0}[overlap]
        cell = lambda j, mine=mine: _normal(F.col("id"), seed, j) + 0.4 if j in mine else _normal(F.col("id"), seed, j) * elsewhere if elsewhere else F.lit(0.0)
        rows = spark.range(at, at + n).select(F.col("id").alias("row_id"), F.lit(name).alias("source_id"), F.array(*(cell(j) for j in range(dim))).alias("vec"))
        a, b = F.col("vec")[mine[0]], F.col("vec")[mine[1]]
        score = {"linear": a + b, "interaction": a * b, "nonlinear": F.tanh(a) * F.sin(b)}[rule]
        rows = rows.withColumn("_score", score + noise * _normal(F.col("row_id"), seed, -1))
        out, at = rows if out is None else out.unionByName(rows), at + n
    middle = quantiles(out, "_score", 0.5, ["source_id"], "_middle")
    return out.join(F.broadcast(middle), "source_id").select("row_id", "source_id", "vec", (F.col("_score") > F.col("_middle")).cast("int").alias("label"))  # a row for each segment
