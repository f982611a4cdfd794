"""Lineage and gradient stores on Parquet (or any JDBC database), and exports.

A store is append-only files: an upsert appends, and readers take the last row of each id, so nothing is rewritten
and concurrent readers never see half a change. ``compact`` writes the current rows into a new folder.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .. import model


def current(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """The last version of each id; of several that one save brought, the last by its content."""
    order = Window.partitionBy("id").orderBy(F.desc(seq), F.to_json(F.struct(*(c for c in versions.columns if c != seq))).desc())
    return versions.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k", seq)


def insert_if_absent(existing: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` whose id is new, of several the first by order of their content."""
    fresh = more.join(existing.select("id"), "id", "left_anti")
    row = F.struct(*fresh.columns)
    return fresh.groupBy("id").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")


def query_by_source(edges: DataFrame, source_id: str) -> DataFrame:
    """Edges that carry exactly this source."""
    return edges.filter(F.array_contains("source_ids", source_id))


def query_by_source_text(edges: DataFrame, part: str) -> DataFrame:
    """Edges whose serialised sources contain a text: 'a' also finds 'ab'."""
    return edges.filter(F.contains(F.to_json("source_ids"), F.lit(part)))


class LineageStore:
    """nodes and edges under a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, kind: str, df: DataFrame) -> None:
        seq = self._next(kind)
        df.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(f"{self.path}/{kind}")

    def _exists(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _next(self, kind: str) -> int:
        if not self._exists(kind):
            return 0
        return self.spark.read.parquet(f"{self.path}/{kind}").agg(F.max("seq")).first()[0] + 1

    def save_nodes(self, nodes: DataFrame) -> None:
        self._append("nodes", nodes)

    def save_edges(self, edges: DataFrame) -> None:
        self._append("edges", edges)

    def _read(self, kind: str, schema: str) -> DataFrame:
        if not self._exists(kind):
            return self.spark.createDataFrame([], schema)
        return current(self.spark.read.parquet(f"{self.path}/{kind}"))

    def nodes(self) -> DataFrame:
        return self._read("nodes", model.NODES)

    def edges(self) -> DataFrame:
        return self._read("edges", model.EDGES)

    def node(self, i: int) -> DataFrame:
        return self.nodes().filter(F.col("id") == i)

    def edge(self, i: int) -> DataFrame:
        return self.edges().filter(F.col("id") == i)

    def clear(self) -> None:
        for kind in ("nodes", "edges"):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def compact(self, path: str) -> LineageStore:
        other = LineageStore(self.spark, path)
        other.save_nodes(self.nodes())
        other.save_edges(self.edges())
        return other


def to_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **properties) -> None:
    """Write to a database; arrays and maps go as JSON text."""
    encoded(df).write.jdbc(url, table, mode, properties)


def _nested(kind) -> bool:
    return kind.typeName() in ("array", "map", "struct")


def decoded(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, arrays, maps and structs read back from JSON text. Text that is no JSON fails the job."""
    fields = StructType.fromDDL(schema).fields
    read = lambda f: F.from_json(f.name, f.dataType, {"mode": "FAILFAST"}) if _nested(f.dataType) else F.col(f.name).cast(f.dataType)
    return df.select(*(read(f).alias(f.name) for f in fields))


def encoded(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    return df.withColumns({f.name: F.to_json(f.name) for f in df.schema.fields if _nested(f.dataType)})


def from_jdbc(spark: SparkSession, url: str, table: str, schema: str, by: tuple[str, int, int, int] | None = None, **properties) -> DataFrame:
    """A table that ``to_jdbc`` wrote. ``by`` is (whole-number column, lowest, highest, partitions) for a parallel read."""
    split = dict(zip(("column", "lowerBound", "upperBound", "numPartitions"), by, strict=True)) if by else {}
    return decoded(spark.read.jdbc(url, table, properties=properties, **split), schema)


def save_gradients(gradients: DataFrame, path: str, input_dim: int, proj_dim: int, seed: int) -> None:
    """A gradient table with its projection's settings, so that a loaded store can project queries."""
    gradients.write.mode("overwrite").parquet(f"{path}/gradients")
    setting = json.dumps({"input_dim": input_dim, "proj_dim": proj_dim, "seed": seed})
    gradients.sparkSession.createDataFrame([(setting,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/projection")


def export_with_lineage(df: DataFrame, path: str, lineage: dict) -> None:
    """Data as Parquet and its lineage as JSON beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(json.dumps(lineage, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/lineage")


def read_lineage(spark: SparkSession, path: str) -> dict | None:
    row = spark.read.text(f"{path}/lineage").first()
    return json.loads(row.value) if row else None


def spans(edges: DataFrame, service: str) -> DataFrame:
    """Trace spans, one for each edge."""
    attributes = F.create_map(F.lit("edge_id"), F.col("id").cast("string"), F.lit("input_ids"), F.to_json("input_ids"), F.lit("output_id"), F.col("output_id").cast("string"))
    return edges.select(F.lit(service).alias("service"), F.col("op_name").alias("name"), F.col("ts_ns").alias("start_ns"), attributes.alias("attributes"))
