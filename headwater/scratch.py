"""Tables written between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder stands in on a local master, elsewhere an unset one is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="headwater-"))
        base = _own[0]
    return base.rstrip("/")


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows written and read again, and where: a lost executor re-reads, plans stay short."""
    path = f"{folder(df.sparkSession)}/headwater/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return stored_at(df, label)[0]


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
