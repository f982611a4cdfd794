"""Physical design of stored tables: buckets, sort order, statistics, and what the planner makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str, statistics: bool = True) -> DataFrame:
    """Save ``df`` under a path as a table of the catalogue, dealt to buckets by ``key`` and sorted by it in each; one file a bucket, so that
    joins and groupings by the key need no exchange and sort what is sorted. With ``statistics`` the table is analysed, its columns' counts, bounds and sizes included."""
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").option("path", path).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    if statistics:
        df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return df.sparkSession.table(name)


def column_statistics(spark: SparkSession, name: str, column: str) -> dict[str, str]:
    """What the catalogue knows of a column: min, max, num_nulls, distinct_count, avg_col_len, max_col_len."""
    rows = spark.sql(f"DESCRIBE EXTENDED {name} {column}").collect()
    return {r.info_name: r.info_value for r in rows if r.info_name not in ("col_name", "data_type", "comment")}


def table_size(spark: SparkSession, name: str) -> tuple[int, int]:
    """(bytes, rows) by the table's statistics; 0 where it was not analysed."""
    said = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r.col_name == "Statistics"]
    numbers = [int(w) for w in (said[0] if said else "").replace(",", "").split() if w.isdigit()]
    return tuple((numbers + [0, 0])[:2])


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def rollup(scores: DataFrame, lineage: DataFrame, key: str, source: str, score: str, first: int = 10) -> DataFrame:
    """(source_file, total): scores added by the source of their lineage node, the largest first. A merge join, which takes the buckets of both tables as they
    are: the only rows that move are partial sums."""
    met = scores.filter(F.col(score).isNotNull()).hint("merge").join(lineage.filter(F.col(source).isNotNull()), key)
    total = met.groupBy(F.col(source).alias("source_file")).agg(F.round(F.sum(score), 6).alias("total"))
    return total.orderBy(F.desc("total"), "source_file").limit(first)
