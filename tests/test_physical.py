"""Bucketed, sorted and analysed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.plans import etl_queries
from headwater.session import table
from headwater.sources import physical

from .conftest import SMALL


def operators_below_aggregates(plan: str) -> list[str]:
    """The lines of a plan's tree under its lowest aggregate."""
    lines = plan.split("== Physical Plan ==")[1].strip().splitlines()
    last = max(i for i, line in enumerate(lines) if "HashAggregate" in line)
    return [line for line in lines[last + 1 :] if line.strip()]


def test_nothing_moves_below_the_sums(spark, tmp_path):
    scores = table(spark, SMALL, "labels").select("doc_id", (F.col("quality") * 1.0 - F.col("toxic") * 0.5).alias("score"))
    a = physical.save_bucketed(scores, "bucketed_scores", "doc_id", 4, f"{tmp_path}/a")
    b = physical.save_bucketed(table(spark, SMALL, "documents").select("doc_id", "source"), "bucketed_lineage", "doc_id", 4, f"{tmp_path}/b")
    try:
        q1 = physical.rollup(a, b, "doc_id", "source", "score")
        below = operators_below_aggregates(physical.explain(q1, "simple"))
        assert any("SortMergeJoin" in line for line in below)
        assert not any("Exchange" in line for line in below), below
        plain = physical.rollup(scores, table(spark, SMALL, "documents").select("doc_id", "source"), "doc_id", "source", "score")
        assert any("Exchange" in line for line in operators_below_aggregates(physical.explain(plain, "simple")))
        assert [tuple(r) for r in q1.collect()] == [tuple(r) for r in etl_queries.q1(spark, SMALL).collect()]
        size, rows = physical.table_size(spark, "bucketed_scores")
        assert size > 0 and rows == scores.count()
        known = physical.column_statistics(spark, "bucketed_scores", "doc_id")
        assert int(known["max"]) == scores.agg(F.max("doc_id")).first()[0] and known["num_nulls"] == "0"
        assert "PushedFilters" in physical.explain(q1)
    finally:
        for name in ("bucketed_scores", "bucketed_lineage"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
