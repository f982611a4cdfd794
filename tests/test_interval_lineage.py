"""Runs of row numbers against the edges that they stand for."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from headwater.operators import etl, interval_lineage
from headwater.plans import etl_queries

from .conftest import SMALL


def runs_of(edges):
    out = []
    for (sample, name, row), n in sorted(Counter(edges).items(), key=lambda e: (e[0][1], e[0][0], e[1], e[0][2])):
        if out and out[-1][:2] == [sample, name] and out[-1][4] == n and out[-1][3] == row - 1:
            out[-1][3] = row
        else:
            out.append([sample, name, row, row, n])
    return sorted(map(tuple, out))


def test_runs_are_whole_over_any_partitions(spark):
    r = random.Random(2)
    edges = [(s, t, row) for s in range(20) for t in ("a", "b") for start in [r.randint(0, 500)] for row in range(start, start + r.randint(1, 40)) if r.random() < 0.9]
    edges += [(99, "hot", row) for row in range(20_000)] + [(98, "hot", row) for row in range(0, 3000, 2)] + edges[:7]
    lineage = spark.createDataFrame(edges, "sample_id long, table string, row_id long").repartition(6)
    found = interval_lineage.runs(lineage).cache()
    assert sorted(tuple(x) for x in found.collect()) == runs_of(edges)
    assert Counter(tuple(x) for x in interval_lineage.edges_of(found).collect()) == Counter(edges)
    asked = [("a", row) for row in range(0, 540, 7)] + [("hot", 4096), ("hot", 4095), ("none", 1)]
    got = interval_lineage.samples_of(found, spark.createDataFrame(asked, "table string, row_id long"))
    assert sorted(tuple(x) for x in got.collect()) == sorted({(t, row, s) for s, t, row in edges if (t, row) in set(asked)})
    found.unpersist()


def test_lineage_of_lines_is_fewer_records_and_the_same_answer(spark):
    lineage = etl_queries.lineage(spark, SMALL)
    found = interval_lineage.runs(lineage)
    s = interval_lineage.stats(found).first()
    plain = etl.lineage_stats(lineage).first()
    assert (s.samples, s.total_rows, s.max_rows) == (plain.samples, plain.total_rows, plain.max_rows)
    assert s.records < lineage.count() * 0.75
    assert interval_lineage.lists(found).exceptAll(etl.lineage_lists(lineage)).isEmpty() and interval_lineage.lists(found).count() == etl.lineage_lists(lineage).count()


def test_empty_and_null_rows(spark):
    none = spark.createDataFrame([(None, "a", 1), (1, "a", None)], "sample_id long, table string, row_id long")
    assert interval_lineage.runs(none).count() == 0
    assert interval_lineage.runs(none.withColumn("x", F.lit(1)).limit(0)).count() == 0
