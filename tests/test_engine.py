"""Attribution that finds its own store, its own query and the files behind samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from headwater import model
from headwater.operators import engine
from headwater.operators.engine import AttributionEngine
from headwater.operators.gradients import TrainingContext

rng = np.random.default_rng(6)


def test_attribution_of_the_active_store(spark, tmp_path):
    spark.catalog.dropTempView("active_gradients")
    assert engine.training_attribution(spark) is None
    context = TrainingContext(spark, f"{tmp_path}/g", "a", 3)
    x = rng.normal(size=(12, 3))
    context.log(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), F.col("v"), F.col("i"), node=F.col("i") % 4)
    context.activate()
    zero = engine.training_attribution(spark, k=4).orderBy("rank").collect()
    assert [(r.sample_index, r.score) for r in zero] == [(i, 0.0) for i in range(4)]  # no query: zeros, ties by sample
    query = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, vec array<double>")
    top = engine.training_attribution(spark, queries=query, k=3, most_harmful=True).orderBy("rank").collect()
    assert [r.sample_index for r in top] == np.argsort(-x[:, 0])[:3].tolist() and top[0].source_node_id == top[0].sample_index % 4
    spark.catalog.dropTempView("active_gradients")


def test_sources_are_the_files_behind_nodes(spark):
    nodes = [(0, [1], "f8", 0, {"file": "a.csv"}), (1, [1], "f8", 0, {"source_file": "b.csv"}), (2, [1], "f8", 0, {}), (3, [1], "f8", 0, {}), (4, [1], "f8", 0, {})]
    edges = [(0, "add", [0, 1], 2, 0, {}, []), (1, "mul", [1], 3, 0, {}, [])]
    nodes, edges = spark.createDataFrame(nodes, model.NODES), spark.createDataFrame(edges, model.EDGES)
    assert {r.node: r.file for r in engine.source_files(nodes, edges).collect()} == {0: "a.csv", 1: "b.csv", 2: "a.csv", 3: "b.csv"}
    rows = [(i, i, "own", node, 0.0, [float(i), 1.0]) for i, node in enumerate([2, 3, 3, 4, None])]
    gradients = spark.createDataFrame(rows, model.GRADIENTS)
    query = spark.createDataFrame([(7, [1.0, 1.0])], "query_id long, vec array<double>")
    got = {r.source: (r.n, r.total) for r in AttributionEngine(gradients, 2).by_source(query, nodes, edges).collect()}
    assert got == {"a.csv": (1, 1.0), "b.csv": (2, 5.0), "own": (2, 9.0)}  # node 4 names no file, and one sample has no node
    assert {r.source for r in AttributionEngine(gradients, 2).by_source(query).collect()} == {"own"}
