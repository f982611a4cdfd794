"""Operators against NumPy and hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.functions import statistics, vectors
from headwater.functions.numbering import numbered
from headwater.operators import attribution, blocks, capture, etl, gradients, graph, sketch, stratified, unlearning, valuation
from headwater.sources import readers, stores
from headwater.streaming import window

rng = np.random.default_rng(0)
EDGES = "id long, op_name string, input_ids array<long>, output_id long, source_ids array<string>"


def store(spark, x, sources=None):
    rows = [(i, i, (sources or ["a"] * len(x))[i], i, 0.0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "entry_seq long, sample_index long, source_id string, source_node_id long, loss double, vec array<double>")


def queries(spark, q):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id long, vec array<double>")


def scores_of(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.query_id, r.sample_index] = r.score
    return out


def diamond(spark):
    rows = [(0, "add", [0, 1], 2, ["A", "B"]), (1, "mul", [2], 3, []), (2, "sqrt", [2], 4, []), (3, "add", [3, 4], 5, []), (4, "add", [6, 6], 7, ["C"])]
    return spark.createDataFrame(rows, EDGES)


def test_projection_matches_its_matrix(spark):
    x = rng.normal(size=(7, 12))
    p = attribution.project(store(spark, x), 5, 12, seed=3)
    got = np.array([r.vec for r in p.orderBy("sample_index").collect()])
    m = attribution.projection_matrix(12, 5, 3)
    assert np.allclose(got, x @ m.T)
    rows = np.array([r.row for r in attribution.projection(spark, 12, 5, 3).orderBy("i").collect()])
    assert np.allclose(rows, m)


def test_projection_of_wrong_width_raises(spark):
    with pytest.raises(Exception, match="vectors have"):
        attribution.project(store(spark, rng.normal(size=(3, 4))), 2, 5).collect()


def test_trak_and_dot(spark):
    x, q = rng.normal(size=(40, 6)), rng.normal(size=(3, 6))
    g = x.T @ x
    want = q @ np.linalg.inv(g + 1e-3 * np.trace(g) / 6 * np.eye(6)) @ x.T
    got = scores_of(attribution.trak_scores(store(spark, x), queries(spark, q), 6), 3, 40)
    assert np.allclose(got, want)
    assert np.allclose(scores_of(attribution.dot_scores(store(spark, x), queries(spark, q)), 3, 40), q @ x.T)


def test_normalisation_is_skipped_for_tiny_scores_and_scale_free(spark):
    zero = attribution.normalised(attribution.dot_scores(store(spark, np.zeros((3, 2))), queries(spark, np.ones((1, 2)))))
    assert {r.score for r in zero.collect()} == {0.0}
    x, q = rng.normal(size=(10, 4)), rng.normal(size=(1, 4))
    a = scores_of(attribution.normalised(attribution.dot_scores(store(spark, x), queries(spark, q))), 1, 10)
    b = scores_of(attribution.normalised(attribution.dot_scores(store(spark, x), queries(spark, 7 * q))), 1, 10)
    assert np.allclose(a, b) and np.isclose(np.abs(a).max(), 1)


def test_top_k_order_ties_and_k_beyond_n(spark):
    s = spark.createDataFrame([(0, 3, "a", 1.0), (0, 1, "a", 1.0), (0, 2, "b", -1.0)], "query_id long, sample_index long, source_id string, score double")
    assert [r.sample_index for r in attribution.top_k(s, 9).orderBy("rank").collect()] == [2, 1, 3]
    assert [r.sample_index for r in attribution.top_k(s, 2, True).orderBy("rank").collect()] == [1, 3]


def test_source_stratified_null_source(spark):
    s = spark.createDataFrame([(0, 0, None, 2.0), (0, 1, "", -4.0), (0, 2, "a", 1.0)], "query_id long, sample_index long, source_id string, score double")
    rows = {r.source: r for r in attribution.source_stratified(s).collect()}
    assert rows["unknown"].n == 2 and rows["unknown"].mean == -1.0 and rows["unknown"].std == 3.0 and rows["a"].rank == 1


def test_empty_store(spark):
    empty = store(spark, np.zeros((0, 2))).filter("false")
    assert attribution.dot_scores(empty, queries(spark, np.ones((1, 2)))).count() == 0
    assert valuation.knn_values(empty, queries(spark, np.ones((1, 2)))).count() == 0


def test_ancestors_of_diamond_and_node_zero(spark):
    e = diamond(spark)
    start = spark.createDataFrame([(5,), (2,), (0,)], "start long")
    got = {}
    for r in graph.ancestors(e, start).collect():
        got.setdefault(r.start, set()).add(r.node)
    assert got == {5: {0, 1, 2, 3, 4}, 2: {0, 1}}
    down = {r.node for r in graph.descendants(e, spark.createDataFrame([(0,)], "start long")).collect()}
    assert down == {2, 3, 4, 5}


def test_cycle_reaches_itself(spark):
    e = spark.createDataFrame([(0, "a", [1], 2, []), (1, "b", [2], 1, [])], EDGES)
    assert {r.node for r in graph.ancestors(e, spark.createDataFrame([(1,)], "start long")).collect()} == {1, 2}


def test_parents_keep_repeats_and_sources(spark):
    e = diamond(spark)
    nodes = spark.range(8).select("id", F.array(F.lit(1).cast("long")).alias("shape"), F.lit("f8").alias("dtype"))
    assert [r.id for r in graph.parents(e, nodes, 7).collect()] == [6, 6]
    assert {r.source_id for r in graph.source_ids_in_path(e, spark.createDataFrame([(5,)], "start long")).collect()} == {"A", "B"}
    assert {(r.node, r.root) for r in graph.roots(e, nodes).collect()} >= {(5, 0), (5, 1), (7, 6), (0, 0)}


def test_self_loop_shows_twice(spark):
    e = spark.createDataFrame([(0, "a", [1], 1, [])], EDGES)
    assert graph.edges_for_node(e, 1).count() == 2


def test_capture(spark):
    rec = capture.Recorder("op")
    a = capture.TrackedFrame(spark.range(3), rec, "a.csv")
    b = capture.TrackedFrame(spark.range(3), rec, "b.csv")
    c = a.union(b).with_column("x", F.col("id") * 2.0).where("x > 1")
    d = c.standardise(["x"])
    nodes, edges = rec.frames(spark)
    assert nodes.count() == 5 and [r.op_name for r in edges.orderBy("id").collect()] == ["concatenate", "compute", "standardise"]
    assert edges.filter("op_name = 'concatenate'").first().source_ids == ["a.csv", "b.csv"]
    assert {r.node for r in graph.ancestors(edges, spark.createDataFrame([(d.node,)], "start long")).collect()} == {0, 1, 2, 3}
    assert capture.TrackedFrame(spark.range(1), capture.Recorder("none")).node is None
    rows = capture.TrackedFrame(spark.range(2), capture.Recorder("row"), "a").df.select("_row.source").collect()
    assert {r.source for r in rows} == {"a"}


def test_left_join_without_children_and_imputation(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    child = spark.createDataFrame([(1, 2.0, 10), (1, 4.0, 11)], "k long, v double, row_id long")
    agg = etl.aggregate_child(child, "k", {"n": F.count("v"), "m": F.avg("v")}, "row_id")
    out = {r.k: r for r in etl.attach(parent, agg, "k", ["n"]).collect()}
    assert out[1].n == 2 and list(out[1].row_ids) == [10, 11] and out[2].n == 0 and out[2].m is None
    filled = {r.k: r.m for r in etl.impute_mean(etl.attach(parent, agg, "k"), ["m"]).collect()}
    assert filled == {1: 3.0, 2: 3.0}


def test_plant_and_flip(spark):
    t = spark.createDataFrame([([1, 2, 0, 0],), ([1, 2, 3, 4],)], "t array<int>")
    assert [list(r[0]) for r in t.select(etl.plant(F.col("t"), [8, 9])).collect()] == [[1, 2, 8, 9], [1, 2, 8, 9]]
    f = spark.range(200).select((F.col("id") % 7).alias("y"), etl.flip_label(F.col("id") % 7, F.col("id"), 7).alias("z")).collect()
    assert all(r.y != r.z and 0 <= r.z < 7 for r in f)


def test_valuation_zero_fill_and_ties(spark):
    x = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    v = {r.sample_index: r.value for r in valuation.knn_values(store(spark, x), queries(spark, [[1.0, 0]]), k=2).collect()}
    assert v == {0: 0.5, 1: 0.25, 2: 0.0}


def test_unlearning_matches_the_loop(spark):
    x = rng.normal(size=(20, 4)) + 1
    src = ["t" if i < 5 else "r" for i in range(20)]
    got = np.array([r.vec for r in unlearning.corrected(store(spark, x, src), "t", 4, steps=30, rate=0.02).orderBy("sample_index").collect()])
    want, c = x.copy(), 0.02 * x[:5].mean(0)
    for _ in range(30):
        want[:5] -= c
        c = c * 0.95
    assert np.allclose(got, want)
    row = unlearning.unlearn(store(spark, x, src), "missing", 4).first()
    assert row.verified and row.n_steps == 0


def test_descent_matches_numpy(spark):
    x, y = rng.normal(size=(30, 3)), rng.integers(0, 2, 30)
    df = spark.createDataFrame([([float(a) for a in r], int(b)) for r, b in zip(x, y, strict=True)], "x array<double>, y int")
    w = np.zeros(3)
    for _ in range(3):
        w -= 0.5 * ((1 / (1 + np.exp(-x @ w)) - y)[:, None] * x).mean(0)
    assert np.allclose(gradients.gradient_descent(df, "x", "y", 3, 3, 0.5), w)


def test_per_source_trak_matches_numpy(spark):
    x, q = rng.normal(size=(60, 4)), rng.normal(size=(2, 4))
    src = ["a", "b", "c"] * 20
    got = {(r.query_id, r.source): r.value for r in stratified.per_source_trak(store(spark, x, src), queries(spark, q), 4).collect()}
    for k, s in enumerate("abc"):
        own = x[k::3]
        g = own.T @ own
        want = np.abs(q @ np.linalg.inv(g + 1e-3 * np.trace(g) / 4 * np.eye(4)) @ own.T).max(1)
        assert np.allclose([got[(i, s)] for i in range(2)], want)


def test_whitening_matches_numpy(spark):
    rows = [(i % 3, "m", [float(a) for a in rng.normal(size=2)], [float(b) for b in rng.normal(size=3)]) for i in range(30)]
    f = spark.createDataFrame(rows, "sample_index long, module string, a array<double>, g array<double>")
    got = {(r.sample_index, r.o, r.i): r.value for r in sketch.whiten(sketch.sample_gradients(f), sketch.covariances(f)).collect()}
    a, g, s = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows])
    left, right = sketch.inverse_root(g.T @ g), sketch.inverse_root(a.T @ a)
    for k in range(3):
        want = left @ (g[s == k].T @ a[s == k]) @ right
        assert np.allclose([[got[(k, o, i)] for i in range(2)] for o in range(3)], want)
    assert np.allclose(left @ (g.T @ g + 0.1 * np.trace(g.T @ g) / 3 * np.eye(3)) @ left, np.eye(3))


def test_rank_statistics(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 1.0), ("k", 2.0, 4.0), ("k", 5.0, 9.0)], "k string, x double, y double")
    rx, ry = np.array([1, 2.5, 2.5, 4]), np.array([2, 1, 3, 4])
    assert np.isclose(statistics.spearman(df, "x", "y", ["k"]).first().rho, np.corrcoef(rx, ry)[0, 1])
    flat = df.withColumn("x", F.lit(1.0))
    assert statistics.spearman(flat, "x", "y", ["k"]).first().rho is None
    auc = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)], "s double, l int")
    assert statistics.roc_auc(auc, "s", "l", []).first().auc == pytest.approx(0.875)


def test_vectors(spark):
    r = spark.range(1).select(vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"), vectors.norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).first()
    assert (r.d, r.n) == (11.0, 5.0)


def test_csv_origin_and_bad_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n4,5,6\n")
    df = readers.from_csv(spark, str(tmp_path / "a.csv"), ["a", "b", "c"], source_id="a.csv")
    assert [list(r) for r in df.agg(F.sum("a"), F.sum("b"), F.sum("c")).collect()] == [[5.0, 7.0, 9.0]]
    assert {r.source_id for r in df.collect()} == {"a.csv"}
    (tmp_path / "b.csv").write_text("a\nx\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.from_csv(spark, str(tmp_path / "b.csv"), ["a"], source_id="b").collect()


def test_store_round_trip(spark, tmp_path):
    s = stores.LineageStore(spark, str(tmp_path / "store"))
    e = diamond(spark).select("id", "op_name", "input_ids", "output_id", F.lit(0).cast("long").alias("ts_ns"), F.lit(None).cast("map<string,string>").alias("meta"), "source_ids")
    assert s.edges().count() == 0
    s.save_edges(e)
    s.save_edges(e.filter("id = 1").withColumn("op_name", F.lit("new")))
    assert s.edges().count() == 5 and s.edge(1).first().op_name == "new" and list(s.edge(0).first().source_ids) == ["A", "B"]
    stores.export_with_lineage(e, str(tmp_path / "x"), {"ops": ["add"]})
    assert stores.read_lineage(spark, str(tmp_path / "x")) == {"ops": ["add"]}
    stores.save_gradients(store(spark, np.ones((2, 3))), str(tmp_path / "g"), 9, 3, 7)
    g, setting = readers.from_gradient_store(spark, str(tmp_path / "g"))
    assert g.count() == 2 and setting == {"input_dim": 9, "proj_dim": 3, "seed": 7}
    s.clear()
    assert s.edges().count() == 0


def test_json_blocks(spark, tmp_path):
    (tmp_path / "log.txt").write_text('start\nresult {"auc": 0.5, "n": 3} done\n')
    assert readers.json_blocks(spark, str(tmp_path / "log.txt"), "auc double, n long").first().asDict() == {"auc": 0.5, "n": 3}


def test_late_sample_leaves_a_full_window(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in (5, 6, 7, 1)], "source_id string, sample_index long, value double")
    assert sorted(r.sample_index for r in window.batch_window(rows, 3).collect()) == [5, 6, 7]


def test_queries_beyond_the_broadcast_bound_meet_in_a_shuffle(spark, monkeypatch):
    x, q = rng.normal(size=(60, 4)), rng.normal(size=(17, 4))
    monkeypatch.setattr(blocks, "MAX_QUERY_BYTES", 64)
    scores = attribution.dot_scores(store(spark, x), queries(spark, q))
    assert "CartesianProduct" not in scores._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_allclose(scores_of(scores, 17, 60), q @ x.T)


def test_insert_if_absent_takes_the_first_by_content(spark):
    from headwater.sources import stores

    old = spark.createDataFrame([(1, "x")], "id long, op string")
    more = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (3, None)], "id long, op string").repartition(3)
    assert sorted(tuple(r) for r in stores.insert_if_absent(old, more).collect()) == [(2, "b"), (3, None)]


def test_influence_graph_grows_and_counts(spark):
    from headwater.operators import graph

    edge = "id long, source_node_id long, target_node_id long, influence_score double"
    old, more = spark.createDataFrame([(4, 0, 1, 0.5)], edge), spark.createDataFrame([(0, 2, 1, 0.1), (0, 0, 2, 0.2)], edge).drop("id")
    both = graph.add_gradient_edges(old, more)
    assert sorted((r.id, r.source_node_id) for r in both.collect()) == [(4, 0), (5, 0), (6, 2)]
    some = spark.range(3)
    assert tuple(graph.influence_stats(some, some.limit(2), both).first()) == (3, 2, 3)


def test_bonferroni_and_seeds(spark):
    from headwater.functions import statistics

    df = spark.createDataFrame([("a", 0.01, 1.0), ("a", 0.5, 0.0), ("b", 0.2, 0.1)], "m string, p double, v double")
    assert [round(r.p_adjusted, 9) for r in statistics.bonferroni(df).orderBy("p").collect()] == [0.03, 0.6, 1.0]
    got = {r.m: (r.n, r.mean, r.std, r.passed) for r in statistics.over_seeds(df, ["m"], "v", 0.2).collect()}
    assert got == {"a": (2, 0.5, 0.5, True), "b": (1, 0.1, 0.0, False)}


def test_roots_of_a_deep_chain_a_cycle_and_joins(spark):
    chain = [(i, "f", [i], i + 1, []) for i in range(300)]  # 0 -> ... -> 300
    more = [(1000, "f", [300, 400], 500, []), (1001, "f", [500], 501, []), (1002, "f", [500, 0], 502, []), (1003, "f", [601], 600, []), (1004, "f", [600], 601, []), (1005, "f", [700, 700], 701, [])]
    edges = spark.createDataFrame(chain + more, EDGES)
    nodes = spark.createDataFrame([(i,) for i in (*range(301), 400, 500, 501, 502, 600, 601, 700, 701, 900)], "id long")
    got = {(r.node, r.root) for r in graph.roots(edges, nodes).collect()}
    want = {(i, 0) for i in range(301)} | {(400, 400), (500, 0), (500, 400), (501, 0), (501, 400), (502, 0), (502, 400), (700, 700), (701, 700), (900, 900)}
    assert got == want


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 101).alias("x"), F.col("id").alias("y"))
    runs = [{(r.x, r.y): r.n for r in numbered(rows.repartition(k), ["x", "y"], "n", 5).collect()} for k in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and sorted(runs[0].values()) == list(range(5, 505))
    assert numbered(rows.limit(0), ["x", "y"], "n").count() == 0


def test_training_context_numbers_on_and_projects(spark, tmp_path):
    x = rng.normal(size=(9, 6))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>")
    at = lambda source: gradients.TrainingContext(spark, str(tmp_path / "g"), source, 4, input_dim=6)
    at("a").log(rows.filter("i < 5"), F.col("v"), F.col("i"))
    later = at("b")
    later.log(rows.filter("i >= 5"), F.col("v"))
    later.activate()
    got = gradients.active(spark).orderBy("entry_seq").collect()
    assert [r.entry_seq for r in got] == list(range(9)) and [r.sample_index for r in got] == list(range(9))
    assert [r.source_id for r in got] == ["a"] * 5 + ["b"] * 4
    want = x[:5] @ attribution.projection_matrix(6, 4).T
    np.testing.assert_allclose(np.array([r.vec for r in got[:5]]), want)


def test_capture_of_any_function_and_several_results(spark):
    rec = capture.Recorder("op")
    a = capture.TrackedFrame(spark.range(4).withColumn("x", F.lit(1.0)), rec, "a")
    b = capture.TrackedFrame(spark.range(4).withColumn("y", F.lit(2.0)), rec, "b")
    both = a.beside(b, "id").rename({"y": "z"}).cast({"z": "int"})
    low, high = both.apply_many("split", lambda d: (d.filter("id < 2"), d.filter("id >= 2")))
    total = low.apply("sum", lambda d, other: d.unionByName(other).agg(F.sum("x")), high.df)
    long = both.stack(["x", "z"])
    _, edges = rec.frames(spark)
    made = {(r.op_name, tuple(r.input_ids), r.output_id) for r in edges.collect()}
    assert made == {("concatenate", (a.node, b.node), both.node), ("split", (both.node,), low.node), ("split", (both.node,), high.node), ("sum", (low.node,), total.node), ("stack", (both.node,), long.node)}
    assert total.df.first()[0] == 4.0 and long.df.count() == 8


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    e = diamond(spark)
    stores.to_jdbc(e, url, "edges")
    back = stores.from_jdbc(spark, url, "edges", EDGES, by=("id", 0, 5, 2))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, e.collect()))
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        stores.decoded(spark.createDataFrame([(1, "[1")], "id long, input_ids string"), "id long, input_ids array<long>").collect()


def test_unknown_module_fails_and_stratified_split_is_exact(spark):
    f = spark.createDataFrame([(0, "x", [1.0], [1.0])], "sample_index long, module string, a array<double>, g array<double>")
    with pytest.raises(Exception, match="unknown module"):
        sketch.dense_sketch(f, {"y": (1, 1)}, 2).collect()
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("label"))
    got = etl.stratified_split(rows, "id", "label", 3, 70, buckets=8).groupBy("label").agg(F.count_if("train").alias("n"), F.count("*").alias("all")).collect()
    assert {r.n == int(r["all"] * 0.7 + 0.5) for r in got} == {True} and sum(r["all"] for r in got) == 1000


def test_subsets_are_joined_once_and_not_by_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(gradients, "stored", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or df)
    x, y = rng.normal(size=(30, 2)), rng.integers(0, 2, 30)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(30)], "sample_index long, x array<double>, y int")
    masks = spark.createDataFrame([(s, i) for s in range(2) for i in range(30) if (i + s) % 3], "subset long, sample_index long").union(spark.createDataFrame([(2, 99)], "subset long, sample_index long"))
    got = {r.subset: r.weights for r in gradients.retrain_subsets(df, masks, 2, steps=3).collect()}
    for s in range(2):
        own, w = np.array([i for i in range(30) if (i + s) % 3]), np.zeros(2)
        for _ in range(3):
            w -= 0.5 * ((1 / (1 + np.exp(-x[own] @ w)) - y[own])[:, None] * x[own]).mean(0)
        assert np.allclose(got[s], w)
    assert got[2] == [0.0, 0.0] and len(plans) == 1 and "Broadcast" not in plans[0]


@pytest.mark.parametrize("bound", [64 << 20, 1])
def test_blocks_are_reduced_inside_tasks(spark, monkeypatch, bound):
    """Peaks, tops with ties and repeated samples, weighted sums and means of checkpoints, against all scores; small tiles, many products."""
    monkeypatch.setattr(blocks, "MAX_QUERY_BYTES", bound)
    monkeypatch.setattr(blocks, "TILE", 130)
    monkeypatch.setattr(blocks, "PACK_BYTES", 24 * 17)  # blocks of unequal size meet in one task
    r = np.random.default_rng(4)
    x = np.vstack([r.integers(-3, 4, (60, 3)) / 4, np.tile([[1.0, 0.5, 0.25]], (40, 1)), r.normal(size=(20, 3))])
    g = store(spark, x, [f"s{i % 3}" for i in range(len(x))])
    g = g.unionByName(g.filter("sample_index < 5")).repartition(3)
    q = queries(spark, np.vstack([r.integers(-2, 3, (4, 3)), np.zeros((1, 3))]))
    raw = attribution.dot_scores(g, q)
    rows = lambda df: sorted((*r[:3], round(r[3], 9)) for r in df.select("query_id", "sample_index", "source_id", "score").collect())
    assert rows(attribution.normalised_scores(g, q)) == rows(attribution.normalised(raw))
    for harmful in (False, True):
        first = lambda df: sorted((r.query_id, r["rank"], r.sample_index, round(r.score, 9)) for r in df.collect())
        assert first(attribution.top_scores(g, q, 7, harmful)) == first(attribution.top_k(raw, 7, harmful))
        assert first(attribution.top_scores(g, q, 7, harmful, normal=True)) == first(attribution.top_k(attribution.normalised(raw), 7, harmful))
    assert blocks.block_top(g, q, 7).count() < 0.7 * raw.count()  # of blocks of 17 rows
    both = g.withColumns({"a": F.col("vec"), "b": vectors.scale(F.col("vec"), F.lit(3.0))})
    asked = [q, q.withColumn("vec", vectors.scale(F.col("vec"), F.col("query_id").cast("double") - 1))]
    want = attribution.multi_checkpoint([attribution.dot_scores(both.withColumn("vec", F.col(c)), a) for c, a in zip("ab", asked, strict=True)])
    assert rows(attribution.multi_checkpoint_scores(both, ["a", "b"], asked)) == rows(want)
    w = F.abs("score")
    value = F.concat(F.array(F.lit(1.0)), "vec")
    joined = raw.join(g.select("sample_index", "vec"), "sample_index").groupBy("query_id", "source_id").agg(F.sum(w).alias("w"), *(F.sum(w * F.col("vec")[i]).alias(f"m{i}") for i in range(3)))
    of_sample = g.groupBy("sample_index").agg(F.count("*").alias("n")).withColumn("n", F.col("n").cast("double"))
    given = g.join(of_sample, "sample_index").withColumn("value", vectors.scale(value, F.col("n")))
    got = {(r.query_id, r.source_id): r.total for r in blocks.weighted_sums(given, q, 3).collect()}
    for r_ in joined.collect():
        assert np.allclose(got[r_.query_id, r_.source_id], [r_.w, r_.m0, r_.m1, r_.m2])


def test_values_and_edges_of_a_node_meet_as_sums(spark):
    values = spark.createDataFrame([(1, 2.0), (1, None), (1, 4.0), (2, 5.0), (3, 7.0), (None, 1.0)], "source_node_id long, value double")
    edges = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (1, 12, "b"), (2, 10, "a"), (4, 13, "c")], "node long, edge_id long, op_name string")
    out = valuation.by_operation(values, edges)
    assert {r.op_name: (r.n, r.mean) for r in out.collect()} == {"a": (7, 17 / 5), "b": (3, 3.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3


def test_differences_of_means_make_no_pairs(spark):
    from headwater.plans import statistics_queries

    from .conftest import SMALL

    plan = statistics_queries._diffs(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join") < plan.index("Aggregate")


def test_roots_travel_once_for_a_head(spark, monkeypatch):
    """A node made of many inputs with one head has one edge from it."""
    met = []
    real = graph.chain_index
    monkeypatch.setattr(graph, "chain_index", lambda steps: met.append(steps.count()) or real(steps))
    rows = [(i, "f", [0], i, []) for i in range(1, 41)] + [(99, "sum", list(range(1, 41)), 99, [])]
    nodes = spark.createDataFrame([(i,) for i in [0, *range(1, 41), 99]], "id long")
    got = sorted((r.node, r.root) for r in graph.roots(spark.createDataFrame(rows, EDGES), nodes).collect())
    assert got == sorted((i, 0) for i in [0, *range(1, 41), 99]) and met == [1]


def test_traces_look_at_ranked_samples_alone(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(etl, "stored", lambda df, label: kept.append((label, df.count())) or df)
    top = spark.createDataFrame([(0, 1, 5), (7, 2, 5), (0, 2, 6)], "query_id long, rank int, sample_index long")
    lineage = spark.createDataFrame([(5, "t", r) for r in (9, 3, 3, None, 8)] + [(6, "t", None), (8, "t", 1)], "sample_id long, table string, row_id long")
    got = sorted(map(tuple, etl.trace_to_rows(top, lineage).collect()))
    assert got == [(0, 1, 5, "t", 5, [3, 3, 8]), (0, 2, 6, "t", 1, []), (7, 2, 5, "t", 5, [3, 3, 8])] and kept[1] == ("lineage", 6)
