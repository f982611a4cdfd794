"""Vector sums and block matrices against NumPy."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.functions import vector_sums as VS
from headwater.operators import attribution, blocks, stratified

rng = np.random.default_rng(4)


def table(spark, x, parts=3):
    rows = [(i, f"s{i % 3}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "sample_index long, source_id string, vec array<double>").repartition(parts)


def asked(spark, q):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>").repartition(2)


def matrix(df, n, m):
    out = np.full((n, m), np.nan)
    for r in df.collect():
        out[r.query_id, r.sample_index] = r.score
    return out


@pytest.mark.parametrize(("fan", "held"), [(256, 64 << 20), (2, 64 << 20), (256, 100)])
def test_vector_sums_by_any_keys(spark, fan, held, monkeypatch):
    """One level and two, and tasks that give their sums out as they go."""
    monkeypatch.setattr(VS, "FAN", fan)
    monkeypatch.setattr(VS, "HELD", held)
    x = rng.normal(size=(200, 5))
    keys = [(None if i % 7 == 0 else f"k{i % 4}", None if i % 5 == 0 else i % 3) for i in range(200)]
    df = spark.createDataFrame([(*k, i, v.tolist()) for i, (k, v) in enumerate(zip(keys, x, strict=True))], "a string, b int, i long, v array<double>").repartition(5)
    got = {(r.a, r.b): r for r in VS.vector_sums(df, ["a", "b"], "v", "i").collect()}
    assert set(got) == set(keys) and sum(r.n for r in got.values()) == 200
    for k, r in got.items():
        own = [i for i, key in enumerate(keys) if key == k]
        np.testing.assert_allclose(r.total, x[own].sum(0))
        assert (r.n, r.least) == (len(own), own[0])
    (every,) = VS.vector_sums(df, [], "v").collect()
    np.testing.assert_allclose(every.total, x.sum(0))
    assert VS.vector_sums(df.filter("false"), [], "v").count() == VS.vector_sums(df.filter("false"), ["a"], "v").count() == 0
    np.testing.assert_allclose(VS.vector_means(df, [], "v").first()["mean"], x.mean(0))


def test_wide_sums_are_fast(spark):
    wide = spark.range(2000).select((F.col("id") % 10).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(1024)), lambda i: F.sin(F.col("id") + i)).alias("v")).cache()
    wide.count()
    VS.vector_sums(wide, ["k"], "v").count()
    began = time.perf_counter()
    rows = VS.vector_sums(wide, ["k"], "v").collect()
    assert time.perf_counter() - began < 3  # under a second on an idle machine
    np.testing.assert_allclose(rows[0].total[5], np.sin(np.arange(rows[0].k, 2000, 10) + 6).sum())
    wide.unpersist()


def test_null_and_ragged_vectors_raise(spark):
    bad = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="elements or are null"):
        VS.vector_sums(bad, [], "v").collect()


@pytest.mark.parametrize(("dim", "block"), [(5, 1024), (7, 3), (64, 20)])
def test_factor_and_solution_equal_numpy(spark, dim, block, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "PACK_BYTES", 8 * dim * 4)
    x, q = rng.normal(size=(150, dim)), rng.normal(size=(11, dim))
    g = x.T @ x
    damped = g + 1e-3 * np.trace(g) / dim * np.eye(dim)
    gradients, queries = table(spark, x), asked(spark, q)
    n = -(-dim // block)
    lower = blocks.factor(blocks.gram_blocks(gradients, dim), dim)
    full = np.zeros((dim, dim))
    for r in lower.collect():
        at = slice(r.i * block, min(dim, (r.i + 1) * block))
        full[at, r.j * block : min(dim, (r.j + 1) * block)] = np.reshape(r.m, (at.stop - at.start, -1))
    np.testing.assert_allclose(full, np.linalg.cholesky(damped), atol=1e-9)
    assert lower.count() == n * (n + 1) // 2
    np.testing.assert_allclose(matrix(attribution.trak_scores(gradients, queries, dim), 11, 150), q @ np.linalg.inv(damped) @ x.T, atol=1e-8)
    own = {r.sample_index: r.score for r in attribution.self_influence_trak(gradients, dim).collect()}
    np.testing.assert_allclose([own[i] for i in range(150)], np.einsum("ni,ij,nj->n", x, np.linalg.inv(damped), x), atol=1e-8)


def test_the_widest_default_stays_in_the_executors(spark):
    """The width of the reference's default projection: no part of the matrix and no query is collected."""
    dim = 4096
    gradients = spark.range(40).select(F.col("id").alias("sample_index"), F.lit("s").alias("source_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sin(F.col("id") * i)).alias("vec")).repartition(2)
    queries = gradients.filter("sample_index < 3").select(F.col("sample_index").alias("query_id"), "vec")
    collected = []
    plain = type(gradients).collect
    type(gradients).collect = lambda self: collected.append(rows := plain(self)) or rows
    try:
        scores = attribution.trak_scores(gradients, queries, dim)
    finally:
        type(gradients).collect = plain
    assert all(len(rows) == len(rows[0]) == 1 for rows in collected)  # the trace, the bytes of the queries
    x = np.sin(np.arange(40)[:, None] * np.arange(1, dim + 1)[None, :])
    shift = 1e-3 * (x**2).sum() / dim
    inner = x @ x.T  # q (X'X + sI)^-1 X' = q X' (XX' + sI)^-1
    np.testing.assert_allclose(matrix(scores, 3, 40), inner[:3] @ np.linalg.inv(inner + shift * np.eye(40)), atol=1e-6)


def test_products_are_given_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SCORES", 20)
    x, q = rng.normal(size=(37, 3)), rng.normal(size=(8, 3))
    np.testing.assert_allclose(matrix(attribution.dot_scores(table(spark, x), asked(spark, q)), 8, 37), q @ x.T)


def test_scores_before_projection_equal_scores_after(spark):
    x, q = rng.normal(size=(40, 12)), rng.normal(size=(4, 6))
    after = attribution.dot_scores(attribution.project(table(spark, x), 6, 12), asked(spark, q))
    np.testing.assert_allclose(matrix(attribution.scores_unprojected(table(spark, x), asked(spark, q), 6, 12), 4, 40), matrix(after, 4, 40))


@pytest.mark.parametrize("bound", [64, 64 << 20])
def test_scores_by_source_under_own_matrices(spark, bound, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_QUERY_BYTES", bound)
    monkeypatch.setattr(blocks, "PACK_BYTES", 100)
    x, q = rng.normal(size=(60, 4)), rng.normal(size=(9, 4))
    got = {(r.query_id, r.source): r.value for r in stratified.per_source_trak(table(spark, x), asked(spark, q), 4).collect()}
    for s in range(3):
        own = x[s::3]
        g = own.T @ own
        want = np.abs(q @ np.linalg.inv(g + 1e-3 * np.trace(g) / 4 * np.eye(4)) @ own.T).max(1)
        np.testing.assert_allclose([got[k, f"s{s}"] for k in range(9)], want)
    means = {(r.query_id, r.source): r["mean"] for r in attribution.source_means(table(spark, x), asked(spark, q)).collect()}
    np.testing.assert_allclose([means[k, "s1"] for k in range(9)], q @ x[1::3].mean(0))


def test_two_layer_gradients_and_descent(spark):
    from headwater.operators import gradients

    x, y = rng.normal(size=(60, 3)), rng.integers(0, 2, 60)
    w1, b1, w2, b2 = rng.normal(size=(3, 4)), rng.normal(size=4), rng.normal(size=4), 0.3
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, x array<double>, y int").repartition(3)

    def loss(flat, v, t):
        a, b, c, d = flat[:12].reshape(3, 4), flat[12:16], flat[16:20], flat[20]
        z = np.maximum(v @ a + b, 0) @ c + d
        return np.logaddexp(0, z) - t * z

    flat = np.concatenate([w1.ravel(), b1, w2, [b2]])
    got = {r.i: r.g for r in gradients.mlp_gradients(df, "x", "y", w1.tolist(), b1.tolist(), w2.tolist(), b2).collect()}
    for i in range(0, 60, 7):  # finite differences
        want = [(loss(flat + e, x[i], y[i]) - loss(flat - e, x[i], y[i])) / 2e-6 for e in 1e-6 * np.eye(21)]
        np.testing.assert_allclose(got[i], want, atol=1e-5)
    moved = gradients.mlp_descent(df, "x", "y", (w1, b1, w2, b2), 3, 0.1)
    for _ in range(3):
        h = np.maximum(x @ w1 + b1, 0)
        e = (1 / (1 + np.exp(-(h @ w2 + b2))) - y) / len(x)
        down = np.outer(e, w2) * (h > 0)
        w1, b1, w2, b2 = w1 - 0.1 * x.T @ down, b1 - 0.1 * down.sum(0), w2 - 0.1 * h.T @ e, b2 - 0.1 * e.sum()
    for a, b in zip(moved, (w1, b1, w2, b2), strict=True):
        np.testing.assert_allclose(a, b)


def exchanged(df) -> int:
    """Rows that went through a shuffle when ``df`` was collected."""
    visit, n = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while visit:
        at = visit.pop()
        if at.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            at = at.plan()
        if at.nodeName() == "Exchange":
            n += at.metrics().apply("shuffleRecordsWritten").value()
        children = at.children()
        visit += [children.apply(i) for i in range(children.size())]
    return n


def test_queries_carry_their_source_into_the_product(spark):
    """Signs are those of a join of all scores with the queries' sources, of which a query may have two or none; no score is shuffled for it."""
    x = rng.normal(size=(300, 4))
    rows = [(i, None if i % 11 == 0 else f"s{i % 3}", v.tolist()) for i, v in enumerate(x)]
    g = spark.createDataFrame(rows, "sample_index long, source_id string, vec array<double>").repartition(3)
    own = [(0, "s0"), (1, None), (2, "s2"), (2, "s1"), (3, "other")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sources were a large table
    try:
        df = attribution.label_aware_scores(g, asked(spark, x[:5]), spark.createDataFrame(own, "query_id long, source_id string"))
        got = sorted((r.query_id, r.sample_index, round(r.score, 9)) for r in df.collect())
        moved = exchanged(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = sorted((q, i, round(float(x[i] @ x[q]) * (1 if s is not None and s == name else -1), 9)) for q, name in own for i, s, _ in rows)
    assert got == want and moved < 600
