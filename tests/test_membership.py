"""Effects by membership against ranks of the whole table."""

from __future__ import annotations

import numpy as np
import pandas as pd

from headwater.operators import membership, stratified


def test_scores_are_ranked_in_parts_of_queries(spark, monkeypatch):
    monkeypatch.setattr(membership, "CELLS", 60)
    monkeypatch.setattr(membership, "BLOCK_ROWS", 7)
    r = np.random.default_rng(3)
    x, m = r.integers(-2, 3, (30, 3)) / 2, r.integers(0, 2, (30, 4))
    u, o = np.vstack([r.integers(-2, 3, (9, 3)), np.zeros((1, 3))]), r.normal(size=(10, 4)).round(1)
    samples = spark.createDataFrame([(x[i].tolist(), m[i].tolist()) for i in range(30)], "vec array<float>, member array<int>").repartition(2)
    asked = spark.createDataFrame([(i, u[i].tolist(), o[i].tolist()) for i in range(10)], "query_id long, vec array<float>, outcome array<double>")
    got = membership.membership_lds(samples.select("vec", membership.array_ranks(samples.member).alias("ranks")), asked.select("query_id", "vec", membership.array_ranks(asked.outcome).alias("ranks")))
    got = {q.query_id: q.rho for q in got.collect()}
    assert len(got) == 10 and got[9] == 0.0
    for q in range(9):
        effect = pd.Series([pd.Series(m[i]).rank().corr(pd.Series(o[q]).rank()) if 0 < m[i].sum() < 4 else 0.0 for i in range(30)]).round(9)
        rho = pd.Series(x @ u[q]).round(9).rank().corr(effect.rank())
        assert np.isclose(got[q], 0.0 if np.isnan(rho) else rho)


def test_medians_are_taken_in_parts_of_queries(spark, monkeypatch):
    monkeypatch.setattr(membership, "CELLS", 60)
    monkeypatch.setattr(membership, "BLOCK_ROWS", 7)
    r = np.random.default_rng(5)
    x, u = r.normal(size=(31, 3)), r.normal(size=(9, 3))
    g = spark.createDataFrame([(i, f"s{i % 4}", x[i].tolist()) for i in range(31)], "sample_index long, source_id string, vec array<double>").repartition(2)
    q = spark.createDataFrame([(i, u[i].tolist()) for i in range(9)], "query_id long, vec array<double>")
    got = {(m.query_id, m.source): m.median for m in membership.source_medians(g, q).collect()}
    assert len(got) == 36 and all(np.isclose(got[i, f"s{k}"], np.median(x[k::4] @ u[i])) for i in range(9) for k in range(4))


def test_the_strongest_are_found_in_parts_of_queries(spark, monkeypatch):
    """Ties, repeated samples and queries, a source and a sample without a name, and what is not a number, against all scores; no row leaves a task for a score."""
    monkeypatch.setattr(membership, "KEPT", 14)
    monkeypatch.setattr(membership, "TILE", 40)
    monkeypatch.setattr(membership, "BLOCK_ROWS", 7)
    r = np.random.default_rng(6)
    x = np.vstack([r.integers(-2, 3, (40, 3)) / 2, np.tile([[1.0, -0.5, 0.5]], (30, 1)), r.normal(size=(20, 3)), [[np.nan, 0, 0], [np.inf, 0, 0]]])
    rows = [(i, None if i % 9 == 0 else f"s{i % 4}", v.tolist()) for i, v in enumerate(x)]
    rows = [rows[k] for k in r.permutation(len(rows))] + [rows[3], rows[80], (None, "s9", [1.0, -0.5, 0.5])]
    u = np.vstack([r.integers(-2, 3, (8, 3)), r.normal(size=(4, 3)), np.ones((1, 3))])
    asked = [(i, v.tolist()) for i, v in enumerate(u)]
    asked.append(asked[9])
    g = spark.createDataFrame(rows, "sample_index long, source_id string, vec array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, vec array<double>").repartition(2)
    for k in (1, 7, 33, 500):
        want = {}
        for i in range(len(u)):
            with np.errstate(invalid="ignore"):
                scored = [(abs(float(np.dot(v, u[i]))), s, name) for s, name, v in rows] * (2 if i == 9 else 1)
            key = lambda t: (not np.isnan(t[0]), -round(t[0], 9) if not np.isnan(t[0]) else 0.0, t[1] is None, t[1] or 0)
            for value, _, name in sorted(scored, key=key)[:k]:
                n, mass = want.get((i, name), (0, 0.0))
                want[i, name] = (n + 1, mass + value)
        got = {(m.query_id, m.source_id): (m.n, m.mass) for m in membership.strongest_by_source(g, q, k).collect()}
        assert got.keys() == want.keys()
        assert all(got[w][0] == want[w][0] and np.isclose(got[w][1], want[w][1], equal_nan=True) for w in want)


def test_shuffled_vectors_do_not_grow_with_the_strongest(spark):
    """Rows that meet in the shuffle of ``attrib_block`` are blocks of vectors and queries: as many for any k."""
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 4))
    g = spark.createDataFrame([(i, f"s{i % 4}", v.tolist()) for i, v in enumerate(x)], "sample_index long, source_id string, vec array<double>").repartition(3)
    q = g.filter("sample_index < 12").selectExpr("sample_index AS query_id", "vec")
    blocks = stratified.block_magnitudes(q, {f"s{i}": (i, 1) for i in range(4)})

    def moved(k):
        df = stratified.attrib_block(g, q, stratified.priors(g), blocks, 600, k)
        assert len(df.collect()) == 48
        plan, nodes = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []
        visit = [plan]
        while visit:
            at = visit.pop()
            if at.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
                at = at.plan()
            if at.nodeName() == "Exchange":
                nodes.append(at.metrics().apply("shuffleRecordsWritten").value())
            children = at.children()
            visit += [children.apply(i) for i in range(children.size())]
        return sum(nodes)

    assert moved(5) > 0 and moved(300) < 1.5 * moved(5)


def test_subsets_are_added_up_before_they_meet_the_queries(spark):
    """Sums against NumPy: a sample of no subset, of one twice, of null ones, vectors that are not finite (their own subsets alone have that), a query asked twice."""
    r = np.random.default_rng(8)
    x = np.vstack([r.normal(size=(40, 3)), [[np.inf, 0, 1], [0, np.nan, 1]]])
    subsets = [sorted(set(r.integers(0, 6, 3).tolist())) for _ in range(40)] + [[7, 1], [8]]
    subsets[3], subsets[4], subsets[5] = [], None, [2, 2]
    for finite in (True, False):
        n = 40 if finite else 42
        samples = spark.createDataFrame([(subsets[i], x[i].tolist()) for i in range(n)], "subsets array<long>, vec array<double>").repartition(3)
        times = np.array([[(subsets[i] or []).count(k) for i in range(n)] for k in range(9)])
        got = {s.subset: s for s in membership.subset_sums(samples).collect()}
        assert set(got) == set(np.flatnonzero(times.sum(1)))
        u = r.normal(size=(2, 3))
        asked = spark.createDataFrame([(0, u[0].tolist()), (1, u[1].tolist()), (1, u[0].tolist())], "query_id long, vec array<double>")
        scores = {(s.query_id, s.subset): s for s in membership.subset_outcomes(samples, asked).collect()}
        for k in got:
            own = [i for i in range(n) for _ in range(times[k, i])]
            assert got[k].n == len(own)
            np.testing.assert_allclose(got[k].total, x[own].sum(0))
            assert [scores[q, k].n for q in (0, 1)] == [len(own), 2 * len(own)] and scores[1, k].times == 2
            np.testing.assert_allclose([scores[q, k].score for q in (0, 1)], [(x[own] @ u[0]).sum(), (x[own] @ (u[0] + u[1])).sum()])


def test_no_row_is_made_for_a_sample_a_query_and_a_subset(spark):
    from headwater import catalogue

    from .conftest import SMALL

    df = catalogue.queries()["lds_spearman"](spark, SMALL)
    assert len(df.collect()) > 1
    visit, made = [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while visit:
        at = visit.pop()
        if at.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage"):
            at = at.plan()
        if at.nodeName() == "Generate":
            made += at.metrics().apply("numOutputRows").value()
        children = at.children()
        visit += [children.apply(i) for i in range(children.size())]
    assert 0 < made <= 40 * spark.read.parquet(f"{SMALL}/embeddings.parquet").count()


def test_medians_are_narrowed_down_by_counts(spark, monkeypatch):
    """Ties, one value alone, two far ends, a source without a name, what is not finite, and a query asked twice, against all scores; no row leaves a task for most of them."""
    r = np.random.default_rng(9)
    x = np.vstack([r.normal(size=(400, 3)), np.zeros((120, 3)), np.tile([[1e-9, 2.0, -1.0]], (90, 1)), r.choice([-1.0, 1.0], (100, 3)), 1e6 + r.normal(size=(101, 3))])
    kind = [f"s{i % 2}" for i in range(400)] + [("s0", "zero", None)[i % 3] for i in range(120)] + ["one"] * 90 + ["ends"] * 100 + ["far"] * 101
    odd = [(x[i] * 0 + v).tolist() for i, v in enumerate([np.inf, -np.inf, np.nan, np.inf])]
    rows = [(i, k, v.tolist()) for i, (k, v) in enumerate(zip(kind, x, strict=True))] + [(900 + i, "s1" if i < 2 else "odd", v) for i, v in enumerate(odd)]
    u = np.vstack([r.normal(size=(5, 3)), [[1.0, 1.0, 1.0]], [[0.5, 0, 0]]])
    asked = [(i, v.tolist()) for i, v in enumerate(u)] + [(3, u[0].tolist())]
    g = spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], "sample_index long, source_id string, vec array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, vec array<double>").repartition(2)
    want = {}
    for i, v in asked:
        for _, s, w in rows:
            with np.errstate(invalid="ignore"):
                want.setdefault((i, s), []).append(float(np.dot(w, v)))
    with np.errstate(invalid="ignore"):
        half = {k: (lambda v: v[(len(v) - 1) // 2] + (v[len(v) // 2] - v[(len(v) - 1) // 2]) * 0.5 if len(v) % 2 == 0 else v[len(v) // 2])(np.sort(v)) for k, v in want.items()}
    for bins, few, rounds, hold in ((64, 256, 5, 256 << 20), (4, 3, 40, 256 << 20), (5, 10, 2, 100)):
        for name, value in (("BINS", bins), ("FEW", few), ("ROUNDS", rounds), ("HOLD", hold), ("PIECE", 500)):
            monkeypatch.setattr(membership, name, value)
        got = {(m.query_id, m.source): m.median for m in membership.source_medians(g, q).collect()}
        assert got.keys() == half.keys()
        for k in got:
            np.testing.assert_allclose(got[k], half[k], rtol=1e-9, atol=1e-12, err_msg=str(k))
    assert membership.source_medians(g.filter("false"), q).count() == membership.source_medians(g, q.filter("false")).count() == 0


def test_no_vector_is_shuffled_for_a_median(spark, monkeypatch):
    monkeypatch.setattr(membership, "CELLS", 3000)
    r = np.random.default_rng(10)
    g = spark.createDataFrame([(i, f"s{i % 2}", v.tolist()) for i, v in enumerate(r.normal(size=(2400, 64)))], "sample_index long, source_id string, vec array<double>").coalesce(2)
    q = g.filter("sample_index < 20").selectExpr("sample_index AS query_id", "vec")
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()) if stages.apply(i).stageId() > last)

    last = -1
    spark.range(1).collect()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    last = max(stages.apply(i).stageId() for i in range(stages.size()))
    assert len(membership.source_medians(g, q).collect()) == 40
    assert 0 < written() < 2400 * 64 * 8 / 2
