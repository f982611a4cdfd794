"""Ranks, quantiles, Kendall's tau and AUC of groups of any size against plain NumPy and all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.functions import ranks, statistics
from headwater.session import table

from .conftest import SMALL

rng = np.random.default_rng(9)


def average_ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def tau(x, y):
    sx, sy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()) if (sx**2).sum() * (sy**2).sum() else None


def sample(spark, n=400):
    rows = [("abc"[i % 3] if i % 11 else None, int(rng.integers(0, 30)) / 4, float(rng.integers(0, 12)), int(rng.integers(0, 2))) for i in range(n)]
    rows += [("hot", 1.0, float(i % 5), i % 2) for i in range(300)] + [("one", 2.0, 3.0, 1)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double, label int").repartition(5)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_and_quantiles(spark, by):
    rows, df = sample(spark)
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if by else None, []).append(r)
    got = {}
    for r in ranks.with_rank(df, "x", by, "rank").collect():
        got.setdefault(r.g if by else None, set()).add((r.x, r["rank"]))
    middle = {(r.g if by else None): r["quantile"] for r in ranks.quantiles(df, "x", 0.3, by).collect()}
    for g, own in groups.items():
        x = [r[1] for r in own]
        assert got[g] == set(zip(x, average_ranks(x), strict=True))
        assert middle[g] == pytest.approx(np.quantile(x, 0.3))
    rho = {(r.g if by else None): r.rho for r in statistics.spearman(df, "x", "y", by).collect()}
    for g, own in groups.items():
        a, b = average_ranks([r[1] for r in own]), average_ranks([r[2] for r in own])
        want = None if a.std() * b.std() == 0 else np.corrcoef(a, b)[0, 1]
        assert rho[g] == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_tau_and_auc(spark, by):
    rows, df = sample(spark)
    groups = {}
    for r in rows:
        groups.setdefault(r[0] if by else None, []).append(r)
    got = {(r.g if by else None): r.tau for r in ranks.kendall(df, "x", "y", by).collect()}
    auc = {(r.g if by else None): r.auc for r in statistics.roc_auc(df, "x", "label", by).collect()}
    assert set(got) == set(auc) == set(groups)
    for g, own in groups.items():
        x, y, label = (np.array([r[k] for r in own]) for k in (1, 2, 3))
        want = tau(x, y)
        assert got[g] == (want if want is None else pytest.approx(want))
        if 0 < label.sum() < len(label):
            assert auc[g] == pytest.approx((np.sign(np.subtract.outer(x[label == 1], x[label == 0])) + 1).mean() / 2)


def test_inversions_with_weights():
    y, w = rng.integers(0, 9, 200), rng.integers(1, 4, 200)
    want = sum(int(w[i] * w[j]) for i in range(200) for j in range(i + 1, 200) if y[i] > y[j])
    assert ranks.inversions(y, w) == want and ranks.inversions(y[:0], w[:0]) == ranks.inversions(y[:1], w[:1]) == 0


def test_one_large_group_never_meets_in_one_task(spark):
    """No stage of the rows' own size runs as one task: only sums of ranges do."""
    li = table(spark, SMALL, "lineitem").select("l_extendedprice", "l_quantity")
    for df in (ranks.with_rank(li, "l_extendedprice", [], "r"), ranks.kendall(li, "l_extendedprice", "l_quantity", []), statistics.spearman(li, "l_extendedprice", "l_quantity", [])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            assert "Window" not in line or "_part" in line
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()  # no pairs
    prices = sorted(r.l_extendedprice for r in li.collect())
    top = ranks.with_rank(li, "l_extendedprice", [], "r").orderBy(F.desc("r")).first()
    assert top.l_extendedprice == prices[-1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, x double, y double, label int")
    assert ranks.with_rank(none, "x", [], "r").count() == ranks.kendall(none, "x", "y", ["g"]).count() == ranks.quantiles(none, "x", 0.5, ["g"]).count() == 0
    assert [tuple(r) for r in ranks.quantiles(none, "x", 0.5, []).collect()] == [(None,)]
