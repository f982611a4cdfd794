"""Queries that SQL does not express, against NumPy on the whole tables."""

from __future__ import annotations

import numpy as np
import pandas as pd

from headwater import catalogue
from headwater.operators import sketch

from .conftest import SMALL

Q = catalogue.queries()


def rows(spark, name, *keys):
    return Q[name](spark, SMALL).toPandas().sort_values(list(keys)).reset_index(drop=True)


def embeddings():
    e = pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")
    return e.vec_id.to_numpy(), e.label.to_numpy(), np.stack(e.embedding.to_numpy()).astype(np.float64)


def lines():
    li = pd.read_parquet(f"{SMALL}/lineitem.parquet")
    x = np.stack([li.l_quantity / 50.0, li.l_discount * 10.0, li.l_tax * 10.0], axis=1).astype(np.float64)
    return li, x, (li.l_returnflag == "R").to_numpy().astype(np.float64)


def damped_inverse(x):
    g = x.T @ x
    return np.linalg.inv(g + 1e-3 * np.trace(g) / len(g) * np.eye(len(g)))


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def fitted(x, y, ridge):
    """Weights and intercept of logistic regression, penalised on standardised columns, by Newton's method."""
    sd = x.std(0, ddof=1)
    sd[sd == 0] = 1
    z = np.hstack([x / sd, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 0.0)
    for _ in range(50):
        p = sigmoid(z @ w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + np.diag(penalty + 1e-12), z.T @ (p - y) / len(z) + penalty * w)
    return lambda new: np.hstack([new / sd, np.ones((len(new), 1))]) @ w > 0


def test_trak_scores_k64(spark):
    ids, _, x = embeddings()
    at = ids % 50 == 0
    want = x[at] @ damped_inverse(x) @ x.T
    want /= np.abs(want).max(1, keepdims=True)
    got = rows(spark, "trak_scores_k64", "query_id", "sample_index")
    np.testing.assert_allclose(got.score.to_numpy().reshape(want.shape), want, atol=2e-6)


def test_sab_per_source_trak(spark):
    ids, label, x = embeddings()
    q = x[ids % 50 == 0]
    value = np.stack([np.abs(q @ damped_inverse(x[label % 8 == k]) @ x[label % 8 == k].T).max(1) for k in range(8)], axis=1)
    got = rows(spark, "sab_per_source_trak", "query_id")
    assert got.source.tolist() == [f"s{k}" for k in value.argmax(1)]
    np.testing.assert_allclose(got.value, value.max(1), atol=2e-6, rtol=1e-6)


def test_logistic_and_minibatch_descent(spark):
    li, x, y = lines()
    w = np.zeros(3)
    for _ in range(3):
        w -= 0.5 * ((sigmoid(x @ w) - y)[:, None] * x).mean(0)
    np.testing.assert_allclose(rows(spark, "logistic_descent", "i").weight, w, atol=2e-6)
    w, key = np.zeros(3), li.l_orderkey.to_numpy()
    for step in range(6):
        own = key % 3 == step % 3
        w -= 0.5 * ((sigmoid(x[own] @ w) - y[own])[:, None] * x[own]).mean(0)
    np.testing.assert_allclose(rows(spark, "minibatch_descent", "i").weight, w, atol=2e-6)


def test_subset_retraining(spark):
    li, x, y = lines()
    key = (li.l_orderkey * 10 + li.l_linenumber).to_numpy()
    got = rows(spark, "subset_retraining", "subset", "i").weight.to_numpy().reshape(4, 3)
    for subset in range(4):
        own, w = (key * 7919 + subset * 104729) % 1009 % 2 == 0, np.zeros(3)
        for _ in range(20):
            w -= 0.5 * ((sigmoid(x[own] @ w) - y[own])[:, None] * x[own]).mean(0)
        np.testing.assert_allclose(got[subset], w, atol=2e-6)


def test_kfac_whitened(spark):
    li, _, _ = lines()
    a = np.stack([li.l_quantity / 50.0, li.l_discount * 10.0], axis=1).astype(np.float64)
    g = np.stack([li.l_tax * 10.0, li.l_extendedprice / 100000.0, li.l_discount], axis=1).astype(np.float64)
    module, sample = np.where(li.l_suppkey % 2 == 0, "h.0.attn", "h.1.mlp"), (li.l_orderkey % 50).to_numpy()
    got = rows(spark, "kfac_whitened", "sample_index", "module", "o", "i")
    for m in ("h.0.attn", "h.1.mlp"):
        own = module == m
        left, right = sketch.inverse_root(g[own].T @ g[own]), sketch.inverse_root(a[own].T @ a[own])
        for s in np.unique(sample[own]):
            at = own & (sample == s)
            part = got[(got.module == m) & (got.sample_index == s)].value.to_numpy().reshape(3, 2)
            np.testing.assert_allclose(part, left @ (g[at].T @ a[at]) @ right, atol=2e-6)
    assert len(got) == 6 * len(set(zip(module.tolist(), sample.tolist(), strict=True)))


def test_lr_train(spark):
    ids, label, x = embeddings()
    y, train = (label == 3).astype(np.float64), ids * 48271 % 100 < 80
    hit = (fitted(x[train], y[train], 0.01)(x[~train]) == (y[~train] > 0)).mean()
    got = rows(spark, "lr_train", "n").iloc[0]
    assert got.n == (~train).sum() and abs(got.accuracy - hit) <= 2 / (~train).sum()


def test_shadow_mia(spark):
    d = pd.read_parquet(f"{SMALL}/documents.parquet").merge(pd.read_parquet(f"{SMALL}/labels.parquet"), on="doc_id")
    part = (d.n_chars % 97) / 97.0
    x, y, fit = np.stack([part * d.quality, part - 0.5], axis=1), d.quality.to_numpy().astype(np.float64), (d.doc_id % 2 == 0).to_numpy()
    hit = (fitted(x[fit], y[fit], 1e-3)(x[~fit]) == (y[~fit] > 0)).mean()
    got = rows(spark, "shadow_mia", "n").iloc[0]
    assert got.n == (~fit).sum() and abs(got.quality - min(1.0, 2 * (1 - hit))) <= 4 / (~fit).sum()
