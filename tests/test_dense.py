"""Dense solves against numpy, and the conditions that their optima must meet."""

from __future__ import annotations

import numpy as np
import pytest

from panelwright.operators import matrix, regress

NAMES = ["A", "B", "C", "D", "E"]


def covariance(seed, n=5, rank=5):
    x = np.random.default_rng(seed).normal(size=(n, rank))
    return x @ x.T / 100


def upper(m, *key):
    return [(*key, NAMES[i], NAMES[j], float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))]


def test_covariance_diagnostics_equal_numpy(spark):
    ms = {"full": covariance(1), "thin": covariance(2, rank=2), "bent": covariance(3) - np.eye(5) * 0.02}
    df = spark.createDataFrame([r for k, m in ms.items() for r in upper(m, k)], "estimator string, a string, b string, cov double")
    got = {r.estimator: r for r in matrix.covariance_diagnostics(df).collect()}
    assert set(got) == set(ms)
    for k, m in ms.items():
        e = np.linalg.eigvalsh(m)
        p = e.clip(0) / e.clip(0).sum()
        p = p[p > 1e-15]
        assert (got[k].min_eigen, got[k].max_eigen) == (pytest.approx(e[0], abs=1e-12), pytest.approx(e[-1], rel=1e-9))
        assert got[k].rank == (e > 1e-12).sum() == {"full": 5, "thin": 2, "bent": 3}[k]  # eigenvalues above the tolerance
        assert got[k].is_psd == (k != "bent")
        assert got[k].entropy_rank == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-6)


def test_equal_risk_contributions(spark):
    m = covariance(4) + np.eye(5) * 0.01
    members = spark.createDataFrame([("p", x) for x in NAMES] + [("q", x) for x in "ACE"] + [("one", "B")], "portfolio_id string, symbol string")
    rows = matrix.allocate_erc(spark.createDataFrame(upper(m), "a string, b string, cov double"), members).collect()
    for p, own in {"p": NAMES, "q": list("ACE"), "one": ["B"]}.items():
        w = {r.symbol: r.weight for r in rows if r.portfolio_id == p}
        assert sorted(w) == own and sum(w.values()) == pytest.approx(1) and min(w.values()) > 0
        at = [NAMES.index(x) for x in own]
        x = np.array([w[NAMES[i]] for i in at])
        share = x * (m[np.ix_(at, at)] @ x)
        assert np.allclose(share / share.sum(), 1 / len(own), atol=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_style_weights_meet_the_conditions_of_the_optimum(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 4))
    y = x @ np.array([0.7, 0.5, -0.2, 0.0]) + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([("p", float(b), *map(float, a)) for a, b in zip(x, y, strict=True)] + [("few", 1.0, 1.0, 0.0, 0.0, 0.0)], "portfolio_id string, y double, a double, b double, c double, d double")
    (r,) = regress.style_weights(df, ("a", "b", "c", "d")).collect()
    w = np.array([r.w_a, r.w_b, r.w_c, r.w_d])
    slope = x.T @ (x @ w - y)
    level = slope[w > 1e-9].mean()
    assert r.portfolio_id == "p" and r.n == 40 and w.sum() == pytest.approx(1) and w.min() >= -1e-12
    assert np.allclose(slope[w > 1e-9], level, atol=1e-6) and (slope[w <= 1e-9] >= level - 1e-6).all()
    assert r.sse == pytest.approx(((x @ w - y) ** 2).sum(), rel=1e-6)


def test_cluster_summary(spark):
    rho = [("A", "B", 0.9), ("A", "C", 0.5), ("B", "C", 0.4), ("C", "D", 0.8), ("D", "E", -0.1)]
    clusters = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("D", 2), ("E", 2)], "symbol string, cluster_id int")
    got = matrix.cluster_summary(spark.createDataFrame(rho, "a string, b string, rho double"), clusters).collect()
    assert sorted((r.cluster_id, r.n_pairs, r.low, pytest.approx(r.mean), r.high) for r in got) == [(1, 3, 0.4, pytest.approx(0.6), 0.9), (2, 1, -0.1, pytest.approx(-0.1), -0.1)]
