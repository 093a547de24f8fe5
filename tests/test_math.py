"""Driver-side mathematics against definitions, brute force and finite differences."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varlens.functions import numeric
from varlens.functions.basis import BASES, basis_batch, basis_size, derivative_energy, gram, penalty
from varlens.operators import ridge, selection, sensitivity
from varlens.operators.discovery import projection_score, recommend_basis
from varlens.operators.residual import Features, kernel
from varlens.operators.stats import of_batch
from varlens.plans.layout import Layout, first_try, pairs_of, triples_of


@pytest.mark.parametrize("basis", BASES)
@pytest.mark.parametrize("k", [1, 2, 4])
def test_gram_is_the_integral(basis, k):
    n = 1 << 14
    b = basis_batch((np.arange(n) + 0.5) / n, k, basis)
    assert b.shape[1] == basis_size(k, basis)
    assert np.allclose(b.T @ b / n, gram(k, basis), atol=1e-6)
    assert np.allclose(b.mean(axis=0), 0, atol=1e-7)


@pytest.mark.parametrize("basis", ["fourier", "legendre"])
@pytest.mark.parametrize("p", [1, 2])
def test_derivative_energy(basis, p):
    x = np.linspace(0, 1, 20_001)
    d = basis_batch(x, 3, basis)
    for _ in range(p):
        d = np.gradient(d, x, axis=0, edge_order=2)
    got = ((d[1:] ** 2 + d[:-1] ** 2) / 2).mean(axis=0)
    assert np.allclose(got, derivative_energy(3, p, basis), rtol=1e-3, atol=1e-3)


def test_haar_edges():
    x = np.array([0.0, 0.25, 0.5, 0.75, 1.0])
    b = basis_batch(x, 2, "haar")
    r = math.sqrt(2)
    assert np.allclose(b, [[1, r, 0], [1, -r, 0], [-1, 0, r], [-1, 0, -r], [-1, 0, -r]])


def test_penalties():
    assert np.allclose(penalty(1, 2.0, "curvature"), [2e-6, (2 * math.pi) ** 4, (2 * math.pi) ** 4])
    assert np.allclose(penalty(2, 1.0, "sobolev_2", "legendre"), [9, 49])
    assert np.allclose(penalty(2, 1.0, "spectral_3", "haar"), [1, 8, 8])
    with pytest.raises(ValueError):
        penalty(1, 1.0, "other")
    pair = Layout.build(["a", "b"], 1, 1).terms[2]
    one = penalty(1, 0.5, "smoothness", order=2)
    assert np.allclose(pair.penalty(0.5, "smoothness"), np.add.outer(one, one).ravel())


def test_layout():
    lay = Layout.build(["a", "b", "c"], 2, 1, 1, pairs=[(0, 2)], triples=[(0, 1, 2)])
    assert [t.vars for t in lay.terms] == [(0,), (1,), (2,), (0, 2), (0, 1, 2)]
    assert lay.size == 3 * 5 + 9 + 27
    x = np.random.default_rng(0).random((5, 3))
    phi = lay.batch(x)
    a, c = basis_batch(x[:, 0], 1), basis_batch(x[:, 2], 1)
    assert np.allclose(phi[:, lay.block(3)], np.einsum("ni,nj->nij", a, c).reshape(5, -1))
    less, at = lay.select([0, 3])
    assert np.allclose(less.batch(x), phi[:, at])
    assert pairs_of(4, [1], "either") == [(0, 1), (1, 2), (1, 3)] and pairs_of(4, [1, 3], "both") == [(1, 3)]
    assert len(triples_of(5)) == 10 and triples_of(4, [0, 1], "two_active") == [(0, 1, 2), (0, 1, 3)]
    plan = first_try(10_000, 5)
    assert plan["columns"] <= 1000 and plan["k1"] >= 2


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_ridge_against_matrices(seed):
    rng = np.random.default_rng(seed)
    n, f = 60, 5
    phi, y = rng.normal(size=(n, f)), rng.normal(size=n)
    r = rng.uniform(0.1, 3, f)
    y = y - y.mean()
    s = ridge.solve(of_batch(phi, y), r)
    a = phi.T @ phi + np.diag(r)
    hat = phi @ np.linalg.solve(a, phi.T)
    assert np.allclose(s.w, np.linalg.solve(a, phi.T @ y))
    assert s.df == pytest.approx(np.trace(hat)) and s.tr_h2 == pytest.approx(np.trace(hat @ hat))
    assert s.rss == pytest.approx(((y - phi @ s.w) ** 2).sum())
    k = np.eye(n) + phi @ np.diag(1 / r) @ phi.T
    ytr = y @ np.linalg.solve(k, y)
    want = -n / 2 * math.log(ytr / n) - 0.5 * np.linalg.slogdet(k)[1] - n / 2 * (1 + math.log(2 * math.pi))
    assert s.evidence == pytest.approx(want)


def test_eigen_path_is_the_solution():
    rng = np.random.default_rng(1)
    phi, y = rng.normal(size=(80, 6)), rng.normal(size=80)
    s, shape = of_batch(phi, y - y.mean()), rng.uniform(0.5, 2, 6)
    e = ridge.EigenPath(s, shape)
    for lam in (1e-3, 1.0, 50.0):
        a, b = e.at(lam), ridge.solve(s, lam * shape)
        assert np.allclose(e.weights(lam), b.w)
        for k in ("df", "tr_h2", "rss", "gcv", "aic", "bic", "evidence", "sigma2"):
            assert a[k] == pytest.approx(getattr(b, k))


@pytest.mark.parametrize("criterion", ["gcv", "aic", "bic", "evidence"])
def test_criterion_gradients(criterion):
    rng = np.random.default_rng(2)
    phi = rng.normal(size=(90, 8))
    y = phi[:, 0] + rng.normal(size=90)
    s = of_batch(phi, y - y.mean())
    shapes = [np.r_[np.ones(4), np.zeros(4)], np.r_[np.zeros(4), np.ones(4)]]
    x = np.array([-1.0, 0.5])
    _, g = ridge.criterion_gradient(s, shapes, x, criterion)
    for i in range(2):
        d = np.eye(2)[i] * 1e-5
        num = (ridge.criterion_gradient(s, shapes, x + d, criterion)[0] - ridge.criterion_gradient(s, shapes, x - d, criterion)[0]) / 2e-5
        assert g[i] == pytest.approx(num, rel=1e-4, abs=1e-6)
    best = ridge.best_lambdas(s, shapes, criterion)
    grid = [ridge.criterion_gradient(s, shapes, np.array([a, b]), criterion)[0] for a in np.linspace(-6, 3, 12) for b in np.linspace(-6, 3, 12)]
    value = -best[criterion] if criterion == "evidence" else best[criterion]
    assert value <= min(grid) + 1e-4 * abs(min(grid))


def test_folds_by_subtraction():
    from varlens.operators.rows import kfold

    rng = np.random.default_rng(3)
    phi, y = rng.normal(size=(100, 4)), rng.normal(size=100)
    fold = np.arange(100) % 5
    got = kfold({k: of_batch(phi[fold == k], y[fold == k]) for k in range(5)}, np.full(4, 0.7))
    for k in range(5):
        a, b = phi[fold != k], y[fold != k]
        w = np.linalg.solve(a.T @ a + 0.7 * np.eye(4), a.T @ (b - b.mean()))
        assert got[k]["mse"] == pytest.approx(((y[fold == k] - b.mean() - phi[fold == k] @ w) ** 2).mean(), rel=1e-8)


def test_sparse_solvers():
    rng = np.random.default_rng(4)
    phi = rng.normal(size=(200, 9))
    y = phi[:, :3] @ [2, -1, 1] + 0.1 * rng.normal(size=200)
    s = of_batch(phi, y - y.mean())
    blocks = [slice(0, 3), slice(3, 6), slice(6, 9)]
    w = selection.lasso(s, np.zeros(9), 0.1)
    assert set(np.flatnonzero(w)) == {0, 1, 2}
    w = selection.group_lasso(s, np.full(9, 1e-6), blocks, 0.1)
    assert selection.sparsity(w, blocks)["groups_on"] == 1
    assert selection.by_glasso(s, np.full(9, 1e-6), blocks) == [0]
    assert [x["group"] for x in selection.by_bic(s, np.full(9, 1e-6), blocks) if x["selected"]] == [0]
    w = selection.group_lasso(s, np.full(9, 1e-6), blocks, 0.1, mix=0.5)
    assert np.abs(w[3:]).max() == 0
    folds = {k: of_batch(phi[k::5], y[k::5]) for k in range(5)}
    assert 0 in selection.by_one_se(folds, np.ones(9), blocks)["active"]
    # The rule keeps a block above its noise level sigma^2 B / n, which an inactive one exceeds as chi^2 with 3 degrees exceeds 3: 39 %.
    kept = []
    for seed in range(60):
        r = np.random.default_rng(seed)
        phi = r.normal(size=(200, 9))
        y = phi[:, :3] @ [2, -1, 1] + 0.1 * r.normal(size=200)
        on = selection.by_one_se({k: of_batch(phi[k::5], y[k::5]) for k in range(5)}, np.ones(9), blocks)["active"]
        assert 0 in on
        kept += [1 in on, 2 in on]
    assert abs(np.mean(kept) - 0.39) < 0.15
    assert selection.active_variables({0: 0.9, 1: 0.05, 2: 0.001}, 0.01) == [0, 1]


def test_shares_and_intervals():
    lay = Layout.build(["x"], 3)
    w = np.zeros(lay.size)
    w[0], w[2] = 4.0, 2.0
    v = sensitivity.block_variances(lay, w)[0]
    assert v == pytest.approx(4 / 3 + 2 - 8 / math.pi)
    lay = Layout.build(["a", "b"], 1, basis="legendre")
    got = sensitivity.share_intervals(lay, np.array([1.0, 0.5]), 1e-4 * np.eye(2), 100.0)
    rng = np.random.default_rng(5)
    draws = np.array([1.0, 0.5]) + 1e-2 * rng.normal(size=(200_000, 2))
    s = draws[:, 0] ** 2 / (draws**2).sum(axis=1)
    assert got[0]["se"] == pytest.approx(s.std(), rel=0.02)
    assert got[0]["status"] == "regular"
    assert sensitivity.share_intervals(lay, np.array([1.0, 0.0]), np.eye(2), 10)[1]["status"] == "nonregular_null"
    f = sensitivity.frequencies(Layout.build(["x"], 3), np.arange(7.0), 0)
    assert sum(r["variance"] for r in f) == pytest.approx(np.arange(7.0) @ gram(3) @ np.arange(7.0))


def test_numeric():
    assert numeric.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert numeric.t_quantile(0.025, 3) == pytest.approx(-3.182446305, abs=1e-8)
    assert numeric.t_quantile(0.975, math.inf) == pytest.approx(1.959963985, abs=1e-8)
    assert numeric.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)
    assert numeric.minimise_scalar(lambda x: (x - 0.3) ** 2, -1, 2)[0] == pytest.approx(0.3, abs=1e-6)
    x, _ = numeric.minimise(lambda x: ((x[0] - 1) ** 2 + 10 * (x[1] + 2) ** 2, np.array([2 * (x[0] - 1), 20 * (x[1] + 2)])), [0, 0], [-5, -1], [5, 5])
    assert np.allclose(x, [1, -1], atol=1e-5)
    h = numeric.halton(4096, 3)
    assert np.allclose(h.mean(axis=0), 0.5, atol=1e-3)


def test_features_and_scores():
    rng = np.random.default_rng(6)
    x = rng.random((50, 2))
    f = Features.nystrom(x[:10], 0.4)
    k = kernel(((x[:10, None] - x[None, :10]) ** 2).sum(-1), 0.4)
    assert np.allclose(f.batch(x[:10]) @ f.batch(x[:10]).T, k, atol=1e-5)
    z = Features.random_fourier(2, 4000, 0.5).batch(x[:5])
    assert np.allclose(z @ z.T, kernel(((x[:5, None] - x[None, :5]) ** 2).sum(-1), 0.5), atol=0.05)
    phi = rng.normal(size=(500, 4))
    assert projection_score(of_batch(phi, phi @ np.ones(4))) == pytest.approx(1 - 4 / 500, abs=1e-6)
    assert projection_score(of_batch(phi, rng.normal(size=500))) < 0.02
    assert recommend_basis(0, 0, 0) == "none" and recommend_basis(0.2, 0.7, 0.01) == "fourier"
