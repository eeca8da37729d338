import math

import numpy as np
import pytest

from tidemark.functions import kernels as k
from tidemark.functions import stats as s


def test_spline_basis_is_a_partition_of_unity():
    b = k.spline_basis(40, 5)
    assert b.shape == (40, 7) and np.allclose(b.sum(1), 1) and (b >= -1e-12).all()


def test_expm_and_acyclicity():
    m = np.array([[0.0, 1.0], [0.0, 0.0]])
    assert np.allclose(k.expm(m), [[1, 1], [0, 1]])
    assert k.acyclicity(np.triu(np.ones((4, 4)), 1))[0] == pytest.approx(0, abs=1e-12)
    w = np.array([[0, 0.5], [0.5, 0]])
    h, g = k.acyclicity(w)
    e = 1e-6
    up = w.copy()
    up[0, 1] += e
    assert h > 0 and (k.acyclicity(up)[0] - h) / e == pytest.approx(g[0, 1], rel=1e-3)


def test_ridge_agrees_with_least_squares_on_augmented_rows():
    x = np.random.default_rng(1).standard_normal((60, 3))
    y, lags = k.design(x, 2)
    a = np.vstack([lags - lags.mean(0), math.sqrt(0.1) * np.eye(6)])
    b = np.vstack([y - y.mean(0), np.zeros((6, 3))])
    assert np.allclose(k.ridge_var(x, 2).reshape(6, 3), np.linalg.lstsq(a, b, rcond=None)[0])


def test_dynotears_finds_a_chain_and_keeps_tabu_edges_at_zero():
    rng = np.random.default_rng(2)
    x = np.zeros((800, 3))
    for t in range(800):
        x[t, 0] = rng.standard_normal()
        x[t, 1] = 0.9 * x[t, 0] + rng.standard_normal()
        x[t, 2] = 0.9 * x[t, 1] + rng.standard_normal()
    fit = k.dynotears(x, 1, 0.05, 0.05, steps=1500)
    strong = {(i, j) for i, j, lag, w in k.edges_of(fit.w, fit.a, 0.3) if lag == 0}
    assert strong == {(0, 1), (1, 2)} and abs(fit.h) < 1e-3 and fit.losses[-1] < fit.losses[0]
    assert (np.diag(fit.w) == 0).all()
    tabu = np.zeros((2, 3, 3))
    tabu[0, 0, 1] = 1
    assert k.dynotears(x, 1, 0.05, 0.05, steps=50, tabu=tabu).w[0, 1] == 0


def test_tucker_gradients_against_differences():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 4))
    y, flat = k.design(x, 2)
    lags, basis, model = flat.reshape(len(y), 2, 4), k.spline_basis(len(y), 5), k.TuckerModel.random(4, 2, 7, 3, 2, 0.5, 1)
    options = {"alpha": 0.3, "rho": 2.0, "lambda_w": 0.01, "lambda_a": 0.01, "smooth": 0.5, "core": 0.1, "orth": 0.1}
    _, grads, _, _ = k.tucker_loss(model, y, lags, basis, **options)
    for p, g in zip(model.params(), grads, strict=True):
        at = tuple(d // 2 for d in p.shape)
        old, losses = p[at], []
        for e in (1e-6, -1e-6):
            p[at] = old + e
            losses.append(k.tucker_loss(model, y, lags, basis, **options)[0])
        p[at] = old
        assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(g[at], abs=1e-6)
    w = model.w() * (1 - np.eye(4))[:, :, None]
    dense = np.einsum("ni,nk,ijk->nj", y, basis, w) + np.einsum("nli,nk,ijlk->nj", lags, basis, model.a())
    assert np.allclose(dense, model.forward(y, lags, basis))
    assert np.allclose(model.mean_w(), model.w().mean(2)) and np.allclose(model.rows_of_w(1, 3), model.w()[1:3])


def test_tucker_fit_lowers_the_loss():
    x, *_ = k.synthetic_dbn(100, 4, 1, seed=3)
    _, losses = k.tucker_fit(x, 1, steps=60)
    assert losses[-1] < losses[0]


def test_unit_roots_and_levels():
    rng = np.random.default_rng(5)
    noise, walk = rng.standard_normal(600), np.cumsum(rng.standard_normal(600))
    assert s.adf(noise)[1] < 0.01 < s.kpss(noise)[1] and s.adf(walk)[1] > 0.05 and s.kpss(walk)[1] < 0.05
    assert s.stationarity(np.ones(50)) == (None, None)


def test_optimal_lag_edges():
    rng = np.random.default_rng(6)
    assert s.optimal_lag(np.ones(100)) == 1 and s.optimal_lag(np.arange(5.0)) == 1
    assert s.optimal_lag(rng.standard_normal(2000), relog=False) == 1
    y = np.zeros(4000)
    for t in range(3, 4000):
        y[t] = 0.6 * y[t - 3] + rng.standard_normal()
    assert s.optimal_lag(y, relog=False) == 3


def test_chi2_tail():
    assert s.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)


def test_lag_order_must_be_less_than_the_rows():
    with pytest.raises(ValueError):
        k.design(np.zeros((3, 2)), 3)


def test_a_fit_goes_on_from_its_state():
    x, *_ = k.synthetic_dbn(200, 3, 1, seed=8)
    whole = k.dynotears(x, 1, steps=40)
    half = k.dynotears(x, 1, steps=20, log_every=10)
    rest = k.dynotears(x, 1, steps=20, warm=half)
    assert np.allclose(whole.w, rest.w) and np.allclose(whole.a, rest.a) and {r[0] for r in half.log} == {10, 20}
