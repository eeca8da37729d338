"""Estimators of a window's graph, in numpy: ridge autoregression, linear and Tucker-factored structure learning.

Convention: an entry [i, j] is the weight of the edge from i to j. Rows of X are times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def design(x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(X, lags): rows p.., and beside each the p rows before it, nearest first."""
    if p >= len(x):
        raise ValueError("the lag order must be less than the rows")
    return x[p:], np.concatenate([x[p - k : len(x) - k] for k in range(1, p + 1)], 1) if p else np.empty((len(x), 0))


def expm(m: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor sum, and squaring."""
    norm = float(np.abs(m).sum(0).max()) if m.size else 0.0
    squarings = max(0, int(np.ceil(np.log2(norm))) + 1) if norm > 0.5 else 0
    a, term, out = m / 2**squarings, np.eye(len(m)), np.eye(len(m))
    for k in range(1, 19):
        term = term @ a / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def acyclicity(w: np.ndarray) -> tuple[float, np.ndarray]:
    """h(W) = tr exp(W*W) - d, 0 just for acyclic graphs, and its gradient. A large W is scaled down by the sum of powers up to 3."""
    s = w * w
    if np.linalg.norm(s) > 10:
        two = s @ s
        return float(np.trace(s) + np.trace(two) / 2 + np.trace(two @ s) / 6), 2 * w * (np.eye(len(w)) + s + two / 2).T
    e = expm(s)
    return float(np.trace(e) - len(w)), 2 * w * e.T


class Adam:
    def __init__(self, lr: float, shapes):
        self.lr, self.t = lr, 0
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def step(self, params: list[np.ndarray], grads: list[np.ndarray], clip: float | None = 1.0) -> None:
        if clip is not None and (norm := np.sqrt(sum(float((g * g).sum()) for g in grads))) > clip:
            grads = [g * (clip / norm) for g in grads]
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.lr * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def ridge_var(x: np.ndarray, p: int, alpha=0.1) -> np.ndarray:
    """(p, d, d): ridge regression with an intercept of every variable on all lags."""
    y, lags = design(x, p)
    lc, yc = lags - lags.mean(0), y - y.mean(0)
    b = np.linalg.solve(lc.T @ lc + alpha * np.eye(lags.shape[1]), lc.T @ yc)
    return b.reshape(p, x.shape[1], x.shape[1])


@dataclass
class LinearFit:
    w: np.ndarray
    a: np.ndarray
    losses: list[float] = field(default_factory=list)
    h: float = 0.0
    state: dict = field(default_factory=dict)  # of the optimiser, to go on from
    log: list[tuple] = field(default_factory=list)  # (step, matrix, i, j, lag, value)


def dynotears(x: np.ndarray, p: int, lambda_w=0.1, lambda_a=0.1, steps=1000, lr: float | None = None, tabu: np.ndarray | None = None, warm: LinearFit | None = None, h_tol=1e-8, loss_tol=1e-6, rho_max=1e6, dual_every=50, log_every=0) -> LinearFit:
    """Linear structure learning: X = X W + lags A + noise, W acyclic by an augmented Lagrangian, L1 on both.

    Works on Gram matrices, so a step costs nothing in the length of the window. tabu: (p + 1, d, d) of forbidden edges,
    lag 0 first; they stay 0. Proximal steps set small weights to exact zeros. warm: a fit to go on from, with its state of the
    optimiser if it has one. log_every: steps between copies of the weights in the log.
    """
    from tidemark.operators.learn import learning_rate

    d = x.shape[1]
    y, lags = design(x, p)
    n = len(y)
    xx, xl, ll = y.T @ y / n, y.T @ lags / n, lags.T @ lags / n
    free = np.ones((p + 1, d, d)) if tabu is None else 1.0 - np.asarray(tabu, float)
    free[0] *= 1 - np.eye(d)
    free_a = free[1:].reshape(p * d, d) if p else np.zeros((0, d))
    w = (warm.w.copy() if warm else np.full((d, d), 1e-3)) * free[0]
    a = (warm.a.reshape(p * d, d).copy() if warm else np.full((p * d, d), 1e-3)) * free_a
    rate = lr or learning_rate(d)
    opt, alpha, rho, out, last = Adam(rate, [w.shape, a.shape]), 0.0, 1.0, LinearFit(w, a), np.inf
    if warm and warm.state:
        opt.t, alpha, rho = warm.state["t"], warm.state["alpha"], warm.state["rho"]
        opt.m, opt.v = [m.copy() for m in warm.state["m"]], [v.copy() for v in warm.state["v"]]
    for it in range(1, steps + 1):
        r_w, r_a = xx @ w + xl @ a - xx, xl.T @ w + ll @ a - xl.T
        h, gh = acyclicity(w)
        fit = 0.5 * float(np.trace(xx) + (w * (xx @ w)).sum() + (a * (ll @ a)).sum() + 2 * (w * (xl @ a)).sum() - 2 * (w * xx).sum() - 2 * (a * xl.T).sum())
        loss = fit + 0.5 * rho * h * h + alpha * h + lambda_w * np.abs(w).sum() + lambda_a * np.abs(a).sum()
        out.losses.append(loss)
        opt.step([w, a], [(r_w + (rho * h + alpha) * gh) * free[0], r_a * free_a])
        shrink = rate * 0.1
        w[:] = np.sign(w) * np.maximum(np.abs(w) - shrink * lambda_w, 0) * free[0]
        a[:] = np.sign(a) * np.maximum(np.abs(a) - shrink * lambda_a, 0) * free_a
        if log_every and it % log_every == 0:
            out.log += [(it, "W" if lag == 0 else "A", i, j, lag, v) for i, j, lag, v in edges_of(w, a.reshape(p, d, d))]
        if it % dual_every == 0:
            if abs(last - loss) <= loss_tol * max(1.0, abs(loss)) and abs(h) <= max(h_tol, 1e-8):
                break
            alpha, rho, last = alpha + rho * h, min(rho * 10, rho_max) if h > h_tol else rho, loss
    out.w, out.a, out.h = w, a.reshape(p, d, d), acyclicity(w)[0]
    out.state = {"t": opt.t, "alpha": alpha, "rho": rho, "m": opt.m, "v": opt.v}
    return out


def spline_basis(n: int, n_knots: int, degree=3) -> np.ndarray:
    """(n, n_knots + 2): clamped uniform cubic B-splines at n even places of [0, 1]; each row adds up to 1."""
    inner = np.linspace(0, 1, n_knots)
    knots = np.concatenate([np.zeros(degree), inner, np.ones(degree)])
    t = np.linspace(0, 1, n)[:, None]
    b = ((t >= knots[:-1]) & (t < knots[1:])).astype(float)
    b[-1, :] = 0
    b[-1, np.flatnonzero(knots[:-1] < knots[1:])[-1]] = 1
    for k in range(1, degree + 1):
        left, right = knots[k:-1] - knots[: -k - 1], knots[k + 1 :] - knots[1:-k]
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.where(left > 0, (t - knots[: -k - 1]) / left, 0)
            v = np.where(right > 0, (knots[k + 1 :] - t) / right, 0)
        b = u * b[:, :-1] + v * b[:, 1:]
    return b


def second_differences(k: int) -> np.ndarray:
    d = np.diff(np.eye(k), 2, axis=0)
    return d.T @ d


@dataclass
class TuckerModel:
    """W[i,j,k] = G x U1[i] x U2[j] x U3[k], A[i,j,l,k] = H x V1[i] x V2[j] x V3[l] x V4[k]; k runs over spline functions of time."""

    u: list[np.ndarray]
    g: np.ndarray
    v: list[np.ndarray]
    h: np.ndarray

    @classmethod
    def random(cls, d: int, p: int, k: int, rank_w=4, rank_a=3, scale=0.1, seed=0) -> TuckerModel:
        rng = np.random.default_rng(seed)
        rw, ra, rp, rk = min(rank_w, d), min(rank_a, d), min(rank_a, max(p, 1)), min(rank_w, k)
        f = lambda *s: scale * rng.standard_normal(s)
        return cls([f(d, rw), f(d, rw), f(k, rk)], f(rw, rw, rk), [f(d, ra), f(d, ra), f(max(p, 1), rp), f(k, rk)], f(ra, ra, rp, rk))

    def params(self) -> list[np.ndarray]:
        return [*self.u, self.g, *self.v, self.h]

    def w(self) -> np.ndarray:
        return np.einsum("abc,ia,jb,kc->ijk", self.g, *self.u, optimize=True)

    def a(self) -> np.ndarray:
        return np.einsum("abec,ia,jb,le,kc->ijlk", self.h, *self.v, optimize=True)

    def mean_w(self) -> np.ndarray:
        """Mean over k first: the d x d x K tensor is never made."""
        return np.einsum("abc,ia,jb,c->ij", self.g, self.u[0], self.u[1], self.u[2].mean(0), optimize=True)

    def mean_a(self) -> np.ndarray:
        return np.einsum("abec,ia,jb,le,c->ijl", self.h, self.v[0], self.v[1], self.v[2], self.v[3].mean(0), optimize=True)

    def rows_of_w(self, low: int, high: int) -> np.ndarray:
        return np.einsum("abc,ia,jb,kc->ijk", self.g, self.u[0][low:high], self.u[1], self.u[2], optimize=True)

    def forward(self, x: np.ndarray, lags: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Predictions by contractions of low rank, O(n d r); lags: (n, p, d). Own instantaneous effects are taken out."""
        m = np.einsum("na,nc,abc->nb", x @ self.u[0], basis @ self.u[2], self.g, optimize=True)
        own = np.einsum("abc,ia,ib,nc->ni", self.g, self.u[0], self.u[1], basis @ self.u[2], optimize=True)
        z = np.einsum("nld,da,le->nae", lags, self.v[0], self.v[2][: lags.shape[1]], optimize=True)
        q = np.einsum("nae,nc,abec->nb", z, basis @ self.v[3], self.h, optimize=True)
        return m @ self.u[1].T - x * own + q @ self.v[1].T


def tucker_loss(model: TuckerModel, x: np.ndarray, lags: np.ndarray, basis: np.ndarray, lambda_w=1e-3, lambda_a=1e-3, smooth=1e-3, core=1e-3, orth=1e-3, alpha=0.0, rho=1.0) -> tuple[float, list[np.ndarray], float, float]:
    """Loss, gradients of all factors and cores, h, and the plain mean squared error.

    Everything is differentiated on the dense tensors of the window and carried to the factors by contractions.
    """
    d, k = x.shape[1], basis.shape[1]
    w, a = model.w() * (1 - np.eye(d))[:, :, None], model.a()
    pred = np.einsum("ni,nk,ijk->nj", x, basis, w, optimize=True) + np.einsum("nli,nk,ijlk->nj", lags, basis, a, optimize=True)
    e = pred - x
    mse = float((e * e).mean())
    de = 2 * e / e.size
    gw = np.einsum("ni,nk,nj->ijk", x, basis, de, optimize=True)
    ga = np.einsum("nli,nk,nj->ijlk", lags, basis, de, optimize=True)
    mean = w.mean(2)
    h, gh = acyclicity(mean)
    dw, da = np.diff(w, axis=2), np.diff(a, axis=3)
    loss = mse + lambda_w * np.abs(w).sum() + lambda_a * np.abs(a).sum() + smooth * ((dw * dw).sum() + (da * da).sum()) / k**2 + alpha * h + 0.5 * rho * h * h
    gw += lambda_w * np.sign(w) + ((alpha + rho * h) * gh / k)[:, :, None]
    ga += lambda_a * np.sign(a)
    for grad, diff, axis in ((gw, dw, 2), (ga, da, 3)):
        pad = np.zeros_like(np.take(diff, [0], axis)) if diff.shape[axis] else np.zeros(grad.shape)
        if diff.shape[axis]:
            grad += 2 * smooth / k**2 * (np.concatenate([pad, diff], axis) - np.concatenate([diff, pad], axis))
    gw *= (1 - np.eye(d))[:, :, None]
    u, g, v, c = model.u, model.g, model.v, model.h
    grads = [
        np.einsum("ijk,abc,jb,kc->ia", gw, g, u[1], u[2], optimize=True), np.einsum("ijk,abc,ia,kc->jb", gw, g, u[0], u[2], optimize=True),
        np.einsum("ijk,abc,ia,jb->kc", gw, g, u[0], u[1], optimize=True), np.einsum("ijk,ia,jb,kc->abc", gw, *u, optimize=True),
        np.einsum("ijlk,abec,jb,le,kc->ia", ga, c, v[1], v[2], v[3], optimize=True), np.einsum("ijlk,abec,ia,le,kc->jb", ga, c, v[0], v[2], v[3], optimize=True),
        np.einsum("ijlk,abec,ia,jb,kc->le", ga, c, v[0], v[1], v[3], optimize=True), np.einsum("ijlk,abec,ia,jb,le->kc", ga, c, v[0], v[1], v[2], optimize=True),
        np.einsum("ijlk,ia,jb,le,kc->abec", ga, *v, optimize=True),
    ]
    params = model.params()
    for n in (3, 8):  # cores
        loss += core * float(np.abs(params[n]).mean())
        grads[n] = grads[n] + core * np.sign(params[n]) / params[n].size
    factors = (0, 1, 2, 4, 5, 6, 7)
    for n in factors:
        f = params[n]
        off = f.T @ f - np.eye(f.shape[1])
        loss += orth * float((off * off).sum()) / len(factors)
        grads[n] = grads[n] + orth * 4 * f @ off / len(factors)
    return float(loss), grads, h, mse


def tucker_fit(x: np.ndarray, p: int, n_knots=5, rank_w=4, rank_a=3, steps=100, lr=0.01, seed=0, h_tol=1e-8, plateau=5e-4, **penalties) -> tuple[TuckerModel, list[float]]:
    """Adam on the penalised loss. Ends when the graph is acyclic and the loss has been flat twice; the dual weight
    grows tenfold where h doesn't fall to a quarter."""
    y, flat = design(x, p)
    lags = flat.reshape(len(y), p, x.shape[1])
    basis = spline_basis(len(y), n_knots)
    model = TuckerModel.random(x.shape[1], p, basis.shape[1], rank_w, rank_a, seed=seed)
    opt, alpha, rho, last_h, losses, flat_for = Adam(lr, [q.shape for q in model.params()]), 0.0, 1.0, np.inf, [], 0
    for it in range(steps):
        loss, grads, h, _ = tucker_loss(model, y, lags, basis, alpha=alpha, rho=rho, **penalties)
        losses.append(loss)
        flat_for = flat_for + 1 if it >= 3 and abs(losses[-2] - loss) / max(abs(losses[-2]), 1e-12) < plateau else 0
        if it and abs(h) <= h_tol and flat_for >= 2:
            break
        opt.step(model.params(), grads, None)
        if it % 10 == 9:
            rho = min(rho * 10, 1e10) if h > 0.25 * last_h else rho
            alpha, last_h = alpha + rho * h, h
    return model, losses


def edges_of(w: np.ndarray, a: np.ndarray, least=0.0) -> list[tuple[int, int, int, float]]:
    """(i, j, lag, weight) above the threshold; at lag 0 without the diagonal. a: (p, d, d)."""
    out = []
    for lag, m in enumerate([w, *a]):
        for i, j in zip(*np.nonzero(np.abs(m) > least), strict=True):
            if lag or i != j:
                out.append((int(i), int(j), lag, float(m[i, j])))
    return out


def ridge_kernel(p: int, alpha=0.1, least=0.01):
    return lambda x: edges_of(np.zeros((x.shape[1],) * 2), ridge_var(x, p, alpha), least)


def dynotears_kernel(p: int, least=0.01, **options):
    def fit(x):
        f = dynotears(x, p, **options)
        return edges_of(f.w, f.a, least)

    return fit


def tucker_kernel(p: int, least=0.01, **options):
    def fit(x):
        model, _ = tucker_fit(x, p, **options)
        d = x.shape[1]
        return edges_of(model.mean_w() * (1 - np.eye(d)), np.moveaxis(model.mean_a(), 2, 0)[:p], least)

    return fit


def calibrate(x: np.ndarray, p: int, grid: list[tuple[float, float]], rows=300, eps=1e-4, **options) -> list[tuple[float, float, int]]:
    """(lambda_w, lambda_a, edges) for each pair, on the first rows of the series in a block."""
    out = []
    for lw, la in grid:
        f = dynotears(x[:rows], p, lw, la, **options)
        out.append((lw, la, int((np.abs(f.w) > eps).sum() + (np.abs(f.a) > eps).sum())))
    return out


def random_dag(d: int, rng: np.random.Generator, share=0.15, low=0.3, high=0.8) -> np.ndarray:
    """Weights of an acyclic graph: edges of a random upper triangle."""
    sign = rng.choice([-1.0, 1.0], (d, d))
    return np.triu(rng.random((d, d)) < share, 1) * rng.uniform(low, high, (d, d)) * sign


def synthetic_dbn(n: int, d: int, p=2, seed=0, lag_share=0.1, noise=0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X, W, A): tanh of instantaneous and lagged effects, and noise."""
    rng = np.random.default_rng(seed)
    w, a = random_dag(d, rng), np.stack([(rng.random((d, d)) < lag_share) * rng.uniform(-0.5, 0.5, (d, d)) for _ in range(p)])
    x = np.zeros((n + p, d))
    x[:p] = rng.standard_normal((p, d))
    for t in range(p, n + p):
        base = sum(x[t - k - 1] @ a[k] for k in range(p)) + noise * rng.standard_normal(d)
        for j in range(d):
            x[t, j] = np.tanh(base[j] + x[t] @ w[:, j])
    return x[p:], w, a
