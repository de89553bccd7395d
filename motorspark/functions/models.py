"""Model fits of one group, in numpy."""

from __future__ import annotations

import math

import numpy as np


def folds(n: int, k: int, seed: int = 0) -> np.ndarray:
    """A shuffled fold number for each of n items."""
    order = np.random.default_rng(seed).permutation(n)
    out = np.empty(n, int)
    out[order] = np.arange(n) % k
    return out


def stratified_folds(labels: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    out = np.empty(len(labels), int)
    for c in np.unique(labels):
        at = np.flatnonzero(labels == c)
        out[at] = folds(len(at), k, seed)
    return out


def standardise(train: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Columns to mean 0 and population deviation 1 by the first; constant columns keep their scale."""
    m, s = train.mean(0), train.std(0)
    s = np.where(s > 0, s, 1.0)
    return [(x - m) / s for x in (train, *others)]


def pca(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, components and explained shares of z-scored columns; a component's largest weight is positive."""
    z = standardise(x)[0]
    _, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    vt = vt[:n] * np.sign(vt[np.arange(min(n, len(vt))), np.abs(vt[:n]).argmax(1)])[:, None]
    total = (s**2).sum()
    return z @ vt.T, vt, (s[:n] ** 2) / total if total > 0 else np.zeros(min(n, len(s)))


def dpca(full: np.ndarray, marginal: np.ndarray, n: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Decoder and encoder of a marginalisation (variables x samples): reduced-rank regression of it on the data."""
    g = full @ full.T
    a = marginal @ full.T @ np.linalg.inv(g + ridge * np.trace(g) / len(g) * np.eye(len(g)))
    u, _, _ = np.linalg.svd(a @ full, full_matrices=False)
    u = u[:, :n]
    return u.T @ a, u


def poisson_fit(x: np.ndarray, y: np.ndarray, alpha: float = 1e-4, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of min mean(mu - y log mu) + alpha / 2 |w|^2, by Newton steps with halving."""
    n, d = x.shape
    a = np.concatenate((np.ones((n, 1)), x), 1)
    pen = np.full(d + 1, alpha)
    pen[0] = 0.0
    b = np.zeros(d + 1)
    b[0] = math.log(max(y.mean(), 1e-9))

    def loss(b: np.ndarray) -> float:
        eta = np.clip(a @ b, -50, 50)
        return float((np.exp(eta) - y * eta).mean() + (pen * b * b).sum() / 2)

    now = loss(b)
    for _ in range(steps):
        mu = np.exp(np.clip(a @ b, -50, 50))
        grad = a.T @ (mu - y) / n + pen * b
        step = np.linalg.solve((a * mu[:, None]).T @ a / n + np.diag(pen) + 1e-10 * np.eye(d + 1), grad)
        size = 1.0
        while size > 1e-8 and (new := loss(b - size * step)) > now:
            size /= 2
        if size <= 1e-8 or now - new < 1e-12:
            break
        b, now = b - size * step, new
    return float(b[0]), b[1:]


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.01, sweeps: int = 200) -> np.ndarray:
    """Weights of min |y - x w|^2 / 2n + alpha |w|_1 on standardised x, by coordinate descent."""
    z, t = standardise(x)[0], y - y.mean()
    w, r, n = np.zeros(z.shape[1]), t.copy(), len(t)
    square = (z * z).sum(0) / n
    for _ in range(sweeps):
        most = 0.0
        for j in np.flatnonzero(square > 0):
            rho = z[:, j] @ r / n + square[j] * w[j]
            new = math.copysign(max(abs(rho) - alpha, 0), rho) / square[j]
            r += z[:, j] * (w[j] - new)
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most < 1e-8:
            break
    return w


def deviance(y: np.ndarray, mu: np.ndarray) -> float:
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(y > 0, y * np.log(y / mu), 0.0)
    return float((t - (y - mu)).sum())


def strongest(x: np.ndarray, y: np.ndarray, most: int | None, alpha: float = 0.01) -> np.ndarray:
    """The columns with the ``most`` largest lasso weights on the root of y, in their order; all without a limit below their number."""
    if not most or most >= x.shape[1]:
        return np.arange(x.shape[1])
    weight = np.abs(lasso(x, np.sqrt(np.maximum(y, 0)), alpha))
    return np.sort(np.argsort(-weight, kind="stable")[:most])


def poisson_pr2(y: np.ndarray, mu: np.ndarray) -> float:
    """1 - deviance / deviance of the mean of y; NaN where y is constant."""
    d0 = deviance(y, np.full(len(y), y.mean())) if len(y) and y.min() < y.max() else 0.0
    return 1 - deviance(y, np.maximum(mu, 1e-9)) / d0 if d0 > 0 else math.nan


def poisson_cv(x: np.ndarray, y: np.ndarray, k: int = 5, seed: int = 0, alpha: float = 1e-4, max_predictors: int | None = None, fold: np.ndarray | None = None) -> tuple[float, float, list[float]]:
    """Mean held-out pR2, that adjusted for the predictors used, and the pR2 of each fold.

    X is taken as it is, so that ``alpha`` penalises weights in its units.
    """
    f = folds(len(y), k, seed) if fold is None else fold
    each, used = [], x.shape[1]
    for i in np.unique(f):
        tr, te = f != i, f == i
        if not tr.any():
            continue
        keep = strongest(x[tr], y[tr], max_predictors)
        used = len(keep)
        b, w = poisson_fit(x[tr][:, keep], y[tr], alpha)
        each.append(poisson_pr2(y[te], np.exp(np.clip(b + x[te][:, keep] @ w, -50, 50))))
    good = [v for v in each if not math.isnan(v)]
    pr2, n = float(np.mean(good)) if good else math.nan, len(y)
    return pr2, 1 - (1 - pr2) * (n - 1) / (n - used - 1) if n > used + 1 else math.nan, each


def lda(train: np.ndarray, labels: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Predicted classes of a linear discriminant with class shares as priors; pseudo-inverse if rank-deficient."""
    classes = np.unique(labels)
    means = np.stack([train[labels == c].mean(0) for c in classes])
    within = train - means[np.searchsorted(classes, labels)]
    inv = np.linalg.pinv(within.T @ within / max(len(train) - len(classes), 1))
    prior = np.log(np.array([(labels == c).mean() for c in classes]))
    score = test @ inv @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inv, means) + prior
    return classes[score.argmax(1)]


def lda_cv(x: np.ndarray, labels: np.ndarray, k: int = 5, seed: int = 0) -> float:
    f = stratified_folds(labels, k, seed)
    hit = np.zeros(len(labels), bool)
    for i in np.unique(f):
        if (f != i).any():
            hit[f == i] = lda(x[f != i], labels[f != i], x[f == i]) == labels[f == i]
    return float(hit.mean())


def kalman_fit(states: list[np.ndarray], rates: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """A, W, H, Q by least squares over trials, and the mean and covariance of the states, from which a trial starts."""
    x0, x1 = np.concatenate([s[:-1] for s in states]), np.concatenate([s[1:] for s in states])
    a = np.linalg.lstsq(x0, x1, rcond=None)[0].T
    x, z = np.concatenate(states), np.concatenate(rates)
    h = np.linalg.lstsq(x, z, rcond=None)[0].T
    w, q = x1 - x0 @ a.T, z - x @ h.T
    return a, w.T @ w / max(len(w), 1), h, q.T @ q / len(q), x.mean(0), np.cov(x.T, ddof=min(1, len(x) - 1)).reshape(x.shape[1], x.shape[1])


def kalman_filter(rates: np.ndarray, a: np.ndarray, w: np.ndarray, h: np.ndarray, q: np.ndarray, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """States of a trial from its rates alone; ``x`` and ``p`` are mean and covariance before the first bin."""
    out = []
    for z in rates:
        x, p = a @ x, a @ p @ a.T + w
        gain = p @ h.T @ np.linalg.pinv(h @ p @ h.T + q)
        x, p = x + gain @ (z - h @ x), p - gain @ h @ p
        out.append(x)
    return np.array(out)


def lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """The rows with those of the ``lags`` bins before, the first one repeated."""
    padded = np.concatenate((np.repeat(x[:1], lags, 0), x))
    return np.concatenate([padded[lags - i : lags - i + len(x)] for i in range(lags + 1)], 1)


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept; the intercept isn't penalised."""
    mx, my = x.mean(0), y.mean(0)
    c = x - mx
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - my))
    return w, my - mx @ w


def r2(y: np.ndarray, p: np.ndarray) -> float:
    d = ((y - y.mean(0)) ** 2).sum()
    return float(1 - ((y - p) ** 2).sum() / d) if d > 0 else math.nan


def _rotations(a: np.ndarray, b: np.ndarray, starts: int, seed: int) -> np.ndarray:
    """Orthogonal matrices to start from: the identity, one that aligns the eigenbases, and random ones.

    Where b is a in another basis, the symmetric parts have the same
    eigenvalues, which gives the change of basis but for the signs of its
    columns; the antisymmetric parts give these.
    """
    r = len(a)
    (_, u), (_, v) = np.linalg.eigh(a + a.T), np.linalg.eigh(b + b.T)
    both = (u.T @ (a - a.T) @ u) * (v.T @ (b - b.T) @ v)
    sign = np.linalg.eigh(both + both.T)[1][:, -1]
    sign = np.where(sign < 0, -1.0, 1.0)
    random = np.linalg.qr(np.random.default_rng(seed).normal(size=(starts, r, r)))[0]
    return np.concatenate((np.eye(r)[None], ((u * sign) @ v.T)[None], random))


def whiten(x: np.ndarray, ridge_: float = 1e-6) -> np.ndarray:
    """ZCA of the columns."""
    c = x - x.mean(0)
    v, u = np.linalg.eigh(c.T @ c / len(c) + ridge_ * np.eye(c.shape[1]))
    return c @ u @ np.diag(1 / np.sqrt(np.maximum(v, 1e-12))) @ u.T
