"""Comparing two spaces from sums of products, in numpy.

``g`` holds, for each fold, the sums of products of the rows ``[1, x, y]``
(x has ``p`` columns). A training set is the total less its fold, and every
linear preparation of the columns acts on the sums alone, so no fit here sees
a sample.
"""

from __future__ import annotations

import math

import numpy as np

from motorspark.functions.models import _rotations


def triangle(g: np.ndarray) -> np.ndarray:
    """The upper triangle, row by row."""
    return g[np.triu_indices(len(g))]


def square(flat: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    d = int((math.isqrt(8 * len(flat) + 1) - 1) // 2)
    g = np.zeros((d, d))
    g[np.triu_indices(d)] = flat
    return g + np.triu(g, 1).T


def fold_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, k: int) -> np.ndarray:
    z = np.concatenate((np.ones((len(x), 1)), x, y), 1)
    return np.stack([z[fold == f].T @ z[fold == f] for f in range(k)])


def _spread(g: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations (1 for a constant column) and covariance of columns."""
    m = g[0, at] / g[0, 0]
    c = g[at, at] / g[0, 0] - np.outer(m, m)
    s = np.sqrt(np.maximum(np.diag(c), 0.0))
    # What rounding leaves of a constant column is no deviation.
    tiny = 1e-7 * np.sqrt(np.maximum(np.diag(g[at, at]) / g[0, 0], 0.0))
    return m, np.where(s > tiny, s, 1.0), c


def _principal(c: np.ndarray, n: int) -> np.ndarray:
    v, u = np.linalg.eigh(c)
    u = u[:, np.argsort(-v)[:n]]
    return u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def preparation(g: np.ndarray, p: int, blocks: list[int], n_pcs: int | None = None, n_pcs_y: int | None = None, standardize_x: bool = True, block_standardize: bool = True, whiten: bool = False, weights: str | list[float] | None = None) -> tuple[np.ndarray, int, list[int]]:
    """The map of ``[1, x, y]`` to the prepared columns, the number of x columns then, and the sizes of the blocks then.

    x is standardised, or reduced to principal components of its z-scores; each
    block of y is standardised, whitened and weighted ("equal": by the root of
    its size) on its own, and all of y can be reduced to principal components.
    """
    total, q = g.sum(0), g.shape[1] - 1 - p
    m, s, c = _spread(total, slice(1, 1 + p))
    reduce_x = bool(n_pcs) and n_pcs < p
    wx = np.diag(1 / s) if standardize_x or reduce_x else np.eye(p)
    shift_x = -m @ wx if standardize_x or reduce_x else np.zeros(p)
    if reduce_x:
        back = _principal(wx @ c @ wx, n_pcs)
        wx, shift_x = wx @ back, shift_x @ back
    m, s, c = _spread(total, slice(1 + p, 1 + p + q))
    wy = np.diag(1 / s) if block_standardize else np.eye(q)
    shift_y = -m @ wy if block_standardize else np.zeros(q)
    edges = np.cumsum([0, *blocks])
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if whiten:
            v, u = np.linalg.eigh(wy[:, a:b].T @ c @ wy[:, a:b] + 1e-6 * np.eye(b - a))
            zca = u @ np.diag(1 / np.sqrt(np.maximum(v, 1e-12))) @ u.T
            # Whitened columns have mean 0.
            wy[:, a:b], shift_y[a:b] = wy[:, a:b] @ zca, -m @ wy[:, a:b] @ zca
        if weights is not None:
            w = 1 / math.sqrt(b - a) if weights == "equal" else float(weights[i])
            wy[:, a:b], shift_y[a:b] = wy[:, a:b] * w, shift_y[a:b] * w
    if n_pcs_y and n_pcs_y < q:
        mean = m @ wy + shift_y
        cy = wy.T @ c @ wy
        _, s, _ = m, np.where(np.diag(cy) > 1e-14, np.sqrt(np.maximum(np.diag(cy), 0)), 1.0), None
        back = np.diag(1 / s) @ _principal(cy / np.outer(s, s), n_pcs_y)
        wy, shift_y, blocks = wy @ back, (shift_y - mean) @ back, [n_pcs_y]
    out = np.zeros((1 + p + q, 1 + wx.shape[1] + wy.shape[1]))
    out[0, 0] = 1.0
    out[0, 1 : 1 + wx.shape[1]], out[1 : 1 + p, 1 : 1 + wx.shape[1]] = shift_x, wx
    out[0, 1 + wx.shape[1] :], out[1 + p :, 1 + wx.shape[1] :] = shift_y, wy
    return out, wx.shape[1], list(blocks)


def prepared(g: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.einsum("ia,fij,jb->fab", by, g, by)


def turned(g: np.ndarray, p: int) -> tuple[np.ndarray, int]:
    """The sums with x and y exchanged."""
    d = g.shape[1]
    order = [0, *range(1 + p, d), *range(1, 1 + p)]
    return g[:, order][:, :, order], d - 1 - p


def _centred(t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sums of products of rows less ``m`` (all columns but the first)."""
    s = t[0, 1:]
    return t[1:, 1:] - np.outer(s, m) - np.outer(m, s) + t[0, 0] * np.outer(m, m)


def rrr_cv(g: np.ndarray, p: int, ranks: list[int] | None = None, alpha: float = 1.0) -> dict:
    """Held-out R2 of reduced-rank ridge of y on x: of every rank, and at the best one of every target.

    Squared errors are summed over folds, and R2 is against the mean of the
    training rows. Ties go to the smaller rank.
    """
    q, total = g.shape[1] - 1 - p, g.sum(0)
    ranks = ranks or list(range(1, min(p, q) + 1))
    left, all_ = np.zeros((len(ranks), q)), np.zeros(q)
    for te in g:
        tr = total - te
        if te[0, 0] < 0.5 or tr[0, 0] < 0.5:
            continue
        m = tr[0, 1:] / tr[0, 0]
        c, t = _centred(tr, m), _centred(te, m)
        b = np.linalg.solve(c[:p, :p] + alpha * np.eye(p), c[:p, p:])
        v, u = np.linalg.eigh(b.T @ c[:p, :p] @ b)
        u = u[:, np.argsort(-v, kind="stable")]
        a = b @ u
        cross, own = a.T @ t[:p, p:], a.T @ t[:p, :p] @ a
        all_ += np.diag(t[p:, p:])
        for i, r in enumerate(ranks):
            k = min(r, u.shape[1])
            w = u[:, :k]
            left[i] += np.diag(t[p:, p:]) - 2 * (w * cross[:k].T).sum(1) + ((w @ own[:k, :k]) * w).sum(1)
    curve = 1 - left.sum(1) / all_.sum() if all_.sum() > 0 else np.full(len(ranks), np.nan)
    best = int(np.nanargmax(curve)) if np.isfinite(curve).any() else 0
    with np.errstate(divide="ignore", invalid="ignore"):
        targets = np.where(all_ > 0, 1 - left[best] / all_, np.nan)
    return {"ranks": list(ranks), "r2": curve, "rank": ranks[best], "best": float(curve[best]), "targets": targets}


def _covariances(t: np.ndarray) -> np.ndarray:
    """Unbiased covariances of all columns but the first."""
    n = t[0, 0]
    return _centred(t, t[0, 1:] / n) / max(n - 1, 1)


def cca_fit(t: np.ndarray, p: int, alpha_x: float = 1.0, alpha_y: float = 1.0, n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge canonical correlations in sample, and the weights of both sides."""

    def root(c: np.ndarray, alpha: float) -> np.ndarray:
        v, u = np.linalg.eigh(c + alpha * np.eye(len(c)))
        return u @ np.diag(np.maximum(v, 1e-12) ** -0.5) @ u.T

    c = _covariances(t)
    kx, ky = root(c[:p, :p], alpha_x), root(c[p:, p:], alpha_y)
    u, s, vt = np.linalg.svd(kx @ c[:p, p:] @ ky, full_matrices=False)
    k = min(n or len(s), len(s))
    return np.clip(s[:k], 0, 1), kx @ u[:, :k], ky @ vt[:k].T


def cca_folds(g: np.ndarray, p: int, alpha_x: float = 1.0, alpha_y: float = 1.0, n: int | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each fold the weights of both sides from its training rows, and their correlations on the fold.

    A constant has NaN, as have folds of fewer than two rows, or with fewer outside.
    """
    total, out = g.sum(0), []
    q = g.shape[1] - 1 - p
    k = min(n or p, p, q)
    for te in g:
        if min(te[0, 0], total[0, 0] - te[0, 0]) < 1.5:
            out.append((np.zeros((p, k)), np.zeros((q, k)), np.full(k, np.nan)))
            continue
        _, a, b = cca_fit(total - te, p, alpha_x, alpha_y, n)
        c = _covariances(te)
        u, v = np.einsum("ij,ik,kj->j", a, c[:p, :p], a), np.einsum("ij,ik,kj->j", b, c[p:, p:], b)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.where((u > 1e-14) & (v > 1e-14), np.einsum("ij,ik,kj->j", a, c[:p, p:], b) / np.sqrt(u * v), np.nan)
        out.append((a, b, r))
    return out


def mean_of_folds(r: np.ndarray) -> np.ndarray:
    """Means over the first axis, without NaN; NaN where there is nothing else."""
    good = np.isfinite(r)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(good.any(0), np.where(good, r, 0.0).sum(0) / good.sum(0), np.nan)


def cca_cv(g: np.ndarray, p: int, alpha_x: float = 1.0, alpha_y: float = 1.0, n: int | None = None) -> np.ndarray:
    """Mean over folds of the held-out canonical correlations."""
    return mean_of_folds(np.stack([r for _, _, r in cca_folds(g, p, alpha_x, alpha_y, n)]))


def loadings(t: np.ndarray, p: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of every channel with every variate of its own side; NaN for a constant."""
    c = _covariances(t)

    def own(c: np.ndarray, w: np.ndarray) -> np.ndarray:
        s, v = np.sqrt(np.maximum(np.diag(c), 0)), np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", w, c, w), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            out = c @ w / np.outer(s, v)
        return np.where(np.outer(s > 1e-9, v > 1e-9), out, np.nan)

    return own(c[:p, :p], a), own(c[p:, p:], b)


def embedded(x: np.ndarray, delays: int, delay: int = 1) -> np.ndarray:
    """Row t is ``[x_t, x_(t-delay), ...]``; the first row is the first that has all of them."""
    span = (delays - 1) * delay
    return np.concatenate([x[span - i * delay : len(x) - i * delay] for i in range(delays)], 1)


def transition_sums(x: np.ndarray, delays: int, delay: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sums over t of z z' and of z_(t+1) z', z being the embedded rows that have a next one."""
    z = embedded(x, delays, delay)
    return z[:-1].T @ z[:-1], z[1:].T @ z[:-1]


def operator_from_sums(now: np.ndarray, after: np.ndarray, rank: int) -> np.ndarray:
    """The linear operator from a row to the next in the leading ``rank`` directions of the rows."""
    v, u = np.linalg.eigh(now)
    u = u[:, np.argsort(-v, kind="stable")[:rank]]
    return u.T @ after @ u @ np.linalg.pinv(u.T @ now @ u)


def field_distances(a: np.ndarray, bs: np.ndarray, starts: int = 2, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """The least ``|A C - C B|`` over orthogonal C for each B of ``bs``, over the mean norm of A and B; 0: the same system in another basis.

    Steps along the gradient's tangent, of a length that never lets the
    distance grow, from several starts for all B at once. C goes back to the
    orthogonal matrices by Newton-Schulz steps: a tangent step leaves its
    singular values between 1 and the root of 2, where these converge.
    """
    scale = (np.linalg.norm(a) + np.linalg.norm(bs, axis=(1, 2))) / 2
    out, eye = np.zeros(len(bs)), np.eye(len(a))
    c = np.stack([_rotations(a, b, starts, seed) for b in bs]) if len(bs) else np.zeros((0, 1, *a.shape))
    step = 1.0 / np.maximum(np.linalg.norm(a, 2) + np.linalg.norm(bs, 2, axis=(1, 2)), 1e-300) ** 2
    todo, before = np.flatnonzero(scale > 0), np.full(len(bs), np.inf)
    for k in range(rounds + 1):
        b, own = bs[todo][:, None], c[todo]
        rest = a @ own - own @ b
        now = np.linalg.norm(rest, axis=(2, 3)).min(1)
        out[todo] = now / scale[todo]
        go = (now >= 1e-10 * scale[todo]) & ((k < 10) | (before[todo] - now >= 1e-5 * scale[todo]))
        before[todo] = now
        todo, own, rest, b = todo[go], own[go], rest[go], b[go]
        if not len(todo) or k == rounds:
            break
        turn = own.swapaxes(2, 3) @ (a.T @ rest - rest @ b.swapaxes(2, 3))
        own = own @ (eye - (step[todo][:, None, None, None] / 2) * (turn - turn.swapaxes(2, 3)))
        for _ in range(8):
            square_ = own.swapaxes(2, 3) @ own
            if np.abs(square_ - eye).max() < 1e-12:
                break
            own = own @ (1.5 * eye - 0.5 * square_)
        c[todo] = own
    return out


def field_distance(a: np.ndarray, b: np.ndarray, starts: int = 2, rounds: int = 200, seed: int = 0) -> float:
    return float(field_distances(a, b[None], starts, rounds, seed)[0])


def surrogate(y: np.ndarray, kind: str, rng: np.random.Generator, trial: np.ndarray) -> np.ndarray:
    """A surrogate of the behaviour's rows; ``trial`` numbers each row's trial, whose rows stand together.

    time_shuffle permutes all rows; circular_shift rolls each trial by its own
    offset; trial_shuffle permutes whole trials; phase_randomize keeps each
    channel's spectrum and gives each its own phases.
    """
    n = len(y)
    starts = np.flatnonzero(np.concatenate(([True], trial[1:] != trial[:-1]))) if n else np.zeros(0, int)
    lengths = np.diff(np.concatenate((starts, [n])))
    if kind == "time_shuffle":
        return y[rng.permutation(n)]
    if kind == "circular_shift":
        by = np.where(lengths > 1, 1 + np.floor(rng.random(len(lengths)) * np.maximum(lengths - 1, 1)).astype(int), 0)
        start, length, shift = (np.repeat(v, lengths) for v in (starts, lengths, by))
        return y[start + (np.arange(n) - start - shift) % length]
    if kind == "trial_shuffle":
        order = rng.permutation(len(starts))
        return np.concatenate([y[starts[i] : starts[i] + lengths[i]] for i in order])
    if kind == "phase_randomize":
        f = np.fft.rfft(y, axis=0)
        phase = rng.uniform(0, 2 * np.pi, f.shape)
        phase[0] = 0.0
        if n % 2 == 0:
            phase[-1] = 0.0
        return np.fft.irfft(f * np.exp(1j * phase), n, 0)
    raise ValueError(f"no such surrogate: {kind}")
