import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.functions import models as M
from motorspark.functions import spaces as S
from motorspark.operators import alignment as L
from motorspark.operators import models as O


def rng():
    return np.random.default_rng(0)


def test_poisson_recovers_weights():
    g = rng()
    x = g.normal(size=(4000, 2))
    y = g.poisson(np.exp(0.5 + x @ [0.4, -0.3])).astype(float)
    b, w = M.poisson_fit(x, y)
    assert abs(b - 0.5) < 0.05 and np.allclose(w, [0.4, -0.3], atol=0.05)
    assert M.poisson_cv(x, y)[0] > 0.1


def test_lda_kalman_and_ridge():
    g = rng()
    y = np.repeat([0, 1], 50)
    x = g.normal(size=(100, 3)) + y[:, None] * 4
    assert M.lda_cv(x, y) > 0.95
    s = [np.cumsum(g.normal(size=(80, 2)), 0) for _ in range(6)]
    h = g.normal(size=(5, 2))
    z = [v @ h.T + 0.1 * g.normal(size=(80, 5)) for v in s]
    a = M.kalman_fit(s[:5], z[:5])
    assert M.r2(s[5], M.kalman_filter(z[5], *a)) > 0.9
    w, b = M.ridge(x, x @ np.eye(3)[:, :1] + 2, 1e-9)
    assert np.allclose(w[:, 0], [1, 0, 0], atol=1e-6) and np.isclose(b[0], 2)


def test_whitening():
    g = rng()
    y = g.normal(size=(300, 3)) @ g.normal(size=(3, 3))
    w = M.whiten(y)
    assert np.allclose(w.T @ w / len(w), np.eye(3), atol=1e-2)


def test_field_distance_of_rotated_copies_is_zero():
    g = rng()
    for _ in range(10):
        q = np.linalg.qr(g.normal(size=(4, 4)))[0]
        a = np.linalg.qr(g.normal(size=(4, 4)))[0] * g.uniform(0.8, 0.99)
        x = [g.normal(size=4)]
        for _ in range(299):
            x.append(a @ x[-1] + 0.3 * g.normal(size=4))
        x = np.array(x)
        a, b, c = (S.operator_from_sums(*S.transition_sums(v, 5), 5) for v in (x, x @ q, np.cumsum(g.normal(size=(300, 4)), 0)))
        assert S.field_distance(a, b) < 1e-3 < 0.02 < S.field_distance(a, c)
        assert S.field_distance(a, b, starts=0) < 1e-3


def test_glm_averages_folds_and_counts_what_it_used():
    g = rng()
    x = g.normal(size=(400, 6))
    y = g.poisson(np.exp(0.3 + x[:, 2] * 0.8 - x[:, 4] * 0.5)).astype(float)
    fold = np.arange(400) % 4
    pr2, adj, each = M.poisson_cv(x, y, fold=fold)
    want = []
    for i in range(4):
        b, w = M.poisson_fit(x[fold != i], y[fold != i])
        mu, t = np.exp(b + x[fold == i] @ w), y[fold == i]
        dev = lambda m: float(np.where(t > 0, t * np.log(np.where(t > 0, t, 1) / m), 0).sum() - (t - m).sum())
        want.append(1 - dev(mu) / dev(np.full(len(t), t.mean())))
    assert np.allclose(each, want) and np.isclose(pr2, np.mean(want)) and np.isclose(adj, 1 - (1 - pr2) * 399 / 393)
    assert M.strongest(x, y, 2).tolist() == [2, 4] and M.strongest(x, y, None).tolist() == list(range(6))
    pr2, adj, _ = M.poisson_cv(x, y, fold=fold, max_predictors=2)
    assert np.isclose(adj, 1 - (1 - pr2) * 399 / 397) and pr2 > 0.2
    assert np.isnan(M.poisson_pr2(np.full(5, 2.0), np.ones(5)))


def test_distributed_pca_matches_svd(spark):
    x = rng().normal(size=(200, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    d = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = O.pca(d, ["a", "b", "c"], 2).orderBy("component").collect()
    _, comp, share = M.pca(x, 2)
    assert np.allclose([r["weights"] for r in got], comp, atol=1e-6) and np.allclose([r["explained"] for r in got], share)


XY = "session string, trial long, bin long, x array<double>, y array<double>"


def trials_of(g, n, rates):
    """Trials with levels of their own: the states drift, the rates are made of them by ``rates``."""
    out, states = [], {}
    for t in range(n):
        y = g.normal(0, 5, 2) + np.cumsum(g.normal(0, 0.1, size=(40, 2)), 0)
        states[t] = (y, rates(y))
        out += [("s", t, b, states[t][1][b].tolist(), y[b].tolist()) for b in range(40)]
    return out, states


def test_noise_decodes_nothing(spark):
    g = rng()
    out, _ = trials_of(g, 20, lambda y: g.normal(size=(40, 4)))
    d = spark.createDataFrame(out, XY)
    for got in (O.kalman_decode_cv(d), O.wiener_decode_cv(d, lags=2)):
        rows = got.collect()
        assert sorted(r["trial"] for r in rows) == list(range(20)) and np.median([r["r2"] for r in rows]) < 0.05


def test_decoders_equal_numpy(spark):
    g = rng()
    h = np.array([[1.0, -1, 0.5, 2], [0.3, 1, -1, 0.2]])
    out, states = trials_of(g, 9, lambda y: y @ h + 0.3 * g.normal(size=(40, 4)))
    d = spark.createDataFrame(out, XY)
    kalman = {r["trial"]: r for r in O.kalman_decode_cv(d, folds=3).collect()}
    wiener = {r["trial"]: r for r in O.wiener_decode_cv(d, folds=3, lags=2).collect()}
    assert len(kalman) == len(wiener) == 9
    for fold in {r["fold"] for r in kalman.values()}:
        held = sorted(t for t, r in kalman.items() if r["fold"] == fold)
        assert held == sorted(t for t, r in wiener.items() if r["fold"] == fold)
        train = [t for t in states if t not in held]
        ys, xs = np.concatenate([states[t][0] for t in train]), np.concatenate([states[t][1] for t in train])
        y0, y1 = np.concatenate([states[t][0][:-1] for t in train]), np.concatenate([states[t][0][1:] for t in train])
        a = np.linalg.lstsq(y0, y1, rcond=None)[0]
        w = (y1 - y0 @ a).T @ (y1 - y0 @ a) / len(y0)
        c = np.linalg.lstsq(ys, xs, rcond=None)[0]
        q = (xs - ys @ c).T @ (xs - ys @ c) / len(ys)
        lag = lambda x: np.concatenate([np.concatenate((np.repeat(x[:1], i, 0), x[: len(x) - i])) for i in range(3)], 1)
        big = np.concatenate([lag(states[t][1]) for t in train])
        m, s = big.mean(0), big.std(0)
        z = (big - m) / s
        beta = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (ys - ys.mean(0)))
        for t in held:
            x, p, made = ys.mean(0), np.cov(ys.T), []
            for obs in states[t][1]:
                x, p = x @ a, a.T @ p @ a + w
                k = p @ c @ np.linalg.inv(c.T @ p @ c + q)
                x, p = x + k @ (obs - x @ c), p - k @ c.T @ p
                made.append(x)
            assert kalman[t]["r2"] == pytest.approx(M.r2(states[t][0], np.array(made)), abs=1e-6) and kalman[t]["r2"] > 0
            line = (lag(states[t][1]) - m) / s @ beta + ys.mean(0)
            assert wiener[t]["r2"] == pytest.approx(M.r2(states[t][0], line), abs=1e-6)


def test_glm_blocks_and_nulls(spark):
    g = rng()
    x = g.normal(size=(120, 3))
    rate = {f"u{k}": g.poisson(np.exp(0.5 + 0.7 * x[:, k % 3])).astype(float) for k in range(7)}
    rows = [("s", 0, float(i), x[i].tolist(), {u: float(v[i]) for u, v in rate.items()}) for i in range(120)]
    d = spark.createDataFrame(rows, "session string, trial int, t double, x array<double>, y map<string,double>")
    got = {r["unit_id"]: r for r in O.poisson_glm_cv(d, units=2).collect()}
    assert set(got) == set(rate)
    for u, r in got.items():
        assert r["pr2"] == pytest.approx(M.poisson_cv(x, rate[u], 5, O.seed_of(0, u))[0]) and r["pr2"] > 0


def test_own_headline_on_surrogates(spark):
    g = rng()
    out, states = trials_of(g, 6, lambda y: y @ np.ones((2, 4)) * [1, -1, 0.5, 2] + 0.1 * g.normal(size=(40, 4)))
    d = spark.createDataFrame(out + [("r", *row[1:]) for row in out], XY).withColumns({"comparison": F.lit("c"), "blocks": F.array(F.lit(2))})
    headline = lambda x, y: float(np.corrcoef(x.sum(1), y.sum(1))[0, 1])
    n = L.headline_null(d, headline, 60, ("circular_shift", "time_shuffle"), piece=50).collect()
    assert len(n) == len({(r["session"], r["surrogate"], r["draw"]) for r in n}) == 2 * (1 + 120)
    x, y = (M.standardise(np.concatenate([states[t][i] for t in range(6)]))[0] for i in (1, 0))
    got = {(r["session"], r["surrogate"], r["draw"]): r["value"] for r in n}
    assert got["s", None, None] == pytest.approx(headline(x, y))
    mixed = S.surrogate(y, "circular_shift", np.random.default_rng(O.seed_of(0, "circular_shift", 41, "s", "c")), np.repeat(np.arange(6), 40))
    assert got["s", "circular_shift", 41] == pytest.approx(headline(x, mixed))


def test_lag_sweep_finds_the_lag(spark):
    g = rng()
    x = g.normal(size=200)
    y = (2 + np.roll(x, -3) * 0.5) ** 2  # y[t] goes with x[t + 3]
    d = spark.createDataFrame([(0, 0, "u", i, float(x[i]), float(y[i])) for i in range(197)], "session int, trial int, unit_id string, bin int, x double, y double")
    best = O.optimal_lag(O.lag_sweep(d, range(-5, 6), ["x"])).first()
    assert best["best_lag"] == 3 and best["best_r2"] == pytest.approx(1.0)


def test_lda_through_time(spark):
    g = rng()
    a = [("s", t, t % 2, u, b, float(g.normal() + (t % 2) * 3 * (b == 1))) for t in range(30) for u in range(3) for b in range(2)]
    d = spark.createDataFrame(a, "session string, trial int, condition int, unit_id int, bin int, value double")
    got = {r["bin"]: r["accuracy"] for r in O.lda_through_time(d).collect()}
    assert got[1] > 0.9 > got[0]
