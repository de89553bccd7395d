"""The comparison of spaces from sums, against versions that gather every sample."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.functions import spaces as S
from motorspark.operators import alignment as A
from motorspark.sources.scratch import stored

PIECE, P, BLOCKS = 64, 6, [3, 2]
SCHEMA = "session int, comparison string, trial int, bin int, x array<double>, y array<double>, blocks array<int>"


def planted(seed, trials=9, bins=37, noise=0.5):
    """Rows of one design: y follows two directions of x in its first block; the second block is noise of another size."""
    g = np.random.default_rng(seed)
    rows = []
    w = g.normal(size=(P, 3))
    for t in range(trials):
        n = bins + t % 3
        z = np.cumsum(g.normal(size=(n, 2)), 0) * 0.3
        x = z @ g.normal(size=(2, P)) * 0 + z @ np.ones((2, P)) * np.linspace(0.5, 1.5, P) + g.normal(size=(n, P)) + 5
        y = np.concatenate((x @ w + noise * g.normal(size=(n, 3)), 100 * g.normal(size=(n, 2))), 1)
        rows += [(t, b, x[b].tolist(), y[b].tolist()) for b in range(n)]
    return rows


@pytest.fixture(scope="module")
def designs(spark):
    rows = [(s, c, *r, BLOCKS) for s in (1, 2) for c in ("one", "two") for r in planted(10 * s + len(c) + (c == "two"))]
    rows += [(1, "one", 3, 500, [1.0] * 5 + [float("nan")], [0.0] * 5, BLOCKS), (1, "one", 3, 501, None, [0.0] * 5, BLOCKS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def packed(designs):
    return stored(A.pieces(designs, piece=PIECE), "test-pieces")


@pytest.fixture(scope="module")
def gathered(packed):
    """(session, comparison) -> x, y, fold, trial of all rows."""
    out = {}
    for r in sorted(packed.collect(), key=lambda r: r["piece"]):
        x, y, f = A._xy(r.asDict())
        out.setdefault((r["session"], r["comparison"]), []).append((x, y, f, np.frombuffer(r["trials"], np.int32)))
    return {k: tuple(np.concatenate(c) for c in zip(*v, strict=True)) for k, v in out.items()}


def z(x):
    return (x - x.mean(0)) / x.std(0)


def plain_rrr(x, y, fold, alpha=1.0):
    """R2 by rank, and of each target at the best one, with every sample at hand."""
    ranks = range(1, min(x.shape[1], y.shape[1]) + 1)
    left, every = {r: np.zeros(y.shape[1]) for r in ranks}, np.zeros(y.shape[1])
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        mx, my = x[tr].mean(0), y[tr].mean(0)
        b = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + alpha * np.eye(x.shape[1]), (x[tr] - mx).T @ (y[tr] - my))
        vt = np.linalg.svd((x[tr] - mx) @ b, full_matrices=False)[2]
        every += ((y[te] - my) ** 2).sum(0)
        for r in ranks:
            left[r] += ((y[te] - my - (x[te] - mx) @ b @ vt[:r].T @ vt[:r]) ** 2).sum(0)
    curve = {r: 1 - left[r].sum() / every.sum() for r in ranks}
    best = max(ranks, key=lambda r: (curve[r], -r))
    return curve, best, 1 - left[best] / every


def plain_cca(x, y, alpha):
    n = len(x)
    root = lambda c: (lambda v, u: u @ np.diag(v**-0.5) @ u.T)(*np.linalg.eigh(c + alpha * np.eye(len(c))))
    xc, yc = x - x.mean(0), y - y.mean(0)
    kx, ky = root(xc.T @ xc / (n - 1)), root(yc.T @ yc / (n - 1))
    u, s, vt = np.linalg.svd(kx @ (xc.T @ yc / (n - 1)) @ ky, full_matrices=False)
    return s, kx @ u[:, : len(s)], ky @ vt.T


def plain_cca_cv(x, y, fold, alpha=1.0):
    out = []
    for f in np.unique(fold):
        _, a, b = plain_cca(x[fold != f], y[fold != f], alpha)
        u, v = x[fold == f] @ a, y[fold == f] @ b
        out.append([np.corrcoef(u[:, j], v[:, j])[0, 1] for j in range(u.shape[1])])
    return np.mean(out, 0)


def plain_operator(x, delays, rank):
    e = np.array([np.concatenate([x[t - i] for i in range(delays)]) for t in range(delays - 1, len(x))])
    z1, z2 = e[:-1], e[1:]
    v = np.linalg.svd(z1, full_matrices=False)[2][:rank].T
    return (z2 @ v).T @ (z1 @ v) @ np.linalg.pinv((z1 @ v).T @ (z1 @ v))


def test_pieces_keep_the_order_and_every_finite_row(packed, gathered):
    assert {k: len(v[0]) for k, v in gathered.items()} == {(s, c): sum(37 + t % 3 for t in range(9)) for s in (1, 2) for c in ("one", "two")}
    assert all((np.diff(v[3]) >= 0).all() for v in gathered.values()) and packed.count() == 4 * math.ceil(342 / PIECE)


def test_rank_curve_and_targets_equal_the_gathered_version(packed, gathered):
    sums = stored(A.moments(packed), "test-moments")
    curve = {(r["session"], r["comparison"], r["direction"], r["rank"]): (r["r2"], r["selected"]) for r in A.rrr_curve(sums).collect()}
    targets = {(r["session"], r["comparison"], r["direction"], r["target"]): (r["r2"], r["block"], r["block_r2"]) for r in A.rrr_targets(sums).collect()}
    seen = 0
    for (s, c), (x, y, fold, _) in gathered.items():
        for d, (a, b) in {"x_to_y": (z(x), z(y)), "y_to_x": (z(y), z(x))}.items():
            want, best, each = plain_rrr(a, b, fold)
            assert {r: v for (ss, cc, dd, r), (v, _) in curve.items() if (ss, cc, dd) == (s, c, d)} == pytest.approx(want, abs=1e-9)
            assert [r for (ss, cc, dd, r), (_, yes) in curve.items() if (ss, cc, dd) == (s, c, d) and yes] == [best]
            got = [targets[s, c, d, t] for t in range(b.shape[1])]
            assert [v for v, _, _ in got] == pytest.approx(each.tolist(), abs=1e-9)
            if d == "x_to_y":
                assert [k for _, k, _ in got] == [0, 0, 0, 1, 1] and got[0][2] == pytest.approx(each[:3].mean(), abs=1e-9)
                assert got[0][0] > 0.5 > 0.1 > got[3][0]
            seen += len(got)
    assert seen == 4 * (5 + 6) == len(targets)


@pytest.mark.parametrize("options", [{"n_pcs": 3}, {"n_pcs_y": 2}, {"weights": "equal"}, {"weights": [2.0, 0.5], "whiten": True}, {"standardize_x": False, "block_standardize": False}])
def test_preparations_act_on_sums_as_on_samples(packed, gathered, options):
    x, y, fold, _ = gathered[2, "one"]
    by, p, blocks = S.preparation(S.fold_sums(x, y, fold, 5), P, BLOCKS, **options)
    got_x, got_y = A._applied(by, p, x, y)
    n, m = options.get("n_pcs"), options.get("n_pcs_y")
    want_x = z(x) if options.get("standardize_x", True) else x
    if n:
        _, _, vt = np.linalg.svd(z(x), full_matrices=False)
        want_x = z(x) @ (vt[:n] * np.sign(vt[np.arange(n), np.abs(vt[:n]).argmax(1)])[:, None]).T
    assert np.abs(got_x - want_x).max() < 1e-8
    parts = [z(b) if options.get("block_standardize", True) else b for b in np.split(y, [3], 1)]
    if options.get("whiten"):
        parts = [b @ (lambda v, u: u @ np.diag(1 / np.sqrt(v)) @ u.T)(*np.linalg.eigh(b.T @ b / len(b) + 1e-6 * np.eye(b.shape[1]))) for b in parts]
    w = options.get("weights", [1.0, 1.0])
    parts = [b * (1 / math.sqrt(b.shape[1]) if w == "equal" else w[i]) for i, b in enumerate(parts)]
    want_y = np.concatenate(parts, 1)
    if m:
        _, _, vt = np.linalg.svd(z(want_y), full_matrices=False)
        want_y = z(want_y) @ (vt[:m] * np.sign(vt[np.arange(m), np.abs(vt[:m]).argmax(1)])[:, None]).T
        assert blocks == [m]
    assert np.abs(got_y - want_y).max() < 1e-7
    got = S.prepared(S.fold_sums(x, y, fold, 5), by)
    assert np.abs(got - S.fold_sums(want_x, want_y, fold, 5)).max() < 1e-6 * len(x)


def test_canonical_correlations_and_loadings(packed, gathered):
    sums = stored(A.moments(packed), "test-moments")
    found = {(r["session"], r["comparison"], r["component"]): r for r in A.cca_components(packed, sums, permutations=40).collect()}
    loading = {(r["session"], r["comparison"], r["side"], r["channel"], r["component"]): r["loading"] for r in A.cca_loadings(sums).collect()}
    for (s, c), (x, y, fold, _) in gathered.items():
        held, (inside, a, b) = plain_cca_cv(z(x), z(y), fold), plain_cca(z(x), z(y), 1.0)
        own = [found[s, c, j] for j in range(5)]
        assert [r["cv_correlation"] for r in own] == pytest.approx(held.tolist(), abs=1e-9)
        assert [r["correlation"] for r in own] == pytest.approx(inside.tolist(), abs=1e-9)
        assert own[0]["significant"] and 0 < own[0]["threshold"] < 0.5
        for side, v, w in (("x", z(x), a), ("y", z(y), b)):
            want = [[abs(np.corrcoef(v[:, i], v @ w[:, j])[0, 1]) for j in range(5)] for i in range(v.shape[1])]
            got = [[abs(loading[s, c, side, i, j]) for j in range(5)] for i in range(v.shape[1])]
            assert np.abs(np.array(got) - want).max() < 1e-6


def test_permutations_are_dealt_by_the_size_of_a_design(packed, monkeypatch):
    sums = stored(A.moments(packed), "test-moments")
    groups, per_group = [], A.per_group

    def counted(df, keys, *args):
        groups.extend([df.select(*keys).distinct().count()] if "lane" in keys else [])
        return per_group(df, keys, *args)

    monkeypatch.setattr(A, "per_group", counted)
    few = {tuple(r[c] for c in (*A.KEYS, "component")): r for r in A.cca_components(packed, sums, permutations=60).collect()}
    assert groups == [4 * 5]  # designs and folds; before, these for every 25 draws
    monkeypatch.setattr(A, "PERMUTED", 1000)
    many = {tuple(r[c] for c in (*A.KEYS, "component")): r for r in A.cca_components(packed, sums, permutations=60).collect()}
    assert groups[1] > 100 and set(few) == set(many)
    assert all(few[k]["threshold"] == pytest.approx(many[k]["threshold"], abs=1e-12) and few[k]["significant"] == many[k]["significant"] for k in few)


def test_noise_is_significant_by_chance_only_and_a_planted_pair_always(spark):
    g = np.random.default_rng(3)
    rows = []
    for t in range(12):
        for b in range(60):
            for c in range(8):
                x, y = g.normal(size=4), g.normal(size=3)
                pair = np.concatenate((x[:1] + 0.3 * g.normal(size=1), y[1:]))
                rows += [(c, "noise", t, b, x.tolist(), y.tolist(), [3]), (c, "pair", t, b, x.tolist(), pair.tolist(), [3])]
    packed = stored(A.pieces(spark.createDataFrame(rows, SCHEMA), piece=200), "test-pieces")
    found = [(r["comparison"], r["component"], r["significant"]) for r in A.cca_components(packed, A.moments(packed), permutations=100).collect()]
    assert len(found) == 48 and all(yes for c, j, yes in found if c == "pair" and j == 0)
    # At the 95th percentile one in twenty of the others; of 40 more than six is beyond chance.
    assert sum(yes for c, j, yes in found if c == "noise" or j > 0) <= 6


def test_dynamics_from_pieces_equal_the_gathered_operator(packed, gathered):
    fits = stored(A._preparations(A.moments(packed), A.KEYS, 1.0), "test-preparations")
    sums = stored(A.transitions(packed, fits, delays=4), "test-transitions")
    for r in A.operators(sums, rank=5).collect():
        x, y, _, _ = gathered[r["session"], r["comparison"]]
        for side, v in (("x", z(x)), ("y", z(y))):
            e = np.array([np.concatenate([v[t - i] for i in range(4)]) for t in range(3, len(v))])
            now, after = S.transition_sums(v, 4)
            assert np.abs(now - e[:-1].T @ e[:-1]).max() < 1e-8 and np.abs(after - e[1:].T @ e[:-1]).max() < 1e-8
            got = np.frombuffer(r[f"a_{side}"]).reshape(5, 5)
            want = plain_operator(v, 4, 5)
            # The same operator up to the signs of its directions.
            assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-7
        assert r["dsa"] == pytest.approx(S.field_distance(plain_operator(z(x), 4, 5), plain_operator(z(y), 4, 5)), abs=0.02)
    assert S.field_distance(*(np.array([[0.9, 0.2], [-0.2, 0.9]]),) * 2) < 1e-8
    # A piece of a few bins gives the same sums as one that holds all.
    g = np.array(sums.where("session = 1 AND comparison = 'one' AND side = 'y'").first()["g"])
    now, after = S.transition_sums(z(gathered[1, "one"][1]), 4)
    assert np.abs(g - np.concatenate((S.triangle(now), after.reshape(-1)))).max() < 1e-7


def test_surrogates_keep_what_they_should():
    g = np.random.default_rng(1)
    y, trial = np.cumsum(g.normal(size=(90, 3)), 0), np.repeat([0, 1, 2, 3], [30, 1, 29, 30])
    same = lambda a, b: np.abs(np.sort(a, 0) - np.sort(b, 0)).max() < 1e-12
    shifted = S.surrogate(y, "circular_shift", g, trial)
    for t in range(4):
        assert same(shifted[trial == t], y[trial == t]) and (t == 1) == np.array_equal(shifted[trial == t], y[trial == t])
        assert any(np.array_equal(np.roll(y[trial == t], k, 0), shifted[trial == t]) for k in range(30))
    mixed = S.surrogate(y, "time_shuffle", g, trial)
    assert same(mixed, y) and not np.array_equal(mixed, y)
    moved = S.surrogate(y, "trial_shuffle", g, trial)
    parts = {y[trial == t].tobytes() for t in range(4)}
    assert len(moved) == 90 and all(any(moved[i : i + n].tobytes() in parts for i in range(91 - n)) for n in (30, 29))
    for n in (90, 89):
        phased = S.surrogate(y[:n], "phase_randomize", g, trial[:n])
        spectra = lambda v: np.abs(np.fft.rfft(v, axis=0))
        assert np.abs(spectra(phased) - spectra(y[:n])).max() < 1e-8
        cross = lambda v: np.angle((lambda f: f[1:20, 0] * np.conj(f[1:20, 1]))(np.fft.rfft(v, axis=0)))
        assert np.abs(cross(phased) - cross(y[:n])).max() > 0.5
    with pytest.raises(ValueError, match="no such surrogate"):
        S.surrogate(y, "other", g, trial)


def test_comparison_job(spark, designs, packed, gathered):
    table, nulls = A.compare_behaviour(designs, n_null=30, piece=PIECE, delays=4, rank=5)
    got = {(r["session"], r["comparison"], r["method"], r["direction"]): r for r in table.collect()}
    directions = [("rrr", d) for d in ("x_to_y", "y_to_x", "symmetric")] + [("cca", "both"), ("dsa", "both")]
    assert set(got) == {(*k, *d) for k in gathered for d in directions} and all(r["n"] == 30 for r in got.values())
    drawn = {}
    for r in nulls.collect():
        drawn.setdefault((r["session"], r["comparison"], r["method"], r["direction"], r["surrogate"]), {})[r["draw"]] = r["value"]
    assert set(drawn) == {(*k, A.DEFAULT_NULL[k[2]]) for k in got} and all(set(v) == set(range(30)) for v in drawn.values())
    for (s, c), (x, y, fold, trial) in gathered.items():
        a, b = z(x), z(y)
        forth, back = plain_rrr(a, b, fold), plain_rrr(b, a, fold)
        assert got[s, c, "rrr", "x_to_y"]["value"] == pytest.approx(forth[0][forth[1]], abs=1e-9)
        assert got[s, c, "rrr", "symmetric"]["value"] == pytest.approx((forth[0][forth[1]] + back[0][back[1]]) / 2, abs=1e-9)
        assert got[s, c, "cca", "both"]["value"] == pytest.approx(plain_cca_cv(a, b, fold)[0], abs=1e-9)
        # A draw, made again with every sample at hand.
        rng = np.random.default_rng(A.seed_of(0, "circular_shift", 27, s, c))
        mixed = S.surrogate(b, "circular_shift", rng, trial)
        assert drawn[s, c, "rrr", "x_to_y", "circular_shift"][27] == pytest.approx(plain_rrr(a, mixed, fold)[0][forth[1]], abs=1e-8)
        assert drawn[s, c, "rrr", "y_to_x", "circular_shift"][27] == pytest.approx(plain_rrr(mixed, a, fold)[0][back[1]], abs=1e-8)
        assert drawn[s, c, "cca", "both", "circular_shift"][27] == pytest.approx(plain_cca_cv(a, mixed, fold)[0], abs=1e-8)
    for k, r in got.items():
        v = np.array([drawn[(*k, r["surrogate"])][i] for i in range(30)])
        sign = -1 if k[2] == "dsa" else 1
        assert r["z"] == pytest.approx(sign * (r["value"] - v.mean()) / v.std(), rel=1e-6)
        assert r["p"] == pytest.approx((1 + ((v - r["value"]) * sign >= 0).sum()) / 31) and r["percentile"] == pytest.approx((v <= r["value"]).mean() * 100)
        assert r["robust_z"] == pytest.approx(sign * (r["value"] - np.median(v)) / (1.4826 * np.median(np.abs(v - np.median(v)))), rel=1e-6)
    assert got[1, "one", "rrr", "x_to_y"]["z"] > 5


def test_other_nulls_and_empty_designs(spark, designs):
    few = designs.where("session = 1 AND comparison = 'one'")
    table, nulls = A.compare_behaviour(few, methods=("rrr",), null=("time_shuffle", "trial_shuffle"), n_null=3, piece=PIECE)
    assert sorted((r["direction"], r["surrogate"], r["n"]) for r in table.collect()) == [(d, s, 3) for d in ("symmetric", "x_to_y", "y_to_x") for s in ("time_shuffle", "trial_shuffle")]
    table, nulls = A.compare_behaviour(designs.where("session = 7"), n_null=3)
    assert table.count() == 0 == nulls.count()


def test_designs_of_comparisons(spark):
    rates = spark.createDataFrame([(1, t, u, float(b), b + 0.5 * u) for t in (0, 1) for u in (7, 8) for b in range(6)], "session int, trial int, unit_id int, t double, rate double")
    signals = [(1, t, "joint_angles", c, float(b), b * (2.0 if c == "a" else 3.0)) for t in (0, 1) for c in "ab" for b in range(1, 6)]
    signals += [(1, 0, "torques", "a", float(b), 10.0 * b) for b in range(0, 5)]
    s = spark.createDataFrame(signals, "session int, trial int, signal string, channel string, t double, value double")
    found = A.comparison_designs(rates, s)
    got = {(r["comparison"], r["trial"], r["bin"]): (r["x"], r["y"], r["blocks"]) for r in found.collect()}
    assert set(got) == {("joint_angles", t, float(b)) for t in (0, 1) for b in range(1, 6)} | {("joint_angles_torques", 0, float(b)) for b in range(1, 5)}
    assert got["joint_angles", 1, 2.0] == ([5.5, 6.0], [4.0, 6.0], [2]) and got["joint_angles_torques", 0, 3.0] == ([6.5, 7.0], [6.0, 9.0, 30.0], [2, 1])
