"""Optimal lags in two steps, stored runs and pooled classification, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.functions import models as M
from motorspark.operators import encoding as E
from motorspark.operators import models as O
from motorspark.operators import ordering as K
from motorspark.sources.results import ResultStore

LAGS = range(-4, 5)
PLANTED = {"a": {"u0": 2, "u1": 2, "u2": -1, "u3": 2}, "b": {"u0": -3, "u1": 1, "u9": 1}}


def sessions():
    """session -> trials of (x, rates by unit): planted units follow x at their lag, ``silent`` is silent, ``noise`` follows nothing."""
    out = {}
    for s, units in PLANTED.items():
        g = np.random.default_rng(ord(s))
        trials = []
        for _ in range(8):
            n = int(g.integers(60, 80))
            x = g.normal(size=(n + 20, 2))
            rates = {u: g.poisson(np.exp(0.8 + 0.7 * x[10 + k : 10 + k + n, i % 2])).astype(float) for i, (u, k) in enumerate(units.items())}
            rates |= {"silent": (g.random(n) < 0.1) * 1.0, "noise": g.poisson(3.0, n).astype(float)}
            trials.append((x[10 : 10 + n], rates))
        out[s] = trials
    return out


@pytest.fixture(scope="module")
def design(spark):
    rows = [(s, t, i / 50, x[i].tolist(), {u: float(r[i]) for u, r in rates.items()}) for s, trials in sessions().items() for t, (x, rates) in enumerate(trials) for i in range(len(x))]
    return spark.createDataFrame(rows, "session string, trial int, t double, x array<double>, y map<string,double>").repartition(3)


def moved(trials, unit, k):
    """x at t + k and the unit's rate at t, over all trials."""
    pairs = [(x[k:], r[unit][: len(x) - k]) if k >= 0 else (x[:k], r[unit][-k:]) for x, r in trials]
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def plain_r2(trials, unit, k):
    x, y = moved(trials, unit, k)
    s = np.sqrt(y) - np.sqrt(y).mean()
    x = x - x.mean(0)
    return 1 - ((s - x @ np.linalg.lstsq(x, s, rcond=None)[0]) ** 2).sum() / (s**2).sum()


def test_surrogate_of_all_lags(design):
    for chunk in (E.CHUNK, 100):
        got = {(r["session"], r["unit_id"], r["lag"]): r["r2"] for r in E.lag_surrogate(design, LAGS, chunk=chunk).collect()}
        want = {(s, u, k): plain_r2(trials, u, k) for s, trials in sessions().items() for u in trials[0][1] for k in LAGS}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_optimal_lags_find_what_was_planted(design):
    got = {(r["session"], r["unit_id"]): r for r in E.optimal_lags(design, LAGS).collect()}
    for s, trials in sessions().items():
        for u, k in PLANTED[s].items():
            r = got[s, u]
            assert r["best_lag"] == r["searched_lag"] == k == max(list(LAGS)[1:-1], key=lambda j: plain_r2(trials, u, j)) and r["best_pr2"] > 0.1
        silent, noise = got[s, "silent"], got[s, "noise"]
        assert silent["searched_lag"] is None and silent["best_lag"] is None and silent["adj_pr2"] is None and silent["mean_rate"] < 0.2
        assert noise["searched_lag"] is not None and noise["best_lag"] is None and noise["best_pr2"] is None and noise["adj_pr2"] < E.MIN_ADJ_R2
    assert {r["mode_lag"] for (s, _), r in got.items() if s == "a"} == {2} and {r["mode_lag"] for (s, _), r in got.items() if s == "b"} == {1}
    # The confirming fit sees the design of its own lag: as many bins, in the order of trial and time.
    x, y = moved(sessions()["b"], "u0", -3)
    assert got["b", "u0"]["best_pr2"] == pytest.approx(M.poisson_cv(x, y, 5, O.seed_of(0, "u0"))[0])
    nothing = E.optimal_lags(design.where("session = 'a'"), LAGS, min_rate=99.0).collect()
    assert len(nothing) == 6 and all(r["best_lag"] is None and r["mode_lag"] == 0 for r in nothing)


def stored(df):
    return sorted(map(str, df.collect()))


def test_store_survives_runs_that_end_half_way(spark, tmp_path, monkeypatch):
    store = ResultStore(spark, f"file://{tmp_path}/r", "session string, unit string, v double")
    rows = lambda *r: spark.createDataFrame(list(r), "session string, unit string, v double")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "session string")
    assert store.read().count() == 0 and store.missing(keys).count() == 4
    store.upsert(rows(("a", "x", 1.0), ("a", "y", 2.0), (None, "z", 3.0)), keys.where("session = 'a' OR session IS NULL"))
    assert {r["session"] for r in store.missing(keys).collect()} == {"b", "c"}
    before = stored(store.read())

    class Dead(Exception):
        pass

    # The rows are written, the manifest isn't.
    with monkeypatch.context() as m, pytest.raises(Dead):
        m.setattr("motorspark.sources.results.time.time_ns", lambda: (_ for _ in ()).throw(Dead))
        store.upsert(rows(("b", "x", 9.0), ("a", "x", 9.0)), keys.where("session IN ('a', 'b')"))
    assert stored(store.read()) == before and {r["session"] for r in store.missing(keys).collect()} == {"b", "c"}
    for _ in range(2):  # repeated: neither lost nor doubled
        store.upsert(rows(("b", "x", 9.0), ("a", "x", 4.0)), keys.where("session IN ('a', 'b', 'c')"))
        assert stored(store.read()) == stored(rows(("b", "x", 9.0), ("a", "x", 4.0), (None, "z", 3.0)))
    # A key without rows is done; a run without keys is none.
    assert store.missing(keys).count() == 0
    store.upsert(rows(("q", "x", 1.0)), keys.where("false"))
    assert store.read().count() == 3


def test_encoding_runs_extend_each_other(spark, design, tmp_path, monkeypatch):
    schemas = [s.replace("session date", "session string") for s in (E.LAGS, E.ENCODINGS)]
    lags, encodings = (ResultStore(spark, f"file://{tmp_path}/{n}", s) for n, s in zip(("lags", "encodings"), schemas, strict=True))
    first = E.run_encoding(design.where("session = 'a'"), LAGS, lags, encodings)
    assert {r["session"] for r in first[0].collect()} == {r["session"] for r in first[1].collect()} == {"a"}
    fitted = []
    real = E.poisson_glm_cv
    monkeypatch.setattr(E, "poisson_glm_cv", lambda d, *a, **k: fitted.append({r["session"] for r in d.select("session").distinct().collect()}) or real(d, *a, **k))
    after = E.run_encoding(design, LAGS, lags, encodings)
    assert fitted == [{"b"}, {"b"}]
    whole = {(r["session"], r["unit_id"]): r["pr2"] for r in after[1].collect()}
    assert len(whole) == after[1].count() == 11 and {(r["session"], r["mode_lag"]) for r in after[0].collect()} == {("a", 2), ("b", 1)}
    x, y = moved(sessions()["a"], "u2", 2)
    assert whole["a", "u2"] == pytest.approx(M.poisson_cv(x, y, 5, O.seed_of(0, "u2"))[0])
    E.run_encoding(design, LAGS, lags, encodings)
    assert fitted == [{"b"}, {"b"}, set(), set()]


def test_pooled_classification_equals_numpy(spark):
    g = np.random.default_rng(5)
    rows, depth = [], []
    counts = {("s1", "p"): 9, ("s1", "q"): 7, ("s2", "p"): 6, ("s2", "q"): 8, ("s2", "r"): 5}
    for s, units in (("s1", 4), ("s2", 6)):
        depth += [(s, f"u{u}", float(u)) for u in range(units)]
        trial = 0
        for (own, c), n in counts.items():
            for _ in range(n if own == s else 0):
                for b in range(3):
                    rows += [(s, f"u{u}", trial, c, b, float(g.normal() + (b * (c == "p") if u % 2 else 0))) for u in range(units)]
                trial += 1
    a = spark.createDataFrame(rows, "session string, unit_id string, trial int, condition string, bin int, value double")
    units = spark.createDataFrame(depth, "session string, unit_id string, depth double")
    groups = O.depth_groups(units, 0.5, 0.3)
    assert {(r["session"], r["unit_id"], r["depth_group"]) for r in groups.collect()} == {
        ("s1", "u3", "top"), ("s1", "u2", "top"), ("s1", "u0", "bottom"), *(("s2", f"u{i}", "top") for i in (5, 4, 3)), ("s2", "u1", "bottom"), ("s2", "u0", "bottom")
    }
    got = {(r["depth_group"], r["session"], r["bin"]): r for r in O.classify_pooled(a, groups).collect()}
    assert set(got) == {(d, s, b) for d in ("top", "bottom") for s in ("s1", "s2", None) for b in range(3)}
    draws = {(r["session"], r["condition"], r["draw"]): r["trial"] for r in K.pseudopopulation(a.select("session", "condition", "trial")).collect()}
    assert {c: sum(1 for s, k, _ in draws if (s, k) == ("s1", c)) for c in "pqr"} == {"p": 6, "q": 7, "r": 0}
    value = {(s, u, t, b): v for s, u, t, _, b, v in rows}
    members = {"top": [("s1", "u2"), ("s1", "u3"), ("s2", "u3"), ("s2", "u4"), ("s2", "u5")], "bottom": [("s1", "u0"), ("s2", "u0"), ("s2", "u1")]}
    for d, own in members.items():
        for b in range(3):
            order = [(c, k) for c in "pq" for k in range({"p": 6, "q": 7}[c])]
            x = np.array([[value[s, u, draws[s, c, k], b] for s, u in own] for c, k in order])
            r = got[d, None, b]
            assert r["accuracy"] == pytest.approx(M.lda_cv(x, np.array([c for c, _ in order]), 5, 0)) and (r["n"], r["units"], r["conditions"]) == (13, len(own), 2) and r["theoretical"] == 0.5
        shuffled = [got[d, None, b]["shuffled"] for b in range(3)]
        assert got[d, None, 0]["chance"] == pytest.approx(np.percentile(shuffled, 99))
    whole = {(r["session"], r["bin"]) for r in O.classify_pooled(a).where("depth_group = 'all'").collect()}
    assert whole == {(s, b) for s in ("s1", "s2", None) for b in range(3)}
    with pytest.raises(ValueError, match="share"):
        O.depth_groups(units, 0.7, 0.4)
    assert groups.select(F.count_distinct("depth_group")).first()[0] == 2
