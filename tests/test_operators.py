import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.functions import kernels
from motorspark.functions import scalars as C
from motorspark.functions import stats as X
from motorspark.operators import aggregates as A
from motorspark.operators import ordering as K
from motorspark.operators import pairing as J
from motorspark.operators import predicates as P
from motorspark.operators import series as W


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def series(spark, ys, key=0):
    return spark.createDataFrame([(key, "c", float(i + 1), float(y)) for i, y in enumerate(ys)], "session int, channel string, t double, value double")


def test_crossings(spark):
    got = rows(W.threshold_crossings(series(spark, [3, 2, 5, 7, 1]), 4.0), "crossing", "direction")
    assert got[0] == (pytest.approx(8 / 3), "up") and got[1] == (5.0, "down")
    # Where the value after falls exactly on the threshold the time is the one before.
    assert rows(W.threshold_crossings(series(spark, [5, 4, 4]), 4.0), "crossing") == [(1.0,)]


def test_merge_pairs(spark):
    c = spark.createDataFrame([(0, "c", t, d) for t, d in [(1.0, "up"), (3.0, "down"), (4.5, "up"), (6.0, "down"), (8.0, "up"), (10.0, "down")]], "session int, channel string, crossing double, direction string")
    assert rows(W.grasp_events(c, merge_gap=2.0), "start", "stop") == [(1.0, 10.0)]
    assert rows(W.grasp_events(c, merge_gap=1.5), "start", "stop") == [(1.0, 6.0), (8.0, 10.0)]


def test_occurrences_and_duplicates(spark):
    log = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (0, 3, 6)], "session int, seq int, trial_num int")
    assert rows(J.with_occurrence(log, ["session", "trial_num"]), "trial_num", "dup_index") == [(5, 0), (5, 1), (6, 0)]
    dup = spark.createDataFrame([(0, i, t) for i, t in enumerate([1, 2, 2, 3])], "session int, seq int, trial_num int")
    assert rows(A.find_duplicate_trials(dup), "trial_num", "n", "total") == [(2, 2, 4)]
    empty = log.where("false")
    assert J.common_trials(log, empty).count() == 3


def test_spikes_in_windows_is_open(spark):
    s = spark.createDataFrame([(0, "u", t) for t in (0.0, 1.0, 1.5, 2.0)], "session int, unit_id string, t double")
    w = spark.createDataFrame([(0, 0, 1.0, 2.0)], "session int, trial int, start double, stop double")
    assert rows(J.spikes_in_windows(s, w, width=1.0, relative=False), "t") == [(1.5,)]


def test_active_period(spark):
    f = spark.createDataFrame([("s", float(i), float(x)) for i, x in enumerate([0, 1, 0, 10, 0])], "sensor string, t double, force double")
    assert rows(A.active_period(f), "first", "stop") == [(1, 4)]
    assert A.active_period(f.withColumn("force", F.lit(0.0))).count() == 0


def test_rank_fraction_and_binned_mean(spark):
    u = spark.createDataFrame([(0, i, d) for i, d in enumerate([1.0, 2.0, math.nan, 3.0, 4.0])], "session int, unit_id int, depth double")
    assert rows(K.rank_fraction(u, "depth", 0.25, 0.25), "depth", "part") == [(1.0, "bottom"), (4.0, "top")]
    b = spark.createDataFrame([(float(x), 1.0) for x in (0, 1, 2)], "c double, v double")
    assert rows(A.binned_mean_rows(b, "c", "v", 2), "bin", "n") == [(0, 1), (1, 2)]


def test_mode_lag_and_format_p(spark):
    d = spark.createDataFrame([(0, x) for x in (0.1, 0.2, 0.1, 0.2)], "session int, lag double")
    assert rows(A.mode_lag(d, ["session"]), "mode_lag") == [(0.1,)]
    p = spark.createDataFrame([(0.00005,), (0.0042,), (0.03,)], "p double")
    assert [r[0] for r in p.select(C.format_p("p")).collect()] == ["p < 0.0001", "p = 0.004", "p = 0.03"]


def test_natural_sort_and_sessions(spark):
    d = spark.createDataFrame([("a10",), ("a9",)], "x string")
    assert [r[0] for r in K.natural_sort(d, "x").collect()] == ["a9", "a10"]
    s = spark.createDataFrame([("2022_03_01_Set1",), ("junk",)], "session string")
    got = P.select_sessions(s).collect()
    assert len(got) == 1 and str(got[0]["date"]) == "2022-03-01" and got[0]["set_number"] == 1


def test_pair_pulses(spark):
    pulses = spark.createDataFrame([(0, i) for i in range(4)], "session int, pulse_idx int")
    trials = spark.createDataFrame([(0, i) for i in range(3)], "session int, trial_pos int")
    paired, differ = J.pair_pulses_to_trials(pulses, trials, skip=1)
    assert rows(paired, "pulse_idx", "trial_pos") == [(1, 0), (2, 1), (3, 2)] and differ.count() == 0
    _, differ = J.pair_pulses_to_trials(pulses, trials)
    assert rows(differ, "pulses", "trials") == [(4, 3)]


def test_gaussian_matches_kernel(spark):
    x = np.random.default_rng(0).poisson(3, 20).astype(float)
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, bin int, n double")
    got = [r[0] for r in W.gaussian_smooth(d, 2.0, 20, ["k"]).orderBy("bin").select("rate").collect()]
    assert np.allclose(got, kernels.gaussian(x, 2.0)) and np.isclose(sum(got), x.sum())


def test_windows_match_kernels(spark):
    y = np.random.default_rng(1).normal(size=30)
    d = series(spark, y)
    keys = ["session", "channel"]
    got = lambda df, c: np.array([r[0] for r in df.orderBy("t").select(c).collect()], float)
    assert np.allclose(got(W.moving_average(d, 4, keys), "smoothed"), kernels.moving_average(y, 4))
    assert np.allclose(got(W.median_filter(d, keys), "smoothed"), kernels.median_zero(y))
    assert np.allclose(got(W.causal_smooth(d, 1.5, keys, "t", "value"), "rate"), kernels.causal_halfgaussian(y, 1.5))
    assert np.allclose(got(W.joint_velocity(d), "velocity"), np.gradient(y, np.arange(1.0, 31.0)))
    assert np.allclose(got(W.lowpass_butter(d, 2, 5.0, 50.0), "smoothed"), kernels.lowpass(y, 2, 5.0, 50.0))


def test_butterworth_gains():
    # A constant passes, the cutoff is halved in power.
    assert np.isclose(kernels.lowpass(np.ones(2000), 4, 5.0, 100.0)[-1], 1.0)
    t = np.arange(4000) / 100
    y = kernels.lowpass(np.sin(2 * np.pi * 5 * t), 3, 5.0, 100.0)
    assert np.isclose(np.sqrt(2 * np.mean(y[2000:] ** 2)), math.sqrt(0.5), atol=1e-3)


def test_interpolate(spark):
    s = series(spark, [1, 3, 2])
    g = spark.createDataFrame([(0, "c", t) for t in (0.0, 1.5, 3.0, 4.0)], "session int, channel string, t double")
    at = lambda clamp: [r[0] for r in W.interpolate(g, s, ["session", "channel"], clamp=clamp).orderBy("t").select("value").collect()]
    assert at(True) == [1.0, 2.0, 2.0, 2.0] and at(False) == [-1.0, 2.0, 2.0, 1.0]


def test_nearest_and_unmatched(spark):
    a = spark.createDataFrame([(0, 1.0), (0, 2.5), (0, 9.0)], "session int, t double")
    b = spark.createDataFrame([(0, 2.0), (0, 3.0)], "session int, t double")
    assert rows(J.nearest_time_join(a, b, keys=["session"]), "t", "nearest_t") == [(1.0, 2.0), (2.5, 2.0), (9.0, 3.0)]
    assert rows(J.unmatched_events(a, b, 1.0, keys=["session"]), "t") == [(9.0,)]


def test_rank_tests(spark):
    d = spark.createDataFrame([(0, "a", float(x)) for x in (1, 2, 3)] + [(0, "b", float(x)) for x in (4, 5, 6)], "k int, g string, x double")
    r = X.mann_whitney(d, ["k"], "g", "x", "a", "b").first()
    assert r["u"] == 0 and r["r"] == 1.0 and r["p"] == pytest.approx(0.1)
    r = X.kruskal(d, ["k"], "g", "x").first()
    assert r["h"] == pytest.approx(27 / 7) and r["p"] == pytest.approx(math.erfc(math.sqrt(27 / 14)))
    p = spark.createDataFrame([(0, float(i), 0.0) for i in range(1, 7)], "k int, a double, b double")
    r = X.signed_rank(p, ["k"], "a", "b").first()
    assert r["w"] == 0 and r["p"] == pytest.approx(2 / 64) and r["r"] == 1.0


def test_adjusted_pr2(spark):
    d = spark.createDataFrame([(0, float(i % 3), 1.0 + (i % 3) * 0.5) for i in range(11)], "k int, y double, mu double")
    r = X.poisson_pr2(d, ["k"], "y", "mu", 2).first()
    assert r["adj_pr2"] == pytest.approx(1 - (1 - r["pr2"]) * 10 / 8)


def test_lag_zero_is_correlation(spark):
    g = np.random.default_rng(2)
    x, y = g.normal(size=20), g.normal(size=20)
    f = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(x)], "session int, trial int, bin int, force double")
    r = spark.createDataFrame([(0, 0, "u", i, float(v)) for i, v in enumerate(y)], "session int, trial int, unit_id string, bin int, rate double")
    got = {k: v for k, v in W.lagged_crosscorrelation(f, r, [0, 2]).select("lag", "r").collect()}
    assert got[0] == pytest.approx(np.corrcoef(x, y)[0, 1]) and got[2] == pytest.approx(np.corrcoef(x[:-2], y[2:])[0, 1])


def test_pseudopopulation(spark):
    t = spark.createDataFrame([(s, c, i) for s in "ab" for c in (0, 1) for i in range(3 + (s == "b"))] + [("a", 2, 0)], "session string, condition int, trial int")
    got = K.pseudopopulation(t)
    assert rows(got.groupBy("session", "condition").count(), "session", "condition", "count") == [("a", 0, 3), ("a", 1, 3), ("b", 0, 3), ("b", 1, 3)]


def test_reports(spark):
    m = spark.createDataFrame([(0, "s", None, None), (0, "s", 1.0, None), (0, "s", 2.0, 1.0), (0, "s", 1.0, 2.0)], "session int, stage string, input_time double, output_time double")
    r = A.processing_status(m).first()
    assert (r["neg"], r["zer"], r["pos"], r["cor"]) == (1, 1, 1, 1)
