"""Values of operators that SQL has no counterpart for, against plain numpy on planted data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.functions import kernels
from motorspark.functions import stats as X
from motorspark.operators import aggregates as A
from motorspark.operators import models as O
from motorspark.operators import ordering as K
from motorspark.operators import series as W
from motorspark.sources.scratch import stored


@pytest.fixture(scope="module")
def series(spark):
    g = np.random.default_rng(3)
    data = {c: (np.arange(n) * 0.5, g.normal(size=n)) for c, n in (("a", 60), ("b", 61), ("c", 5))}
    rows = [("s", c, float(t), float(v)) for c, (ts, vs) in data.items() for t, v in zip(ts, vs)]
    return spark.createDataFrame(rows, "session string, channel string, t double, value double"), data


def by_channel(df, value):
    out = {}
    for r in df.orderBy("channel", "t" if "t" in df.columns else "frame").collect():
        out.setdefault(r["channel"], []).append(math.nan if r[value] is None else r[value])
    return {k: np.array(v, float) for k, v in out.items()}


def test_lowpass(series):
    df, data = series
    got = by_channel(W.lowpass_butter(df, 2, 5.0, 50.0), "smoothed")
    # Second order by the book: the bilinear transform of 1 / (s^2 + sqrt(2) s + 1).
    k = math.tan(math.pi * 5 / 50)
    d = 1 + math.sqrt(2) * k + k * k
    b, a = (k * k / d, 2 * k * k / d, k * k / d), (2 * (k * k - 1) / d, (1 - math.sqrt(2) * k + k * k) / d)
    for c, (_, x) in data.items():
        y = []
        for i in range(len(x)):
            y.append(sum(b[j] * x[i - j] for j in range(3) if i >= j) - sum(a[j] * y[i - 1 - j] for j in range(2) if i > j))
        assert np.allclose(got[c], y)


def test_decimate(series):
    df, data = series
    got = by_channel(W.decimate(df, 5), "value")
    n = np.arange(-50, 51)
    h = np.sinc(n / 5) / 5 * (0.54 + 0.46 * np.cos(np.pi * n / 50))
    h /= h.sum()
    for c, (_, x) in data.items():
        padded = np.append(x, x[-1]) if len(x) % 5 else x
        want = [sum(h[j + 50] * padded[i - j] for j in range(-50, 51) if 0 <= i - j < len(padded)) for i in range(0, len(padded), 5)]
        assert np.allclose(got[c], want[: -(-len(x) // 5)])


def test_median_that_skips_nulls_and_marker_cleanup(spark, series):
    from pyspark.sql import functions as F

    df, data = series
    holes = df.withColumn("value", F.when(F.floor(F.col("t") * 2) % 7 < 4, F.col("value")))
    got = by_channel(W.nan_median_filter(holes, ["session", "channel"], 5), "smoothed")
    gappy = {c: np.where(np.arange(len(x)) % 7 < 4, x, np.nan) for c, (_, x) in data.items()}

    def median(x):
        out = x.copy()
        for i in range(2, len(x) - 2):
            part = x[i - 2 : i + 3]
            out[i] = np.median(part[~np.isnan(part)]) if np.isnan(part).sum() <= 2 else np.nan
        return out

    for c, x in gappy.items():
        assert np.allclose(got[c], median(x), equal_nan=True)
    m = df.withColumns({"confidence": F.when(F.floor(F.col("t") * 2) % 7 < 4, 0.9).otherwise(0.1), "frame": (F.col("t") * 2).cast("int")})
    got = by_channel(W.marker_cleanup(m, ["session", "channel"], 0.5, 5, 1.0), "cleaned")
    for c, x in gappy.items():
        y = median(x)
        want = []
        for i in range(len(y)):
            at = [(y[min(max(i + j, 0), len(y) - 1)], math.exp(-0.5 * j * j)) for j in range(-4, 5)]
            good = [(v, k) for v, k in at if not math.isnan(v)]
            want.append(sum(v * k for v, k in good) / sum(k for _, k in good) if good else math.nan)
        assert np.allclose(got[c], want, equal_nan=True)


def test_samples_of_trials(spark):
    t = spark.createDataFrame([(s, i, i % (2 + (s == "b"))) for s in "ab" for i in range(9 + 6 * (s == "b"))] + [("c", 1, 0)], "session string, trial int, condition int")
    one, two, other = ({tuple(r) for r in K.sample_trials(t.select("session", "trial"), 4, seed=k).collect()} for k in (1, 1, 2))
    assert one == two != other and {s: sum(x[0] == s for x in one) for s in "abc"} == {"a": 4, "b": 4, "c": 1}
    p = K.pseudopopulation(t.where("session <> 'c'")).collect()
    # Condition 2 is in b only; conditions 0 and 1 have 5 and 4 trials in a, 5 and 5 in b.
    assert {r["condition"] for r in p} == {0, 1}
    for s in "ab":
        for c, n in ((0, 5), (1, 4)):
            own = [r for r in p if r["session"] == s and r["condition"] == c]
            assert sorted(r["draw"] for r in own) == list(range(n)) and len({r["trial"] for r in own}) == n


def test_align_trial(spark):
    g = np.random.default_rng(4)
    tj, tf = np.arange(0, 4, 0.1), np.arange(0.35, 3.6, 0.03)
    v = {c: g.normal(size=len(tj)) for c in "xy"}
    sensels = g.uniform(0, 1, size=(len(tf), 3))
    joints = spark.createDataFrame([("s", 0, c, float(t), float(a)) for c in v for t, a in zip(tj, v[c])], "session string, trial int, channel string, t double, value double")
    frames = spark.createDataFrame([("s", 0, float(t), x.tolist()) for t, x in zip(tf, sensels)], "session string, trial int, t double, sensels array<double>")
    got = W.align_trial(joints, frames).orderBy("channel", "t").collect()
    step = float(np.median(np.diff(tj)))
    grid = tf[0] + step * np.arange(int((min(tj[-1], tf[-1]) - tf[0]) / step) + 1)
    for c in v:
        own = [r for r in got if r["channel"] == c]
        assert np.allclose([r["t"] for r in own], grid) and np.allclose([r["value"] for r in own], np.interp(grid, tj, v[c]))
        force = sensels.sum(1)
        want = [np.median(part) if len(part := force[(tf >= t - step / 2) & (tf < t + step / 2)]) else 0.0 for t in grid]
        assert np.mean(np.isclose([r["force"] for r in own], want)) > 0.9  # cells whose border is a sample's time may round either way


def test_stable_period(spark):
    g = np.random.default_rng(5)
    t = np.arange(0, 3, 0.02)
    step = np.where((t > 1.4) & (t < 1.7), 0.01, 1.0)
    rows = []
    for m in "pq":
        xyz = np.cumsum(g.normal(size=(len(t), 3)) * step[:, None], 0)
        rows += [("s", m, float(a), *map(float, b)) for a, b in zip(t, xyz)]
    got = W.stable_period(spark.createDataFrame(rows, "session string, marker string, t double, x double, y double, z double")).first()
    assert 1.4 <= (got["start"] + got["stop"]) / 2 <= 1.7 and got["stop"] - got["start"] == pytest.approx(0.3)


def test_pca_scores(spark):
    g = np.random.default_rng(6)
    x = g.normal(size=(150, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.3, 0.5]])
    d = spark.createDataFrame([(i, "k", *map(float, v)) for i, v in enumerate(x)], "i int, k string, a double, b double, c double")
    got = {}
    for r in O.pca_scores(d, ["a", "b", "c"], O.pca(d, ["a", "b", "c"], 2, ["k"]), ["k"]).collect():
        got[r["i"], r["component"]] = r["score"]
    z = (x - x.mean(0)) / x.std(0)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    for k in range(2):
        own = np.array([got[i, k] for i in range(150)])
        assert abs(np.corrcoef(own, u[:, k] * s[k])[0, 1]) > 1 - 1e-9 and own.std() == pytest.approx((u[:, k] * s[k]).std())


def test_demixed_pca_tells_time_from_condition(spark):
    g = np.random.default_rng(7)
    time, cond = g.normal(size=12), g.normal(size=12)
    rows = []
    for u in range(12):
        for c in range(3):
            for b in range(20):
                rows.append(("s", u, c, b, float(3 * time[u] * np.sin(b / 3)), float(2 * cond[u] * (c - 1))))
    d = spark.createDataFrame(rows, "session string, unit_id int, condition int, bin int, m_time double, m_condition double")
    got = {(r["part"], r["component"]): r for r in O.demixed_pca(d, 1).collect()}
    assert set(got) == {("time", 0), ("condition", 0)}
    for part, direction in (("time", time), ("condition", cond)):
        assert abs(np.corrcoef(got[part, 0]["encoder"], direction)[0, 1]) > 0.99
    assert 0.9 < got["time", 0]["explained"] + got["condition", 0]["explained"] < 1.01
    # Projections of the averages, with the band of the standard errors.
    mean, sem = g.normal(size=(12, 3, 20)), g.random((12, 3, 20))
    peth = spark.createDataFrame([("s", u, c, b, float(mean[u, c, b]), float(sem[u, c, b]) if u else None) for u in range(12) for c in range(3) for b in range(20)], "session string, unit_id int, condition int, bin int, rate_avg double, rate_sem double")
    sem[0] = 0
    traces = {(r["part"], r["condition"], r["bin"]): (r["trace"], r["band"]) for r in O.demixed_traces(peth, O.demixed_pca(d, 1)).collect()}
    for part in ("time", "condition"):
        w = np.array(got[part, 0]["decoder"])
        want, band = np.tensordot(w, mean, 1), np.sqrt(np.tensordot(w**2, sem**2, 1))
        assert all(traces[part, c, b] == pytest.approx((want[c, b], band[c, b])) for c in range(3) for b in range(20))
    assert len(traces) == 120


def test_shuffle_alignment_rolls_each_trial(spark):
    rows = [("s", t, b, [float(b), float(t)]) for t in range(6) for b in range(7)]
    d = spark.createDataFrame(rows, "session string, trial int, bin int, x array<double>")
    got, shifts = {}, set()
    for r in O.shuffle_alignment(d, "x").collect():
        got.setdefault(r["trial"], {})[r["bin"]] = r["x"]
    for t, v in got.items():
        firsts = [v[b][0] for b in range(7)]
        k = int(firsts.index(0.0))
        assert firsts == np.roll(np.arange(7.0), k).tolist() and k > 0 and all(x[1] == t for x in v.values())
        shifts.add(k)
    assert len(shifts) > 1


def test_encoding_pairs(spark):
    g = np.random.default_rng(8)
    a = g.normal(size=12)
    d = spark.createDataFrame([("s", i, p, float(v)) for p, x in (("p1", a), ("p2", a + 0.5 + 0.1 * g.normal(size=12))) for i, v in enumerate(x)] + [("s", 99, "p1", 0.0)], "session string, unit_id int, predictor string, adj_pr2 double")
    r = X.encoding_pair_tests(d).first()
    # All twelve differences have one sign: p is 2 / 2^12.
    assert (r["predictor_a"], r["predictor_b"]) == ("p1", "p2") and r["p"] == pytest.approx(2 / 2**12) and r["r"] == -1.0 and -0.7 < r["median_difference"] < -0.3


def test_exact_rank_sums_count_all_orders():
    import itertools

    for n1, n2 in ((1, 4), (3, 4), (4, 3), (2, 6)):
        us = [sum(a) - n1 * (n1 - 1) // 2 for a in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            greater = np.mean([x >= u for x in us])
            assert kernels.mann_whitney_p(u, n1, n2, 0, "greater") == pytest.approx(greater)
            assert kernels.mann_whitney_p(u, n1, n2, 0, "less") == pytest.approx(np.mean([x <= u for x in us]))
    assert kernels.mann_whitney_p(4e6, 8, 1_000_000, 0) == pytest.approx(1.0, abs=1e-3)


def test_ranks_and_quantiles_of_one_key_over_many_tasks(spark):
    g = np.random.default_rng(8)
    values = np.round(g.normal(size=60_000), 2)  # many ties
    rows = [("k", "ab"[i % 2], float(v)) for i, v in enumerate(values)] + [(None, "a", 1.0), (None, "b", 2.0), (None, "b", None)]
    d = spark.createDataFrame(rows, "k string, g string, x double").repartition(5)
    counts = d.where("x IS NOT NULL").groupBy("k", "x").agg(F.count(F.lit(1)).alias("ties"))
    ranked = X.average_ranks(counts, ["k"], "x")
    got = {r["x"]: r["rank"] for r in ranked.where("k = 'k'").collect()}
    order = np.sort(values)
    low, high = np.searchsorted(order, values), np.searchsorted(order, values, side="right")
    assert got == dict(zip(values.tolist(), ((low + 1 + high) / 2).tolist(), strict=True))
    # No range holds all values of the key.
    ranges = stored(counts.repartitionByRange(4, "k", "x"), "ranges").where("k = 'k'").groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(ranges) >= 3 and max(r["count"] for r in ranges) < 0.7 * len(got)
    a, b = values[::2], values[1::2]
    rank = dict(zip(values.tolist(), ((low + 1 + high) / 2).tolist(), strict=True))
    found = {r["k"]: r for r in X.mann_whitney(d, ["k"], "g", "x", "a", "b").collect()}
    assert found["k"]["u"] == sum(rank[v] for v in a.tolist()) - 30_000 * 30_001 / 2 and (found["k"]["n1"], found["k"]["n2"]) == (30_000, 30_000)
    assert found[None]["u"] == 0 and found[None]["n2"] == 1
    h = {r["k"]: r for r in X.kruskal(d, ["k"], "g", "x").collect()}
    n = 60_000
    ties = sum(int(c) ** 3 - int(c) for c in np.unique(values, return_counts=True)[1])
    want = (12 / (n * (n + 1)) * sum(sum(rank[v] for v in part.tolist()) ** 2 / 30_000 for part in (a, b)) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert h["k"]["h"] == pytest.approx(want, abs=1e-6) and h["k"]["groups"] == 2 and h[None]["n"] == 2
    shares = {"q0": 0.0, "q1": 0.25, "m": 0.5, "odd": 0.3371, "q4": 1.0}
    q = {r["k"]: r for r in X.quantiles(d, ["k"], "x", shares).collect()}
    assert [q["k"][c] for c in shares] == pytest.approx(np.quantile(values, list(shares.values())).tolist(), abs=1e-12)
    assert q[None]["m"] == 1.5 and A.data_stats(d, ["k"], "x").where("k IS NULL").first()["median"] == 1.5
