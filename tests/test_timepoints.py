"""Time points of trials, grasps with two levels and lines beyond the ends, against plain numpy."""

import math

import numpy as np
import pytest

from motorspark.operators import predicates as P
from motorspark.operators import series as W

JOINTS = {"shoulder": ["a", "b"], "elbow": ["c"], "wrist": ["d", "e"], "finger": ["f", "g"], "pose": ["a", "b"]}


def crossings(t, y, level):
    up, down = [], []
    for i in range(1, len(y)):
        if y[i] > level >= y[i - 1]:
            up.append(t[i - 1] + (level - y[i - 1]) / (y[i] - y[i - 1]) * (t[i] - t[i - 1]))
        elif y[i - 1] > level >= y[i]:
            down.append(t[i - 1] if y[i] == level else t[i])
    return up, down


def minima(y):
    return [i for i in range(1, len(y) - 1) if y[i] < y[i - 1] and y[i] < y[i + 1]]


def plain(t, force, angle, goal):
    """The time points of one trial."""
    out = dict.fromkeys(["first_grasp_start", "release", "success_grasp_start", "success_grasp_end", "shoulder_onset", "elbow_onset", "wrist_onset", "finger_onset", "hand_retreat_time", "MGA_time", "fingers_static", "release_start"])
    out["regrasp_bool"] = False
    if force.max() <= 1:
        return out
    y = (force - force.min()) / (force.max() - force.min())
    up, _ = crossings(t, y, 0.3)
    _, down = crossings(t, y, 0.1)
    pairs, free = [], -math.inf
    for u in up:
        if u < free:
            continue
        later = [x for x in down if x > u]
        if later:
            free = later[0]
            pairs.append((u, free))
        else:
            break
    pairs = [p for p in pairs if p[1] - p[0] >= 0.2]
    if not pairs:
        return out
    first, last = pairs[0], pairs[-1]
    out |= {"first_grasp_start": first[0], "release": last[1], "regrasp_bool": len(pairs) > 1}
    for a, b in pairs:
        if a <= goal <= b:
            out |= {"success_grasp_start": a, "success_grasp_end": b}
            break
    pre = (t < first[0]) & (t > first[0] - 1)
    for joint in ("shoulder", "elbow", "wrist", "finger"):
        total = 0
        for c in JOINTS[joint]:
            v = np.abs(np.diff(angle[c][pre]))
            v = v - v.min()
            total = total + (v / v.max() if v.max() > 0 else v)
        total = total / total.max()
        at = t[pre][:-1] + np.median(np.diff(t[pre])) / 2
        low = [i for i in minima(total) if total[i] < 0.25]
        start = low[-1] if low else 0
        ups = crossings(at[start:], total[start:], 0.25)[0]
        out[f"{joint}_onset"] = ups[0] if ups else None
    rest = [np.interp(first[0] - 1, t, angle[c]) for c in JOINTS["pose"]]
    post = (t > last[1]) & (t < last[1] + 3)
    far = np.sqrt(sum((angle[c][post] - p) ** 2 for c, p in zip(JOINTS["pose"], rest)))
    low = minima(far)
    if low:
        out["hand_retreat_time"] = t[post][min(low, key=lambda i: far[i])]
    near = (t >= first[0] - 0.5) & (t <= first[0])
    gap = -np.abs(angle["f"] + angle["g"])[near]
    top = minima(-gap)
    if top:
        out["MGA_time"] = t[near][max(top, key=lambda i: gap[i])]
    v = sum(np.abs(np.diff(angle[c])) for c in JOINTS["finger"])
    v = (v - v.min()) / (v.max() - v.min())
    at = t[:-1] + np.median(np.diff(t)) / 2
    part = (at >= first[0]) & (at <= first[0] + 0.5)
    down = crossings(at[part], v[part], 0.4)[1]
    part = (at >= first[1] - 0.5) & (at <= first[1])
    ups = crossings(at[part], v[part], 0.4)[0]
    out |= {"fingers_static": down[0] if down else None, "release_start": ups[-1] if ups else None}
    return out


@pytest.fixture(scope="module")
def made(spark):
    g = np.random.default_rng(5)
    t = np.arange(0, 10, 0.05) + 0.001
    force, angles, trials, want = [], [], [], {}
    for trial in range(12):
        f = 8 * np.exp(-(((t - g.uniform(3, 4)) / 0.6) ** 2)) + (5 * np.exp(-(((t - 6) / 0.4) ** 2)) if trial % 3 else 0) + g.uniform(0, 0.6, len(t))
        if trial == 11:
            f = np.minimum(f, 0.9)
        angle = {c: np.cumsum(g.normal(0, 1, len(t))) for c in "abcdefg"}
        goal = float(g.uniform(2, 7))
        want[trial] = plain(t, f, angle, goal)
        force += [("s", trial, float(x), float(y)) for x, y in zip(t, f)]
        angles += [("s", trial, c, float(x), float(y)) for c, v in angle.items() for x, y in zip(t, v)]
        trials.append(("s", trial, goal, "kept"))
    trials.append(("s", 99, 1.0, "nothing recorded"))
    return (
        spark.createDataFrame(force, "session string, trial int, t double, force double"), spark.createDataFrame(angles, "session string, trial int, channel string, t double, value double"),
        spark.createDataFrame(trials, "session string, trial int, ttl_to_success_grasp double, note string"), want,
    )


def test_trial_timepoints(made):
    force, angles, trials, want = made
    got = W.trial_timepoints(force, angles, trials, joints=JOINTS, aperture=("f", "g"), levels=(0.3, 0.1))
    rows = {r["trial"]: r.asDict() for r in got.collect()}
    assert len(rows) == 13 and rows[99]["first_grasp_start"] is None and rows[99]["note"] == "nothing recorded"
    for trial, w in want.items():
        for name, value in w.items():
            assert rows[trial][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (trial, name)
    found = sum(w["hand_retreat_time"] is not None and w["finger_onset"] is not None for w in want.values())
    assert found >= 9 and any(w["regrasp_bool"] for w in want.values()) and any(w["success_grasp_start"] for w in want.values())


def test_active_movement_is_cropped_by_them(made):
    force, angles, trials, want = made
    points = W.trial_timepoints(force, angles, trials, joints=JOINTS, aperture=("f", "g"), levels=(0.3, 0.1))
    for r in P.crop_to_period(angles, points, "active_movement").groupBy("trial").agg({"t": "min"}).collect():
        onsets = [want[r["trial"]][f"{j}_onset"] for j in ("shoulder", "elbow", "wrist", "finger")]
        assert r["min(t)"] >= min(o for o in onsets if o is not None)


def test_grasps_with_two_levels(spark):
    y = [0, 1, 5, 3, 5, 3, 1, 3, 1, 5, 1, 0]
    df = spark.createDataFrame([("s", "c", float(i), float(v)) for i, v in enumerate(y)], "session string, channel string, t double, value double")
    got = [(r["start"], r["stop"]) for r in W.grasp_events(W.two_level_crossings(df, 4.0, 2.0)).orderBy("start").collect()]
    assert got == [(1.75, 6.0), (8.75, 10.0)]
    assert W.grasp_events(W.two_level_crossings(df, 4.0, 2.0), merge_gap=3.0).count() == 1
    assert [r["start"] for r in W.grasp_events(W.two_level_crossings(df, 4.0, 2.0), min_time=2.0).collect()] == [1.75]


def test_lines_beyond_the_ends(spark):
    s = spark.createDataFrame([("s", 1.0, 2.0), ("s", 2.0, 4.0), ("s", 4.0, 5.0), ("s", 5.0, 9.0), ("one", 3.0, 7.0)], "k string, t double, value double")
    grid = spark.createDataFrame([("s", x) for x in (0.0, 1.0, 1.5, 4.5, 7.0)] + [("one", 1.0), ("one", 5.0), ("none", 1.0)], "k string, t double")
    got = {(r["k"], r["t"]): r["value"] for r in W.interpolate(grid, s, ["k"], clamp=False).collect()}
    assert got == {("s", 0.0): 0.0, ("s", 1.0): 2.0, ("s", 1.5): 3.0, ("s", 4.5): 7.0, ("s", 7.0): 17.0, ("one", 1.0): 7.0, ("one", 5.0): 7.0, ("none", 1.0): None}
