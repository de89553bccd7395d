"""Steps whose work or memory grew faster than their input, and files that larger inputs split."""

from pyspark.sql import functions as F

from motorspark.functions import stats as X
from motorspark.operators import alignment as L
from motorspark.operators import models as M
from motorspark.operators import pairing as J
from motorspark.operators import series as W
from motorspark.sources import tables as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_frame_reaches_to_the_end_of_a_series(spark):
    s = spark.range(5).select(F.lit(0).alias("session"), F.lit("c").alias("channel"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 2 == 0, F.col("id") * 10.0).alias("value"))
    keys = ["session", "channel"]
    g = s.select(*keys, (F.col("t") - 0.5).alias("t"))
    made = {
        "held": W.interpolate(g, s, keys), "extended": W.interpolate(g, s, keys, clamp=False), "filled": W.fill_gaps(s, keys).select(F.col("filled").alias("value"), "t"),
        "nearest": J.nearest_time_join(g, s, keys=keys).select(F.col("nearest_t").alias("value"), "t"),
    }
    assert all("currentrow$(), unboundedfollowing$()" not in plan(df) for df in made.values())
    got = {k: [r["value"] for r in df.orderBy("t").collect()] for k, df in made.items()}
    assert got["held"] == [0.0, 5.0, 15.0, 25.0, 35.0] and got["extended"] == [-5.0, 5.0, 15.0, 25.0, 35.0]
    assert got["filled"] == [0.0, 10.0, 20.0, 30.0, 40.0] and got["nearest"] == [0.0, 0.0, 1.0, 2.0, 3.0]


def test_head_and_body_stay_in_one_file(spark, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        s = spark.range(8 * 4000).select((F.col("id") % 8).alias("session"), F.floor(F.col("id") / 8).cast("double").alias("t"), F.lit("a").alias("channel"), F.rand(1).alias("value"))
        path = str(tmp_path / "motion")
        S.write_lines(S.motion_lines(s, ["a"], ("session",)), path, ("session",))
        assert {len(list(d.glob("*.txt"))) for d in (tmp_path / "motion").glob("session=*")} == {1}
        assert S.read_motion(spark, f"{path}/session=*").count() == 8 * 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        S.write_lines(spark.range(64).select(F.col("id").alias("file"), F.lit(0).alias("pos"), F.lit("a").alias("line")), str(tmp_path / "lines"))
        samples = spark.range(64).select(F.col("id").alias("session"), F.lit(1.0).alias("t"), F.lit("a").alias("channel"), F.lit(2.0).alias("value"))
        S.write_timed_csv(samples, str(tmp_path / "timed"), ["a"], ("session",))
        for name in ("lines", "timed"):
            files = list((tmp_path / name).glob("*=*/part-*"))
            assert len(files) == 64 and len({f.name.split("-")[1] for f in files}) > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_absent_trials_by_counts(spark):
    a = spark.createDataFrame([("s", t, i) for i, t in enumerate([1] * 3 + [2] + [4] + [None])], "session string, trial_num int, seq int")
    b = spark.createDataFrame([("s", t, i) for i, t in enumerate([1] + [2] * 2 + [4] + [None])], "session string, trial_num int, seq int")
    made = J.absent_trials(a, b)
    assert made.dtypes == [("session", "string"), ("trial_num", "int"), ("dup_index", "int"), ("missing_in", "string")] and "window" not in plan(made)
    got = sorted(((r["trial_num"] or -1, r["dup_index"], r["missing_in"]) for r in made.collect()))
    assert got == [(-1, 0, "a"), (-1, 0, "b"), (1, 1, "b"), (1, 2, "b"), (2, 1, "a")]
    many = spark.range(20_000).select(F.lit("s").alias("session"), F.lit(7).alias("trial_num"))
    left = J.absent_trials(many, many.limit(1))
    assert left.agg(F.min("dup_index"), F.max("dup_index"), F.count_distinct("dup_index")).first()[:] == (1, 19_999, 19_999) and left.count() == 19_999


def test_few_large_keys_are_not_shuffled(spark):
    d = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") % 7 + 1.0).alias("y"), (F.col("id") % 5 + 1.0).alias("mu"))
    p = X.poisson_pr2(d, ["k"], "y", "mu")
    assert "window" not in plan(p) and "BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["n"] for r in p.collect()} == {None: 134, 1: 133, 2: 133}
    rows = d.where("k IS NOT NULL").withColumn("id", F.monotonically_increasing_id())
    s = M.pca_scores(rows, ["y", "mu"], M.pca(rows, ["y", "mu"], 2, ["k"]), ["k"])
    assert "SortMergeJoin" not in s._jdf.queryExecution().executedPlan().toString() and s.count() == 2 * 266


def test_clock_of_a_trial_is_neither_shuffled_nor_sorted(spark):
    # A median step of 1 and gaps of 500: the clock has many more points than there are samples.
    times = [0.0, 1.0, 2.0, 502.0, 503.0, 504.0, 505.0]
    joints = spark.createDataFrame([("s", 0, c, t, None if c == "n" else t * 2 if c == "a" else 1.0) for c in "abn" for t in times if c != "b" or t == 502.0], "session string, trial int, channel string, t double, value double")
    frames = spark.createDataFrame([("s", 0, t, [t, 1.0]) for t in (0.0, 2.25, 2.5, 300.4, 505.0)], "session string, trial int, t double, sensels array<double>")
    made = W.align_trial(joints, frames)
    p = plan(made)
    assert p.index("generate explode") < p.index("window")
    got = {c: sorted((r["t"], r["value"], r["force"]) for r in made.where(F.col("channel") == c).collect()) for c in "ab"}
    force = {0.0: 1.0, 2.0: 3.25, 3.0: 3.5, 300.0: 301.4, 505.0: 506.0}
    assert got["a"] == [(float(t), 2.0 * t, force.get(float(t), 0.0)) for t in range(506)]
    assert got["b"] == [(t, 1.0, f) for t, _, f in got["a"]]
    none = made.where("channel = 'n'")
    assert none.count() == 506 and none.where("value IS NOT NULL").count() == 0


def test_samples_are_not_copied_for_comparisons(spark, monkeypatch):
    rates = spark.createDataFrame([(1, 0, 7, float(b), 1.0 * b) for b in range(6)], "session int, trial int, unit_id int, t double, rate double")
    signals = [(1, 0, s, c, float(b), b * k) for s, c, k in (("joint_angles", "a", 2.0), ("joint_angles", None, 3.0), ("segment_forces", "a", 5.0), ("torques", "a", 7.0), ("other", "a", 9.0)) for b in (0, 2, 5)]
    s = spark.createDataFrame(signals, "session int, trial int, signal string, channel string, t double, value double")
    ordered, interpolate = [], W.interpolate

    def counted(grid, samples, *args, **kwargs):
        ordered.append(samples.count())
        return interpolate(grid, samples, *args, **kwargs)

    monkeypatch.setattr(W, "interpolate", counted)
    pair = {"twice": (("joint_angles", "joint_angles"), "active_movement")}
    got = {(r["comparison"], r["bin"]): (r["y"], r["blocks"]) for r in L.comparison_designs(rates, s, L.COMPARISONS | pair).collect()}
    assert ordered == [12]  # four channels of three samples; before, each once a comparison and block
    blocks = {"joint_angles": ([3.0, 2.0], [2]), "joint_angles_segment_forces": ([3.0, 2.0, 5.0], [2, 1]), "joint_angles_torques": ([3.0, 2.0, 7.0], [2, 1]), "twice": ([3.0, 2.0, 3.0, 2.0], [2, 2])}
    assert got == {(c, float(b)): ([b * k for k in y], n) for c, (y, n) in blocks.items() for b in range(6)}
