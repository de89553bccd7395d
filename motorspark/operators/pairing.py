"""Joins: logs to trials, pulses to trials, events to samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions.columns import numbered

#: Occurrences that one row gives at once.
STEP = 8192


def with_occurrence(log: DataFrame, keys: Sequence[str], order: str = "seq", name: str = "dup_index") -> DataFrame:
    """Number the rows of each key from 0, in the order of ``order``."""
    return numbered(log, keys, [order], name)


def common_trials(first: DataFrame, *others: DataFrame, keys: Sequence[str] = ("session",), trial: str = "trial_num") -> DataFrame:
    """Rows of ``first`` whose (trial, occurrence) is in every other log that isn't empty, with ``trial_pos`` in its order."""
    by = [*keys, trial]
    found = with_occurrence(first, by)
    for log in others:
        if log.isEmpty():
            continue
        found = found.join(with_occurrence(log, by).select(*by, "dup_index"), [*by, "dup_index"], "left_semi")
    return numbered(found, keys, ["seq"], "trial_pos")


def absent_trials(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("session",), trial: str = "trial_num") -> DataFrame:
    """Trial occurrences in one log and not in the other, with ``missing_in`` = a or b.

    Occurrences are numbered from 0, so counts give those that one log has and
    the other hasn't: no log is sorted. Long runs are made in steps.
    """
    by = [*keys, trial]
    left, right = (x.groupBy(*by).agg(F.count(F.lit(1)).alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    n = left.join(right, by, "full_outer").na.fill(0, ["_a", "_b"]).where("_a <> _b")
    lo, hi = F.least("_a", "_b"), F.greatest("_a", "_b") - 1
    runs = n.select(*by, F.when(F.col("_a") > F.col("_b"), "b").otherwise("a").alias("missing_in"), hi.alias("_hi"), F.explode(F.sequence(lo, hi, F.lit(STEP).cast("long"))).alias("_lo"))
    last = F.least(F.col("_lo") + (STEP - 1), F.col("_hi"))
    return runs.select(*by, F.explode(F.sequence(F.col("_lo").cast("int"), last.cast("int"))).alias("dup_index"), "missing_in")


def pair_pulses_to_trials(
    pulses: DataFrame, trials: DataFrame, keys: Sequence[str] = ("session",), pulse_order: str = "pulse_idx", trial_order: str = "trial_pos",
    skip: int = 0, skip_last: int = 0, skip_pulses: Sequence[int] = (), skip_trials: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """Pair by position; a positive skip drops pulses, a negative one trials. Also the sessions whose counts differ."""

    def trimmed(df: DataFrame, order: str, drop: Sequence[int], head: int, tail: int) -> DataFrame:
        kept = df.where(~F.col(order).isin(list(drop))) if drop else df
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        kept = numbered(kept, keys, [order], "_p").withColumn("_n", n)
        return kept.where((F.col("_p") >= head) & (F.col("_p") < F.col("_n") - tail)).withColumn("position", (F.col("_p") - head).cast("int")).drop("_p", "_n")

    left = trimmed(pulses, pulse_order, skip_pulses, max(skip, 0), max(skip_last, 0))
    right = trimmed(trials, trial_order, skip_trials, max(-skip, 0), max(-skip_last, 0))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    differing = count(left, "pulses").join(count(right, "trials"), list(keys), "full").na.fill(0, ["pulses", "trials"]).where("pulses <> trials")
    return left.join(right, [*keys, "position"]), differing


def spikes_in_windows(spikes: DataFrame, windows: DataFrame, keys: Sequence[str] = ("session",), width: float = 3600.0, relative: bool = True) -> DataFrame:
    """Spikes with start < t < stop, by an equi-join on keys and time buckets of ``width``; never all pairs."""
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = windows.withColumn("_b", F.explode(F.sequence(bucket("start"), bucket("stop"))))
    found = spikes.withColumn("_b", bucket("t")).join(spread, [*keys, "_b"]).where("t > start AND t < stop").drop("_b")
    return found.withColumn("t", F.col("t") - F.col("start")) if relative else found


def attach_timepoints(trials: DataFrame, timepoints: DataFrame, keys: Sequence[str] = ("session", "trial_number", "dup_index")) -> DataFrame:
    """Left join of the timepoints, with ``has_timepoints``; duplicates of the key are an error in ``duplicate_timepoints``."""
    n = timepoints.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = trials.join(timepoints.withColumn("has_timepoints", F.lit(True)), list(keys), "left").join(n, list(keys), "left")
    return found.withColumn("has_timepoints", F.coalesce("has_timepoints", F.lit(False))).withColumn("duplicate_timepoints", F.coalesce(F.col("_n") > 1, F.lit(False))).drop("_n")


def get_timepoint(*candidates: str) -> Column:
    """The first candidate that is a finite number."""
    return F.coalesce(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in candidates])


def attach_condition(trials: DataFrame, objects: DataFrame, column: str, keys: Sequence[str] = ("session", "object_id")) -> DataFrame:
    """The object's definition value as ``condition``; Spark broadcasts the objects where they are small."""
    return trials.join(objects.select(*keys, F.col(column).alias("condition")), list(keys), "left")


def asof_last(left: DataFrame, right: DataFrame, value: str, left_time: str, right_time: str, keys: Sequence[str] = (), bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each row of ``left`` the last ``value`` of ``right`` with right_time <= left_time; null when there is none.

    ``bucket`` gives a time's bucket, which mustn't fall as time rises. With it
    a key's rows are ordered within their bucket only, and each bucket takes
    over the last value of those before it: one row for each bucket is ordered as a whole.
    """
    sides = left.withColumns({"_t": F.col(left_time), "_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(True)})
    other = right.select(*keys, F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    both = sides.unionByName(other, allowMissingColumns=True)
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left").drop("_t", "_v", "_left")
    both = both.withColumn("_b", bucket(F.col("_t")))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t"))).alias("_end"))
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c"), "_before")
    same = F.col("_b").eqNullSafe(F.col("_c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left").join(ends, same, "left")
    return found.withColumn(value, F.coalesce(value, "_before")).drop("_t", "_v", "_left", "_b", "_c", "_before", *[f"_k{i}" for i in range(len(keys))])


def nearest_time_join(left: DataFrame, right: DataFrame, time: str = "t", keys: Sequence[str] = (), name: str = "nearest_t") -> DataFrame:
    """For each row of ``left`` the nearest time of ``right``, ties to the earlier, and ``distance``."""
    sides = left.withColumns({"_t": F.col(time), "_left": F.lit(1), "_v": F.lit(None).cast("double")})
    other = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_left"), F.col(time).cast("double").alias("_v"))
    both = sides.unionByName(other, allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    # From the end backwards: a frame that reaches to the end is added up anew for every row, which is quadratic.
    after = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_left").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last("_v", ignorenulls=True).over(before), "_b": F.last("_v", ignorenulls=True).over(after)}).where("_left = 1")
    near = F.when(F.col("_b").isNull() | (F.col("_t") - F.col("_a") <= F.col("_b") - F.col("_t")), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn(name, near).withColumn("distance", F.abs(F.col("_t") - F.col(name))).drop("_t", "_left", "_v", "_a", "_b")


def nearest_sample(time: Column, rate: float) -> Column:
    """Index of the nearest sample on a regular clock; halves go to even."""
    return F.bround(time * rate).cast("long")


def unmatched_events(left: DataFrame, right: DataFrame, tolerance: float, time: str = "t", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` with no time of ``right`` within ``tolerance``."""
    found = nearest_time_join(left, right, time, keys)
    return found.where(F.col("distance").isNull() | (F.col("distance") > tolerance)).drop("nearest_t", "distance")


def order_by_depth(units: DataFrame, depths: DataFrame | None = None, keys: Sequence[str] = ("session",), unit: str = "unit_id") -> DataFrame:
    """Units with ``depth_order`` from 0: by whole depth, then by unit; missing depths last."""
    found = units if depths is None else units.drop("depth").join(depths, [*keys, unit], "left")
    w = Window.partitionBy(*keys).orderBy(F.col("depth").isNull(), F.col("depth").cast("int"), unit)
    return found.withColumn("depth_order", (F.row_number().over(w) - 1).cast("int"))


def best_source(sources: DataFrame, precedence: Column, keys: Sequence[str] = ("session",), name: str = "name") -> DataFrame:
    """One readable source per key: the lowest precedence, then the first name."""
    w = Window.partitionBy(*keys).orderBy("_p", name)
    return sources.where("readable").withColumn("_p", precedence).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_p", "_r")


def paired_units(results: DataFrame, value: str, predictor: str = "predictor", keys: Sequence[str] = ("session", "unit_id")) -> DataFrame:
    """All pairs of predictors a < b, with the value of units present in both."""
    a = results.select(*keys, F.col(predictor).alias("predictor_a"), F.col(value).alias("value_a"))
    b = results.select(*keys, F.col(predictor).alias("predictor_b"), F.col(value).alias("value_b"))
    return a.join(b, list(keys)).where("predictor_a < predictor_b")


def trial_log_lookup(trials: DataFrame, log: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session", "trial_number", "dup_index")) -> DataFrame:
    """Chosen columns of the log row of each trial occurrence."""
    return trials.join(log.select(*keys, *columns), list(keys), "left")


def rename_markers(markers: DataFrame, names: DataFrame, order: str = "seq") -> DataFrame:
    """Keep and rename markers by (old, new, order); of repeated old names the last counts."""
    last = names.groupBy("old").agg(F.max_by("new", order).alias("new"))
    return markers.join(last, markers["marker"] == last["old"]).withColumn("marker", F.col("new")).drop("old", "new")


def choose_units(units: DataFrame, mode: str, curated: Column, noise: Column, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Units of a mode (all, curated, noise_excluded); a session where none is left keeps all."""
    if mode == "all":
        return units
    good = curated if mode == "curated" else ~noise
    any_left = F.max(F.coalesce(good, F.lit(False)).cast("int")).over(Window.partitionBy(*keys))
    return units.withColumn("_any", any_left).where(F.coalesce(good, F.lit(False)) | (F.col("_any") == 0)).drop("_any")


def sensor_time_align(traces: DataFrame, keys: Sequence[str] = ("session", "trial"), sensor: str = "sensor", value: str = "force", time: str = "t") -> DataFrame:
    """Sum of the sensors of a trial on the union of their times within the range common to all."""
    from motorspark.operators.series import interpolate

    span = traces.groupBy(*keys, sensor).agg(F.min(time).alias("_a"), F.max(time).alias("_b")).groupBy(*keys).agg(F.max("_a").alias("_a"), F.min("_b").alias("_b"))
    times = traces.select(*keys, time).distinct().join(span, list(keys)).where(F.col(time).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    grid = times.join(traces.select(*keys, sensor).distinct(), list(keys))
    return interpolate(grid, traces, [*keys, sensor], value, time).groupBy(*keys, time).agg(F.sum(value).alias(value))


def adjustment_trial(trials: DataFrame, keys: Sequence[str] = ("session",), order: str = "trial_pos", flag: str = "adjustment") -> DataFrame:
    """For each trial the last adjustment trial at or before it, as ``adjustment_pos``; null without one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("adjustment_pos", F.last(F.when(F.col(flag), F.col(order)), ignorenulls=True).over(w))
