"""Window functions and time series, keyed by whatever identifies a series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from motorspark.functions import kernels
from motorspark.functions.columns import numbered, pearson
from motorspark.operators.aggregates import sum_sensels
from motorspark.sources.scratch import stored

KEYS = ("session", "channel")


def _w(keys: Sequence[str], order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order)


def per_series(df: DataFrame, keys: Sequence[str], kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], value: str = "value", out: str = "smoothed", time: str = "t") -> DataFrame:
    """Add ``out`` = kernel(times, values) of each series, in the order of time; one series is one group."""
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        made = kernel(pdf[time].to_numpy(float), pdf[value].to_numpy(float))
        return pdf.assign(**{out: pd.Series(made, index=pdf.index).astype(object).where(np.isfinite(made), None)})

    return df.groupBy(*keys).applyInPandas(run, schema)


def edges(before: float, after: float, width: float) -> np.ndarray:
    return np.arange(-before - width / 2, after + width / 2, width)


def aligned_counts(spikes: DataFrame, events: DataFrame, before: float, after: float, width: float, keys: Sequence[str] = ("session",), unit: str = "unit_id", trial: str = "trial") -> DataFrame:
    """Spike counts per unit, trial and bin around each event time ``tp``, with zeros.

    Bins are half-open, the last one closed. Spikes and events meet by time
    buckets as long as the window.
    """
    at = edges(before, after, width)
    n, first, last = len(at) - 1, float(at[0]), float(at[-1])
    span = max(last - first, width)
    bucket = lambda c: F.floor(c / F.lit(span))
    spread = events.withColumn("_b", F.explode(F.sequence(bucket(F.col("tp") + first), bucket(F.col("tp") + last))))
    near = spikes.withColumn("_b", bucket(F.col("t"))).join(spread, [*keys, "_b"])
    rel = F.col("t") - F.col("tp")
    counts = (
        near.where((rel >= first) & (rel <= last))
        .withColumn("bin", F.least(F.floor((rel - first) / width), F.lit(n - 1)).cast("int"))
        .groupBy(*keys, unit, trial, "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    others = [c for c in events.columns if c not in (*keys, trial, "tp")]
    spine = events.join(spikes.select(*keys, unit).distinct(), list(keys)).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spine.join(counts, [*keys, unit, trial, "bin"], "left").select(*keys, unit, trial, *others, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def gaussian_smooth(counts: DataFrame, sigma_bins: float, n_bins: int, keys: Sequence[str], value: str = "n", out: str = "rate", scale: float = 1.0) -> DataFrame:
    """Gaussian filter over ``bin`` (0 to n_bins - 1, all present) with reflected borders, by array functions.

    The bins of a series are gathered once as an array; each output is a sum
    over the radius, the index folded back at the borders.
    """
    r = int(4 * sigma_bins + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma_bins) ** 2)
    k = k / k.sum() * scale
    weights = F.array(*[F.lit(float(x)) for x in k])
    packed = counts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("_v"))
    period = 2 * n_bins

    def at(i: Column) -> Column:
        m = F.pmod(i, F.lit(period))
        return F.get("_v", F.when(m < n_bins, m).otherwise(period - 1 - m))

    def smooth(_: Column, b: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), F.lit(0.0), lambda acc, j: acc + F.get(weights, j) * at(b + j - r))

    return packed.select(*keys, F.posexplode(F.transform("_v", smooth)).alias("bin", out))


def causal_smooth(df: DataFrame, sigma: float, keys: Sequence[str], order: str = "bin", value: str = "n", out: str = "rate") -> DataFrame:
    """Half-Gaussian over past bins, zeros before the first: a sum of lags, all built in."""
    d = np.arange(int(np.ceil(4 * sigma)) + 1)
    k = np.exp(-(d**2) / (2 * sigma**2))
    k /= k.sum()
    w = _w(keys, order)
    total = sum((F.coalesce(F.lag(value, int(i)).over(w) if i else F.col(value), F.lit(0.0)) * float(x) for i, x in zip(d, k, strict=True)), F.lit(0.0))
    return df.withColumn(out, total)


def moving_average(df: DataFrame, size: int, keys: Sequence[str], value: str = "value", out: str = "smoothed", time: str = "t") -> DataFrame:
    """Centred uniform window; beyond an end the end's value is repeated. Built in."""
    back, ahead = size // 2, size - 1 - size // 2
    whole = Window.partitionBy(*keys)
    w = _w(keys, time).rowsBetween(-back, ahead)
    f = df.withColumns({
        "_i": F.row_number().over(_w(keys, time)), "_n": F.count(F.lit(1)).over(whole),
        "_s": F.sum(value).over(w), "_first": F.min_by(value, time).over(whole), "_last": F.max_by(value, time).over(whole),
    })
    left, right = F.greatest(F.lit(back) - F.col("_i") + 1, F.lit(0)), F.greatest(F.lit(ahead) - (F.col("_n") - F.col("_i")), F.lit(0))
    return f.withColumn(out, (F.col("_s") + left * F.col("_first") + right * F.col("_last")) / size).drop("_i", "_n", "_s", "_first", "_last")


def joint_velocity(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", out: str = "velocity", time: str = "t") -> DataFrame:
    """Derivative on an uneven grid: second order inside, one-sided at the ends."""
    w = _w(keys, time)
    y, x = F.col(value), F.col(time)
    y0, y2, x0, x2 = F.lag(value).over(w), F.lead(value).over(w), F.lag(time).over(w), F.lead(time).over(w)
    h1, h2 = x - x0, x2 - x
    inside = F.try_divide(h1 * h1 * (y2 - y) + h2 * h2 * (y - y0), h1 * h2 * (h1 + h2))
    return df.withColumn(out, F.when(x0.isNull(), F.try_divide(y2 - y, h2)).when(x2.isNull(), F.try_divide(y - y0, h1)).otherwise(inside))


def lowpass_butter(df: DataFrame, order: int, cutoff: float, rate: float, keys: Sequence[str] = KEYS, **names: str) -> DataFrame:
    return per_series(df, keys, lambda _, v: kernels.lowpass(v, order, cutoff, rate), **names)


def filter_by_channel(df: DataFrame, filters: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], keys: Sequence[str] = KEYS, channel: str = "channel", value: str = "value", out: str = "smoothed", time: str = "t") -> DataFrame:
    """Each channel by its own function of (times, values); a channel without one keeps its values."""
    named = df.where(F.col(channel).isin(list(filters)))
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        made = np.asarray(filters[pdf[channel].iloc[0]](pdf[time].to_numpy(float), pdf[value].to_numpy(float)), float)
        return pdf.assign(**{out: pd.Series(made, index=pdf.index).astype(object).where(np.isfinite(made), None)})

    rest = df.where(~F.coalesce(F.col(channel).isin(list(filters)), F.lit(False))).withColumn(out, F.col(value).cast("double"))
    return named.groupBy(*keys).applyInPandas(run, schema).unionByName(rest)


def median_filter(df: DataFrame, keys: Sequence[str], size: int = 3, value: str = "value", out: str = "smoothed", time: str = "t") -> DataFrame:
    """Sliding median; beyond the ends are zeros. Built in."""
    h = size // 2
    w = _w(keys, time).rowsBetween(-h, h)
    f = df.withColumn("_a", F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(w))
    padded = F.array_sort(F.concat("_a", F.array_repeat(F.lit(0.0), size - F.size("_a"))))
    return f.withColumn(out, F.get(padded, F.lit(h))).drop("_a")


def nan_median_filter(df: DataFrame, keys: Sequence[str], width: int, **names: str) -> DataFrame:
    return per_series(df, keys, lambda _, v: kernels.nan_median(v, width), **names)


def interpolate(grid: DataFrame, samples: DataFrame, keys: Sequence[str], value: str = "value", time: str = "t", clamp: bool = True) -> DataFrame:
    """``value`` of ``samples`` at the times of ``grid``: linear; beyond the ends held, or (``clamp`` off) extended.

    Grid and samples are merged by time; the samples on both sides come from
    windows within the series. Beyond an end the line goes through its two
    outermost samples.
    """
    s = samples.where(F.col(value).isNotNull()).select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("x"), F.col(value).alias("y")).alias("_p"), F.lit(0).alias("_grid"))
    if not clamp:
        of = Window.partitionBy(*keys)
        s = s.withColumns({"_up": F.row_number().over(of.orderBy("_p")), "_down": F.row_number().over(of.orderBy(F.desc("_p")))})
    g = grid.select("*", F.col(time).alias("_t"), F.lit(1).alias("_grid"))
    both = g.unionByName(s, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("_t", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    # From the end backwards: a frame that reaches to the end is added up anew for every row, which is quadratic.
    ahead = Window.partitionBy(*keys).orderBy(F.desc("_t"), "_grid").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last("_p", ignorenulls=True).over(past), "_b": F.last("_p", ignorenulls=True).over(ahead)})
    if not clamp:
        outer = lambda place, k: F.max(F.when(F.col(place) == k, F.col("_p"))).over(Window.partitionBy(*keys))
        both = both.withColumns({"_u1": outer("_up", 1), "_u2": outer("_up", 2), "_d1": outer("_down", 1), "_d2": outer("_down", 2)})
        both = both.withColumns({
            "_a": F.when(F.col("_a").isNull(), F.col("_u1")).when(F.col("_b").isNull(), F.col("_d2")).otherwise(F.col("_a")),
            "_b": F.when(F.col("_a").isNull(), F.col("_u2")).when(F.col("_b").isNull(), F.col("_d1")).otherwise(F.col("_b")),
        }).drop("_up", "_down", "_u1", "_u2", "_d1", "_d2")
    a, b = F.col("_a"), F.col("_b")
    line = a["y"] + F.try_divide((F.col("_t") - a["x"]) * (b["y"] - a["y"]), b["x"] - a["x"])
    made = F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).when(a["x"] == b["x"], a["y"]).otherwise(line)
    return both.withColumn(value, made).where("_grid = 1").drop("_t", "_p", "_grid", "_a", "_b")


def fill_gaps(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "filled", time: str = "t") -> DataFrame:
    """Linear over null runs, the ends held."""
    p = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("x"), F.col(value).alias("y")))
    past, ahead = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(time), F.desc(time)))
    a, b = F.last(p, ignorenulls=True).over(past), F.last(p, ignorenulls=True).over(ahead)
    f = df.withColumns({"_a": a, "_b": b})
    a, b = F.col("_a"), F.col("_b")
    line = a["y"] + F.try_divide((F.col(time) - a["x"]) * (b["y"] - a["y"]), b["x"] - a["x"])
    made = F.when(a.isNull(), b["y"]).when(b.isNull() | (a["x"] == b["x"]), a["y"]).otherwise(line)
    return f.withColumn(out, made).drop("_a", "_b")


def downsample_at_times(samples: DataFrame, grid: DataFrame, keys: Sequence[str], value: str = "value", time: str = "t") -> DataFrame:
    """Median of the samples in the cell between midpoints around each new time, half-open; empty cells are 0.

    The first and the last cell reach half a step beyond their times.
    """
    w = _w(keys, time)
    before, after = F.lag(time).over(w), F.lead(time).over(w)
    cells = grid.select(*keys, F.col(time).alias("_c"), F.coalesce((F.col(time) + before) / 2, F.col(time) - (after - F.col(time)) / 2, F.col(time)).alias("_lo"),
                        F.coalesce((F.col(time) + after) / 2, F.col(time) + (F.col(time) - before) / 2, F.col(time)).alias("_hi"))
    # The cell of a sample is the last that begins at or before it.
    starts = cells.select(*keys, F.col("_lo").alias("_t"), F.struct("_c", "_hi").alias("_cell"), F.lit(0).alias("_s"))
    rows = samples.select(*keys, F.col(time).alias("_t"), F.col(value).alias("_v"), F.lit(1).alias("_s"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    cell = F.last("_cell", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("_k", cell).where((F.col("_s") == 1) & F.col("_k").isNotNull() & (F.col("_t") < F.col("_k")["_hi"]))
    med = inside.groupBy(*keys, F.col("_k")["_c"].alias("_c")).agg(F.percentile("_v", F.lit(0.5)).alias(value))
    return cells.join(med, [*keys, "_c"], "left").select(*keys, F.col("_c").alias(time), F.coalesce(value, F.lit(0.0)).alias(value))


def decimate(df: DataFrame, factor: int, keys: Sequence[str] = KEYS, value: str = "value", time: str = "t") -> DataFrame:
    """Every factor-th sample of a regular series after a zero-phase FIR filter."""
    schema = StructType([f for f in df.schema.fields if f.name in (*keys, time)] + [StructField(value, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        y = kernels.decimate(pdf[value].to_numpy(float), factor)
        return pdf.iloc[::factor][[*keys, time]].assign(**{value: y[: -(-len(pdf) // factor)]})[[f.name for f in schema.fields]]

    return df.groupBy(*keys).applyInPandas(run, schema)


def denoise_frames(frames: DataFrame, keys: Sequence[str] = ("sensor",), time: str = "t", share: float = 0.05, quantile: float = 0.9) -> DataFrame:
    """Sensel values at or below their 90th percentile over inactive frames become 0, then a median of 3 in time.

    A frame is inactive with a sum of at most 5 % of the largest. Long form
    goes out: keys, time, sensel, x.
    """
    total = sum_sensels(frames).select(*keys, time, "force").withColumn("_top", F.max("force").over(Window.partitionBy(*keys)))
    idle = total.where(F.col("force") <= share * F.col("_top")).select(*keys, time)
    cells = frames.select(*keys, time, F.posexplode("sensels").alias("sensel", "x"))
    noise = cells.join(idle, [*keys, time], "left_semi").groupBy(*keys, "sensel").agg(F.percentile("x", F.lit(quantile)).alias("_noise"))
    clean = cells.join(noise, [*keys, "sensel"], "left").withColumn("x", F.when(F.col("x") <= F.coalesce("_noise", F.lit(-1e300)), 0.0).otherwise(F.col("x"))).drop("_noise")
    return median_filter(clean, [*keys, "sensel"], 3, "x", "x", time)


#: Points of a trial's clock that meet their forces at once.
CLOCK = 64


def align_trial(joints: DataFrame, frames: DataFrame, keys: Sequence[str] = ("session", "trial"), offset: float = 0.0) -> DataFrame:
    """Joint angles and summed force of a trial on one clock: the common range at the median period of the joints.

    Angles are linear between samples and held beyond the ends; the force is
    the median of the cell around a point, as in ``downsample_at_times``. The
    clock is regular, so the places of samples on it are computed: its points
    are laid out last, from samples and cells, and are neither shuffled nor
    sorted.
    """
    by, j = list(keys), joints.withColumn("t", F.col("t") + offset)
    w = Window.partitionBy(*keys, "channel").orderBy("t")
    period = j.withColumn("_dt", F.col("t") - F.lag("t").over(w)).groupBy(*keys).agg(F.median("_dt").alias("_dt"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    span = frames.groupBy(*keys).agg(F.min("t").alias("_c"), F.max("t").alias("_d"))
    clock = period.join(span, by).withColumns({"_lo": F.greatest("_a", "_c"), "_hi": F.least("_b", "_d")}).where("_lo <= _hi AND _dt > 0")
    # A row a trial, stored, so that Spark knows how small it is.
    clock = stored(clock.select(*keys, "_lo", "_dt", F.floor((F.col("_hi") - F.col("_lo")) / F.col("_dt")).cast("long").alias("_n")), "trial-clocks")
    x, lo, dt, n, zero = F.col("_x"), F.col("_lo"), F.col("_dt"), F.col("_n"), F.lit(0).cast("long")
    at = lambda i: lo + i * dt
    # Quotients are rounded, so the points beside the one they give are looked at too.
    near = lambda q, most: F.least(F.greatest(q, F.lit(0.0)), most.cast("double")).cast("long")

    # The first point at or after each sample; its run goes on to that of the next, the first sample's also back to the beginning.
    i = F.col("_g")
    first = F.when(at(i - 1) >= x, i - 1).when(at(i) >= x, i).otherwise(i + 1)
    s = j.where("value IS NOT NULL AND t IS NOT NULL").select(*keys, "channel", F.col("t").alias("_x"), F.col("value").alias("_y")).join(clock, by)
    s = s.withColumn("_g", near(F.ceil((x - lo) / dt).cast("double"), n + 1))
    v = Window.partitionBy(*keys, "channel").orderBy("_x")
    s = s.withColumn("_i", F.least(F.greatest(first, zero), n + 1))
    s = s.withColumns({"_x1": F.lead("_x").over(v), "_y1": F.lead("_y").over(v), "_i1": F.lead("_i").over(v), "_first": F.lag("_i").over(v).isNull()})
    own = F.array(
        F.struct(F.col("_i").alias("a"), F.coalesce(F.col("_i1") - 1, n).alias("b"), F.lit(False).alias("held")),
        F.struct(zero.alias("a"), F.when(F.col("_first"), F.col("_i") - 1).otherwise(-1).alias("b"), F.lit(True).alias("held")),
    )
    runs = s.select(*keys, "channel", "_lo", "_dt", "_x", "_y", "_x1", "_y1", F.inline(own)).where("a <= b")
    none = j.groupBy(*keys, "channel").agg(F.count(F.when(F.col("t").isNotNull(), F.col("value"))).alias("_some")).where("_some = 0").join(clock, by)
    runs = runs.unionByName(none.select(*keys, "channel", "_lo", "_dt", zero.alias("a"), n.alias("b"), F.lit(True).alias("held")), allowMissingColumns=True)
    block = lambda i: F.floor(i / CLOCK).cast("long")
    parts = runs.withColumn("_block", F.explode(F.sequence(block(F.col("a")), block(F.col("b")))))
    parts = parts.withColumns({"a": F.greatest(F.col("a"), F.col("_block") * CLOCK), "b": F.least(F.col("b"), F.col("_block") * CLOCK + CLOCK - 1)})
    # Few bytes make many points: adaptive execution must not join these partitions. Runs and forces are dealt alike, and shuffled once.
    deal = lambda df: df.repartition(int(joints.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")

    # The cell of a force is the last that begins at or before it; the outer cells reach half a step beyond their points.
    ends = clock.withColumns({"_from": F.when(n > 0, lo - (at(zero + 1) - lo) / 2).otherwise(lo), "_to": F.when(n > 0, at(n) + (at(n) - at(n - 1)) / 2).otherwise(lo)})
    cell = F.when((i < n) & ((at(i) + at(i + 1)) / 2 <= x), i + 1).when((i == 0) | ((at(i) + at(i - 1)) / 2 <= x), i).otherwise(i - 1)
    f = sum_sensels(frames).select(*keys, F.col("t").alias("_x"), "force").join(ends, by).where((x >= F.col("_from")) & (x < F.col("_to")))
    f = f.withColumn("_g", near((x - lo) / dt + 0.5, n)).withColumn("_p", cell)
    inside = Window.partitionBy(*keys, "_block", "_p")
    f = deal(f.select(*keys, block(F.col("_p")).alias("_block"), "_p", "force"))
    f = f.withColumns({"_r": F.row_number().over(inside.orderBy("force")), "_c": F.count(F.lit(1)).over(inside)})
    f = f.where("_r = (_c + 1) div 2 OR _r = (_c + 2) div 2").groupBy(*keys, "_block", "_p").agg(F.avg("force").alias("_f"))
    f = f.groupBy(*keys, "_block").agg(F.map_from_entries(F.collect_list(F.struct("_p", "_f"))).alias("_forces"))

    points = deal(parts).join(f, [*by, "_block"], "left").withColumn("_p", F.explode(F.sequence("a", "b"))).withColumn("t", at(F.col("_p")))
    line = F.col("_y") + F.try_divide((F.col("t") - x) * (F.col("_y1") - F.col("_y")), F.col("_x1") - x)
    value = F.when(F.col("held") | F.col("_x1").isNull() | (F.col("t") == x), F.col("_y")).otherwise(line)
    return points.select(*keys, "t", "channel", value.alias("value"), F.coalesce(F.try_element_at("_forces", F.col("_p")), F.lit(0.0)).alias("force"))


def threshold_crossings(df: DataFrame, threshold: float | Column, keys: Sequence[str] = KEYS, value: str = "value", time: str = "t") -> DataFrame:
    """Changes of value > threshold, with ``direction`` and ``crossing``.

    Up: interpolated. Down: the sample after, or the one before where the
    value there equals the threshold.
    """
    w = _w(keys, time)
    f = df.withColumns({"_y0": F.lag(value).over(w), "_x0": F.lag(time).over(w)})
    over, was = F.col(value) > threshold, F.col("_y0") > threshold
    up = F.col("_x0") + (threshold - F.col("_y0")) / (F.col(value) - F.col("_y0")) * (F.col(time) - F.col("_x0"))
    down = F.when(F.col(value) == threshold, F.col("_x0")).otherwise(F.col(time))
    return f.where(was != over).select(*keys, F.when(over, "up").otherwise("down").alias("direction"), F.when(over, up).otherwise(down).alias("crossing"))


def two_level_crossings(df: DataFrame, onset: float, offset: float, keys: Sequence[str] = KEYS, value: str = "value", time: str = "t") -> DataFrame:
    """Ups of the onset level and downs of the offset level."""
    if onset == offset:
        return threshold_crossings(df, onset, keys, value, time)
    both = df.withColumn("_level", F.explode(F.array(F.lit(onset), F.lit(offset))))
    c = threshold_crossings(both, F.col("_level"), [*keys, "_level"], value, time)
    return c.where((F.col("direction") == "up") == (F.col("_level") == onset)).drop("_level")


def grasp_events(crossings: DataFrame, keys: Sequence[str] = KEYS, merge_gap: float | None = None, min_time: float = 0.0) -> DataFrame:
    """Pairs (start, stop) of an up and the next down crossing, near ones merged, short ones dropped.

    The crossings may be of two levels. A further up before the down, and a
    further down before the next up, don't count. Nothing is merged where
    ``merge_gap`` is null.
    """
    w = Window.partitionBy(*keys).orderBy("crossing", F.desc("direction"))
    c = crossings.withColumn("_was", F.lag("direction").over(w)).where("_was IS NULL OR _was <> direction")
    c = c.withColumns({"_next": F.lead("crossing").over(w), "_dir": F.lead("direction").over(w)})
    p = c.where("direction = 'up' AND _dir = 'down'").select(*keys, F.col("crossing").alias("start"), F.col("_next").alias("stop"))
    if merge_gap is not None:
        v = _w(keys, "start")
        gap = F.col("start") - F.lag("stop").over(v)
        p = p.withColumn("_new", F.when(gap.isNull() | (gap > merge_gap), 1).otherwise(0)).withColumn("_g", F.sum("_new").over(v))
        p = p.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")
    return p.where(F.col("stop") - F.col("start") >= min_time)


def normalised_velocity(df: DataFrame, keys: Sequence[str] = ("session",), channel: str = "channel", value: str = "value", time: str = "t", between: bool = False, scaled: bool = True) -> DataFrame:
    """Absolute steps of each channel scaled to [0, 1], summed over channels, over the maximum.

    A step has the time of its second sample or, with ``between``, of its
    first plus half the median step of time. Not ``scaled``, steps are summed
    as they are and the sum is brought to [0, 1].
    """
    w = _w([*keys, channel], time)
    d = df.withColumns({"_d": F.abs(F.col(value) - F.lag(value).over(w)), "_before": F.lag(time).over(w)}).where("_d IS NOT NULL")
    ch = Window.partitionBy(*keys, channel)
    lo, hi = F.min("_d").over(ch), F.max("_d").over(ch)
    steps = d.withColumn("_d", F.coalesce(F.try_divide(F.col("_d") - lo, hi - lo), F.lit(0.0))) if scaled else d
    if between:
        half = d.groupBy(*keys).agg((F.median(F.col(time) - F.col("_before")) / 2).alias("_half"))
        steps = steps.join(half, list(keys)).withColumn(time, F.col("_before") + F.col("_half"))
    s = steps.groupBy(*keys, time).agg(F.sum("_d").alias("_s"))
    whole = Window.partitionBy(*keys)
    least = F.lit(0.0) if scaled else F.min("_s").over(whole)
    return s.withColumn("speed", F.coalesce(F.try_divide(F.col("_s") - least, F.max("_s").over(whole) - least), F.lit(0.0))).drop("_s")


def movement_onset(speed: DataFrame, threshold: float = 0.2, keys: Sequence[str] = ("session",), time: str = "t") -> DataFrame:
    """The first up crossing after the last local minimum below the threshold (of all, if there is none)."""
    low = local_extrema(speed, keys, "speed", time).where(f"kind = 'min' AND speed < {threshold}").groupBy(*keys).agg(F.max(time).alias("_from"))
    up = threshold_crossings(speed, threshold, keys, "speed", time).where("direction = 'up'")
    return up.join(low, list(keys), "left").where("_from IS NULL OR crossing >= _from").groupBy(*keys).agg(F.min("crossing").alias("onset"))


def local_extrema(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", time: str = "t") -> DataFrame:
    """Strict interior minima and maxima, as ``kind``."""
    w = _w(keys, time)
    a, b, y = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    kind = F.when((y < a) & (y < b), "min").when((y > a) & (y > b), "max")
    return df.withColumn("kind", kind).where("kind IS NOT NULL")


def max_aperture_time(aperture: DataFrame, grasp: DataFrame, keys: Sequence[str] = ("session",), before: float = 0.5, value: str = "value", time: str = "t") -> DataFrame:
    """Time of the highest local maximum in the ``before`` seconds up to grasp ``start``."""
    near = aperture.join(grasp.select(*keys, "start"), list(keys)).where((F.col(time) >= F.col("start") - before) & (F.col(time) <= F.col("start")))
    top = local_extrema(near, keys, value, time).where("kind = 'max'")
    return top.groupBy(*keys).agg(F.max_by(time, F.struct(F.col(value), -F.col(time))).alias("mga_time"))


def fingers_static(speed: DataFrame, grasp: DataFrame, keys: Sequence[str] = ("session",), within: float = 0.5, level: float = 0.4, value: str = "speed", time: str = "t") -> DataFrame:
    """First down crossing among the samples ``within`` after grasp start, and last up crossing among those within it before release, at ``level`` of the max."""
    s = speed.withColumn(value, F.try_divide(F.col(value), F.max(value).over(Window.partitionBy(*keys))))
    s = s.select(*keys, time, value).join(grasp.select(*keys, "start", "stop"), list(keys))
    parts = (("down", F.col("start"), F.col("start") + within, F.min), ("up", F.col("stop") - within, F.col("stop"), F.max))
    still, move = (
        threshold_crossings(s.where(F.col(time).between(a, b)), level, keys, value, time).where(F.col("direction") == way).groupBy(*keys).agg(pick("crossing").alias(f"_{way}"))
        for way, a, b, pick in parts
    )
    found = still.join(move, list(keys), "full_outer")
    return found.withColumnsRenamed({"_down": "fingers_static", "_up": "release_start"})


def hand_retreat(distance: DataFrame, grasp: DataFrame, keys: Sequence[str] = ("session",), within: float = 3.0, value: str = "value", time: str = "t") -> DataFrame:
    """Time of the lowest local minimum of the distance to the resting pose within ``within`` after the last grasp."""
    last = grasp.groupBy(*keys).agg(F.max("stop").alias("_stop"))
    near = distance.join(last, list(keys)).where(F.col(time).between(F.col("_stop"), F.col("_stop") + within))
    return local_extrema(near, keys, value, time).where("kind = 'min'").groupBy(*keys).agg(F.min_by(time, F.struct(F.col(value), F.col(time))).alias("hand_retreat_time"))


#: The joint angles whose motion gives each onset; those of the resting pose; those of the aperture.
SHOULDER = ("ra_sh_elv_angle", "ra_sh_elv", "ra_sh_rot")
ELBOW = ("ra_el_e_f",)
WRIST = ("ra_wr_sup_pro", "ra_wr_rd_ud", "ra_wr_e_f")
FINGERS = (
    "ra_cmc1_f_e", "ra_cmc1_opp", "ra_cmc1_ad_ab", "ra_mcp1_e_f", "ra_ip1_e_f", "ra_mcp2_e_f", "ra_mcp2_ad_ab", "ra_pip2_e_f", "ra_dip2_e_f", "ra_mcp3_e_f", "ra_mcp3_rd_ud",
    "ra_pip3_e_f", "ra_dip3_e_f", "ra_mcp4_e_f", "ra_mcp4_ad_ab", "ra_pip4_e_f", "ra_dip4_e_f", "ra_mcp5_e_f", "ra_mcp5_ad_ab", "ra_pip5_e_f", "ra_dip5_e_f",
)
THUMB_AND_INDEX = ("ra_mcp1_e_f", "ra_mcp2_e_f")
#: Newtons that a trial must exceed; levels of the normalised force; least seconds of a grasp; levels of motion.
LEAST_FORCE, ONSET_LEVEL, OFFSET_LEVEL, LEAST_GRASP = 1.0, 0.05, 0.05, 0.2
ONSET_SPEED, STATIC_SPEED = 0.25, 0.4


def trial_timepoints(
    force: DataFrame, angles: DataFrame, trials: DataFrame, keys: Sequence[str] = ("session", "trial"), joints: dict[str, Sequence[str]] | None = None,
    aperture: tuple[str, str] = THUMB_AND_INDEX, before: float = 1.0, after: float = 3.0, least: float = LEAST_FORCE, levels: tuple[float, float] = (ONSET_LEVEL, OFFSET_LEVEL), min_time: float = LEAST_GRASP,
) -> DataFrame:
    """The time points of each trial, null where they can't be found; other columns of ``trials`` stay.

    ``force``: keys, t, force; ``angles``: keys, channel, t, value; ``trials``
    may have ``ttl_to_success_grasp``. ``joints`` gives the channels of
    shoulder, elbow, wrist, finger and pose. Onsets lie within ``before``
    seconds of the first grasp, the retreat within ``after`` of the last; the
    fingers rest and release around the first grasp. A trial with no force
    over ``least`` newtons has no time points.
    """
    joints = {"shoulder": SHOULDER, "elbow": ELBOW, "wrist": WRIST, "finger": FINGERS, "pose": SHOULDER} | (joints or {})
    by, whole = list(keys), Window.partitionBy(*keys)
    strong = force.withColumns({"_top": F.max("force").over(whole), "_low": F.min("force").over(whole)}).where(F.col("_top") > least)
    normed = strong.select(*keys, "t", F.coalesce(F.try_divide(F.col("force") - F.col("_low"), F.col("_top") - F.col("_low")), F.lit(0.0)).alias("value"))
    grasps = grasp_events(two_level_crossings(normed, *levels, keys), keys, None, min_time)
    goal = F.col("ttl_to_success_grasp") if "ttl_to_success_grasp" in trials.columns else F.lit(None).cast("double")
    held = F.when(F.col("_goal").between(F.col("start"), F.col("stop")), F.struct("start", "stop"))
    g = grasps.join(trials.select(*keys, goal.alias("_goal")), by).groupBy(*keys).agg(
        F.min("start").alias("first_grasp_start"), F.min_by("stop", "start").alias("_first_stop"), F.max("stop").alias("release"), (F.count(F.lit(1)) > 1).alias("regrasp_bool"), F.min(held).alias("_held"),
    )
    g = g.withColumns({"success_grasp_start": F.col("_held.start"), "success_grasp_end": F.col("_held.stop")}).drop("_held")
    out = trials.join(g, by, "left").withColumn("regrasp_bool", F.coalesce("regrasp_bool", F.lit(False)))
    near = angles.join(g.select(*keys, F.col("first_grasp_start").alias("_start"), "release"), by)
    reach = near.where((F.col("t") < F.col("_start")) & (F.col("t") > F.col("_start") - before))
    # All joints at once: a channel goes to every joint that has it.
    moving = ("shoulder", "elbow", "wrist", "finger")
    of = {c: [j for j in moving if c in joints[j]] for c in sorted({c for j in moving for c in joints[j]})}
    joint = F.create_map(*[e for c, own in of.items() for e in (F.lit(c), F.array(*map(F.lit, own)))])
    own = reach.select(*keys, "channel", "t", "value", F.explode(F.try_element_at(joint, F.col("channel"))).alias("_joint"))
    onset = movement_onset(normalised_velocity(own, [*keys, "_joint"], between=True), ONSET_SPEED, [*keys, "_joint"])
    onset = onset.groupBy(*keys).agg(*[F.max(F.when(F.col("_joint") == j, F.col("onset"))).alias(f"{j}_onset") for j in moving])
    out = out.join(onset, by, "left")
    # The hand is back where its pose is nearest to that before the reach.
    pose = angles.where(F.col("channel").isin(list(joints["pose"])))
    rest = interpolate(g.select(*keys, (F.col("first_grasp_start") - before).alias("t")).join(pose.select(*keys, "channel").distinct(), by), pose.select(*keys, "channel", "t", "value"), [*keys, "channel"])
    away = pose.join(g.select(*keys, F.col("release").alias("stop")), by).where((F.col("t") > F.col("stop")) & (F.col("t") < F.col("stop") + after))
    away = away.join(rest.select(*keys, "channel", F.col("value").alias("_rest")), [*by, "channel"]).groupBy(*keys, "t").agg(F.sqrt(F.sum((F.col("value") - F.col("_rest")) ** 2)).alias("value"))
    out = out.join(hand_retreat(away, g.select(*keys, F.col("release").alias("stop")), keys, after), by, "left")
    # The aperture is widest where thumb and index, which bend towards each other, differ least.
    thumb, index = (F.max(F.when(F.col("channel") == c, F.col("value"))) for c in aperture)
    spread = angles.where(F.col("channel").isin(list(aperture))).groupBy(*keys, "t").agg((-F.abs(thumb + index)).alias("value")).where("value IS NOT NULL")
    mga = max_aperture_time(spread, g.select(*keys, F.col("first_grasp_start").alias("start")), keys)
    out = out.join(mga.withColumnRenamed("mga_time", "MGA_time"), by, "left")
    speed = normalised_velocity(angles.where(F.col("channel").isin(list(joints["finger"]))).select(*keys, "channel", "t", "value"), keys, between=True, scaled=False)
    static = fingers_static(speed, g.select(*keys, F.col("first_grasp_start").alias("start"), F.col("_first_stop").alias("stop")), keys, level=STATIC_SPEED)
    return out.join(static, by, "left").drop("_first_stop")


def lag_pairs(df: DataFrame, lag_bins: int, keys: Sequence[str], x: str = "x", y: str = "y", order: str = "bin") -> DataFrame:
    """Y[t] with X[t + lag] inside a series, edges trimmed."""
    w = _w(keys, order)
    moved = F.lead(x, lag_bins).over(w) if lag_bins >= 0 else F.lag(x, -lag_bins).over(w)
    return df.withColumn("x_lagged", moved).where("x_lagged IS NOT NULL")


def lagged_crosscorrelation(force: DataFrame, rate: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("session", "trial"), unit: str = "unit_id") -> DataFrame:
    """Pearson r of force(bin) with rate(bin + lag) per trial, unit and lag; null at zero variance.

    Lags are fanned out on the small force side and met by an equi-join.
    """
    fanned = force.withColumn("lag", F.explode(F.array(*[F.lit(int(i)) for i in lags]))).withColumn("bin", F.col("bin") + F.col("lag"))
    return fanned.join(rate, [*keys, "bin"]).groupBy(*keys, unit, "lag").agg(pearson("force", "rate").alias("r"))


def neuron_force_xcorr(correlations: DataFrame, keys: Sequence[str] = ("session", "unit_id"), trial: str = "trial") -> DataFrame:
    """Mean over the trials that have an r."""
    return correlations.groupBy(*keys, "lag").agg(F.avg("r").alias("r"), F.count("r").alias("n_trials"))


def peak_lag(xcorr: DataFrame, keys: Sequence[str] = ("session", "unit_id")) -> DataFrame:
    """The lag of the largest r^2 per unit, the smallest of ties."""
    r2 = F.col("r") * F.col("r")
    return xcorr.where("r IS NOT NULL").groupBy(*keys).agg(F.max_by("lag", F.struct(r2, -F.col("lag"))).alias("peak_lag"), F.max(r2).alias("peak_r2"))


def sustained_above_chance(accuracy: DataFrame, keys: Sequence[str], step: float, order: str = "bin", value: str = "accuracy", chance: str = "chance") -> DataFrame:
    """Length of the longest run of bins above chance, times the bin step."""
    w = _w(keys, order)
    f = accuracy.withColumn("_hit", (F.col(value) > F.col(chance)).cast("int")).withColumn("_run", F.row_number().over(w) - F.sum("_hit").over(w))
    runs = f.groupBy(*keys, "_run").agg(F.sum("_hit").alias("_n"))
    return runs.groupBy(*keys).agg((F.max("_n") * step).alias("sustained"))


def merge_timeline(recordings: DataFrame, keys: Sequence[str] = ("session",), order: str = "seq") -> DataFrame:
    """Sample offset of each recording: the samples of those before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return recordings.withColumn("offset", F.coalesce(F.sum("n_samples").over(w), F.lit(0)))


def joint_time(sample: str = "sample_number", first: str = "first_sample", rate: str = "fs", offset: str = "offset") -> Column:
    return (F.col(sample) - F.col(first)) / F.col(rate) + F.col(offset) / F.col(rate)


def ttl_edges(events: DataFrame, keys: Sequence[str] = ("session",), order: str = "sample_number", state: str | None = "state") -> DataFrame:
    """Rising and falling edges paired by position (or consecutive events, without states); stop >= start."""
    if state is None:
        at = numbered(events, keys, [order], "_i")
        nxt = F.lead(order).over(_w(keys, order))
        return at.withColumn("stop", nxt).where("_i % 2 = 0 AND stop IS NOT NULL").select(*keys, (F.col("_i") / 2).cast("int").alias("pulse_idx"), F.col(order).alias("start"), "stop")
    rise = numbered(events.where(F.col(state) == 1), keys, [order], "pulse_idx").select(*keys, "pulse_idx", F.col(order).alias("start"))
    fall = numbered(events.where(F.col(state) == 0), keys, [order], "pulse_idx").select(*keys, "pulse_idx", F.col(order).alias("stop"))
    return rise.join(fall, [*keys, "pulse_idx"]).where("stop >= start")


def reanchor_segments(pulses: DataFrame, boundaries: Sequence[int], keys: Sequence[str] = ("session",), order: str = "pulse_idx", skipped: Sequence[int] = ()) -> DataFrame:
    """Segments begin at each boundary pulse and after each skipped one; kept pulses are numbered through as ``trial_pos``."""
    starts = F.col(order).isin([*boundaries, *[s + 1 for s in skipped]]) if [*boundaries, *skipped] else F.lit(False)
    f = pulses.withColumn("segment", F.sum(starts.cast("int")).over(_w(keys, order)))
    kept = f.where(~F.col(order).isin(list(skipped))) if skipped else f
    return numbered(kept, keys, [order], "trial_pos")


def close_gaps(times: DataFrame, boundaries: DataFrame, pad: float, keys: Sequence[str] = ("session",), time: str = "t") -> DataFrame:
    """Take what a gap before each boundary has beyond ``pad`` from all later times."""
    from motorspark.operators.pairing import asof_last

    w = Window.partitionBy(*keys).orderBy("boundary").rowsBetween(Window.unboundedPreceding, 0)
    cut = boundaries.withColumn("removed", F.sum(F.greatest(F.col("gap") - pad, F.lit(0.0))).over(w))
    found = asof_last(times, cut, "removed", time, "boundary", keys)
    return found.withColumn(time, F.col(time) - F.coalesce("removed", F.lit(0.0)))


def session_timeline(parts: dict[str, DataFrame], page: float, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Rows (t, name, value) of several kinds on one clock, with ``kind`` and page number."""
    made = None
    for kind, df in parts.items():
        one = df.select(*keys, F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
        made = one if made is None else made.unionByName(one)
    return made.withColumn("page", F.floor(F.col("t") / page))


def optimal_frame(force: DataFrame, speed: DataFrame, keys: Sequence[str] = ("session", "trial"), time: str = "t") -> DataFrame:
    """The frame with much force and little motion: argmax of force / max + 1 - speed scaled to its range; first of ties."""
    w = Window.partitionBy(*keys)
    f = force.join(speed, [*keys, time])
    lo, hi = F.min("speed").over(w), F.max("speed").over(w)
    f = f.withColumn("score", F.coalesce(F.try_divide(F.col("force"), F.max("force").over(w)), F.lit(0.0)) + 1 - F.coalesce(F.try_divide(F.col("speed") - lo, hi - lo), F.lit(0.0)))
    return f.groupBy(*keys).agg(F.max_by(time, F.struct("score", -F.col(time))).alias("optimal_t"), F.max("score").alias("score"))


def marker_cleanup(markers: DataFrame, keys: Sequence[str], least: float, width: int, sigma: float, value: str = "value", time: str = "frame") -> DataFrame:
    """Values of low confidence go, then a NaN-aware median and a Gaussian that skips NaN."""
    f = markers.withColumn(value, F.when(F.col("confidence") >= least, F.col(value)).cast("double"))
    return per_series(f, keys, lambda _, v: kernels.nan_gaussian(kernels.nan_median(v, width), sigma), value, "cleaned", time)


def drop_far_markers(markers: DataFrame, keys: Sequence[str] = ("frame",), far: float = 80.0) -> DataFrame:
    """Markers further than ``far`` from the frame's median marker lose their coordinates."""
    mid = markers.groupBy(*keys).agg(*[F.median(c).alias(f"_{c}") for c in "xyz"])
    f = markers.join(mid, list(keys))
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return f.withColumn("distance", d).withColumns({c: F.when(F.col("distance") <= far, F.col(c)) for c in "xyz"}).drop("_x", "_y", "_z")


def stable_period(markers: DataFrame, keys: Sequence[str] = ("session",), marker: str = "marker", time: str = "t", half: float = 0.15, width: int = 3) -> DataFrame:
    """+-0.15 s around the least mean marker speed (each over its 95th percentile, 1 at most), median filtered."""
    w = _w([*keys, marker], time)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in "xyz"), F.lit(0.0))) / (F.col(time) - F.lag(time).over(w))
    s = markers.withColumn("_s", step).where("_s IS NOT NULL")
    top = s.groupBy(*keys, marker).agg(F.percentile("_s", F.lit(0.95)).alias("_top"))
    mean = s.join(top, [*keys, marker]).groupBy(*keys, time).agg(F.avg(F.least(F.coalesce(F.try_divide(F.col("_s"), F.col("_top")), F.lit(0.0)), F.lit(1.0))).alias("speed"))
    smooth = median_filter(mean, keys, width, "speed", "speed", time)
    return smooth.groupBy(*keys).agg(F.min_by(time, F.struct("speed", time)).alias("_t")).select(*keys, (F.col("_t") - half).alias("start"), (F.col("_t") + half).alias("stop"))


#: Newtons in a pound of force.
POUND = 4.4482216152605


def resync_frames(frames: DataFrame, log: DataFrame, keys: Sequence[str] = ("session", "trial_num"), area: float | None = None) -> DataFrame:
    """Sensor times less (sync start - record start) of the log; with ``area`` pounds per area become Newton."""
    shift = log.select(*keys, ((F.col("sync_start_ms") - F.col("started_ms")) / 1000.0).alias("_shift"))
    f = frames.join(shift, list(keys)).withColumn("t", F.col("t") - F.col("_shift")).drop("_shift")
    return f if area is None else f.withColumn("sensels", F.transform("sensels", lambda x: x * area * POUND))


def edge_times_on_spike_clock(edges_: DataFrame, keys: Sequence[str] = ("session",), rate: str = "fs") -> DataFrame:
    """(sample - first) / rate; edges without a sample get their own time less the median offset of those with one."""
    t = F.when(F.col("sample_number").isNotNull(), (F.col("sample_number") - F.col("first_sample")) / F.col(rate))
    f = edges_.withColumn("_t", t)
    offset = f.where("_t IS NOT NULL").groupBy(*keys).agg(F.median(F.col("timestamp") - F.col("_t")).alias("_offset"))
    return f.join(offset, list(keys), "left").withColumn("spike_time", F.coalesce("_t", F.col("timestamp") - F.col("_offset"))).drop("_t", "_offset")




def event_grid(events: DataFrame, before: float, after: float, step: float, keys: Sequence[str] = ("session", "trial")) -> DataFrame:
    """Rows (keys, bin, t, dt) of a regular grid around each event time ``tp``."""
    n = int(np.floor((before + after) / step + 1e-9)) + 1
    f = events.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return f.withColumn("dt", F.col("bin") * step - before).withColumn("t", F.col("tp") + F.col("dt"))


def pool_behavior(signals: DataFrame, events: DataFrame, before: float, after: float, step: float, keys: Sequence[str] = ("session", "trial"), group: str = "condition") -> DataFrame:
    """Mean and SEM per channel, group and bin of channels interpolated around the events."""
    from motorspark.operators.aggregates import mean_and_sem

    grid = event_grid(events.select(*keys, group, "tp"), before, after, step, keys).join(signals.select(*keys, "channel").distinct(), list(keys))
    at = interpolate(grid.select(*keys, group, "channel", "bin", "t"), signals, [*keys, "channel"])
    return mean_and_sem(at, [keys[0], "channel", group, "bin"], "value")


def force_traces_by_target(force: DataFrame, events: DataFrame, window: float = 1.0, step: float = 0.02, keys: Sequence[str] = ("session", "trial"), target: str = "target") -> DataFrame:
    """Mean force per target on a grid around the events: linear, extended beyond the ends, 0 at least."""
    grid = event_grid(events.select(*keys, target, "tp"), window, window, step, keys)
    at = interpolate(grid, force.select(*keys, "t", F.col("force").alias("value")), list(keys), clamp=False)
    return at.groupBy(keys[0], target, "bin").agg(F.avg(F.greatest("value", F.lit(0.0))).alias("force"), F.count("value").alias("n"))
