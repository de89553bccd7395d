"""Aggregations over trials, sensors, units and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions.columns import numbered, pearson


def _n() -> Column:
    return F.count(F.lit(1))


def sem(value: str) -> Column:
    """Standard error of the mean with the population standard deviation."""
    return F.try_divide(F.stddev_pop(value), F.sqrt(F.count(value)))


def find_duplicate_trials(log: DataFrame, keys: Sequence[str] = ("session",), trial: str = "trial_num") -> DataFrame:
    """Trial numbers that occur more than once, how often, and the rows of the session."""
    counts = log.groupBy(*keys, trial).agg(_n().alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("total", total).where("n > 1")


def object_sets(rows: DataFrame, columns: Sequence[str], name: str = "object_id") -> DataFrame:
    """Distinct values of the columns, numbered from 0 in their order.

    The distinct objects are few, so the numbering runs over them only.
    """
    return rows.select(*columns).distinct().withColumn(name, (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(*columns)) - 1).cast("int"))


def with_object_id(rows: DataFrame, columns: Sequence[str], name: str = "object_id") -> DataFrame:
    sets = object_sets(rows, columns, name).withColumnsRenamed({c: f"_{c}" for c in columns})
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.drop(name).join(sets, same, "left").drop(*[f"_{c}" for c in columns])


def trial_offsets(log: DataFrame, columns: Sequence[str], anchor: str, reward: str = "reward") -> DataFrame:
    """Seconds of each column after ``anchor`` (ms), null where 0 or unrewarded; and ``success``."""
    ok = F.col(reward) > 0
    made = {f"ttl_to_{c.removesuffix('_ms')}": F.when(ok & (F.col(c) != 0), (F.col(c) - F.col(anchor)) / 1000.0) for c in columns}
    return log.withColumns(made | {"success": ok.cast("int")})


def sum_sensels(frames: DataFrame) -> DataFrame:
    """Total force of each frame."""
    return frames.withColumn("force", F.aggregate("sensels", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).drop("sensels")


def total_over_sensors(frames: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    return sum_sensels(frames).groupBy(*keys).agg(F.sum("force").alias("force"))


def active_period(trace: DataFrame, fraction: float = 0.05, keys: Sequence[str] = ("sensor",), order: str = "t", value: str = "force") -> DataFrame:
    """Positions [first, stop) of the samples with value >= fraction * max; nothing where the max isn't positive."""
    top = F.max(value).over(Window.partitionBy(*keys))
    at = numbered(trace, keys, [order], "_i").withColumn("_top", top)
    hit = (F.col("_top") > 0) & (F.col(value) >= fraction * F.col("_top"))
    return at.where(hit).groupBy(*keys).agg(F.min("_i").alias("first"), (F.max("_i") + 1).alias("stop"))


def session_sensor_mask(frames: DataFrame, keys: Sequence[str] = ("sensor",)) -> DataFrame:
    """For each sensel whether any frame has a force there."""
    each = frames.select(*keys, F.posexplode("sensels").alias("sensel", "x"))
    return each.groupBy(*keys, "sensel").agg((F.max(F.abs("x")) > 0).alias("active"))


def force_by_group(frames: DataFrame, contacts: DataFrame, groups: DataFrame, keys: Sequence[str] = ("sensor", "frame")) -> DataFrame:
    """Force per frame and group: sensels whose contact segment matches the group's regex, each once.

    ``groups`` has group_name and pattern, ``contacts`` the keys, sensel and
    segment. Patterns are tried on the distinct segments only.
    """
    cells = frames.select(*keys, F.posexplode("sensels").alias("sensel", "x"))
    members = contacts.select("segment").distinct().join(groups, F.expr("segment rlike pattern")).select("segment", "group_name")
    named = contacts.join(members, "segment").select(*keys, "sensel", "group_name").distinct()
    return cells.join(named, [*keys, "sensel"]).groupBy(*keys, "group_name").agg(F.sum("x").alias("force"))


def segment_summary(frames: DataFrame, contacts: DataFrame, keys: Sequence[str] = ("sensor", "frame")) -> DataFrame:
    """Per frame and segment: force, contacts and mean distance; sensels without contact go to ``None``."""
    cells = frames.select(*keys, F.posexplode("sensels").alias("sensel", "x"))
    found = cells.join(contacts, [*keys, "sensel"], "left").withColumn("segment", F.coalesce("segment", F.lit("None")))
    return found.groupBy(*keys, "segment").agg(F.sum("x").alias("force"), F.count("dist").alias("contacts"), F.avg("dist").alias("mean_dist"))


def misattributed_force(frames: DataFrame, auto: DataFrame, manual: DataFrame, keys: Sequence[str] = ("sensor", "frame")) -> DataFrame:
    """Per frame: force whose automatic label differs from the manual one, force with no automatic label, total."""
    cells = frames.select(*keys, F.posexplode("sensels").alias("sensel", "x"))
    on = [*keys, "sensel"]
    labels = auto.select(*on, F.col("label").alias("a")).join(manual.select(*on, F.col("label").alias("m")), on, "full")
    found = cells.join(labels, on, "left")
    size = F.abs("x")
    return found.groupBy(*keys).agg(
        F.sum(F.when(~F.col("a").eqNullSafe(F.col("m")), size).otherwise(0.0)).alias("wrong"),
        F.sum(F.when(F.col("a").isNull(), size).otherwise(0.0)).alias("unlabelled"), F.sum(size).alias("total"),
    )


def summary(value: str) -> list[Column]:
    return [F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std")]


def impulse(trace: DataFrame, keys: Sequence[str], value: str, time: str = "t") -> DataFrame:
    """Sum of value * dt, with dt to the next sample (at the last, from the one before)."""
    w = Window.partitionBy(*keys).orderBy(time)
    dt = F.coalesce(F.lead(time).over(w) - F.col(time), F.col(time) - F.lag(time).over(w), F.lit(0.0))
    return trace.withColumn("_dt", dt).groupBy(*keys).agg(F.sum(F.col(value) * F.col("_dt")).alias("impulse"), F.sum(value).alias("sum"))


def compare_traces(pairs: DataFrame, keys: Sequence[str], a: str = "auto", b: str = "manual") -> DataFrame:
    """Mean absolute deviation, its share of b's maximum, root of the summed squares (and over summed b / 5), r and r2."""
    d = F.col(a) - F.col(b)
    r = pearson(a, b)
    return pairs.groupBy(*keys).agg(
        F.avg(F.abs(d)).alias("mad"), F.try_divide(F.avg(F.abs(d)), F.max(b)).alias("mad_of_max"), F.sum(F.abs(d)).alias("integrated"),
        F.sqrt(F.sum(d * d)).alias("rms"), F.try_divide(F.sqrt(F.sum(d * d)), F.sum(b) / 5).alias("rms_normalised"), r.alias("r"), (r * r).alias("r2"),
    )


def mean_and_sem(values: DataFrame, keys: Sequence[str], value: str = "rate") -> DataFrame:
    return values.groupBy(*keys).agg(F.avg(value).alias("rate_avg"), sem(value).alias("rate_sem"), F.count(value).alias("n"))


def population_rate(spikes: DataFrame, width: float, keys: Sequence[str] = ("session",), unit: str = "unit_id") -> DataFrame:
    """Spikes of all units per bin, over units * width."""
    n = spikes.groupBy(*keys).agg(F.count_distinct(unit).alias("_units"))
    counts = spikes.groupBy(*keys, F.floor(F.col("t") / width).alias("bin")).agg(_n().alias("n"))
    return counts.join(n, list(keys)).withColumn("rate", F.col("n") / (F.col("_units") * width)).drop("n", "_units")


def trial_counts(spikes: DataFrame, windows: DataFrame, keys: Sequence[str] = ("session",), unit: str = "unit_id", trial: str = "trial") -> DataFrame:
    """Spikes of each unit in each window, with zeros, and the rate."""
    from motorspark.operators.pairing import spikes_in_windows

    spine = windows.join(spikes.select(*keys, unit).distinct(), list(keys))
    inside = spikes_in_windows(spikes, windows, keys).groupBy(*keys, unit, trial).agg(_n().alias("n"))
    found = spine.join(inside, [*keys, unit, trial], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("rate", F.try_divide(F.col("n").cast("double"), F.col("stop") - F.col("start")))


def session_drift(rates: DataFrame, keys: Sequence[str] = ("session", "unit_id"), start: str = "start", rate: str = "rate") -> DataFrame:
    """Slope of the trial rate over the window starts (windows of positive length), and the mean start; slope 0 if not fittable."""
    fit = F.regr_slope(F.when(F.col("stop") > F.col(start), F.col(rate)), F.when(F.col("stop") > F.col(start), F.col(start)))
    return rates.groupBy(*keys).agg(F.coalesce(fit, F.lit(0.0)).alias("slope"), F.avg(start).alias("t_ref"))


def drift_corrected(rates: DataFrame, drift: DataFrame, keys: Sequence[str] = ("session", "unit_id"), start: str = "start", rate: str = "rate") -> DataFrame:
    return rates.join(drift, list(keys)).withColumn("corrected", F.col(rate) - F.col("slope") * (F.col(start) - F.col("t_ref"))).drop("slope", "t_ref")


def binned_mean_rows(rows: DataFrame, coordinate: str, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of ``value`` in equal-width bins of ``coordinate``; the top edge is in the last bin, empty bins have n 0."""
    edges = rows.groupBy(*keys).agg(F.min(coordinate).alias("_lo"), F.max(coordinate).alias("_hi"))
    joined = rows.join(edges, list(keys)) if keys else rows.crossJoin(F.broadcast(edges))
    place = F.when(F.col("_lo") == F.col("_hi"), 1).otherwise(F.least(F.width_bucket(coordinate, "_lo", "_hi", F.lit(bins)), F.lit(bins))).cast("int")
    found = joined.withColumn("bin", place - 1).where(F.col(coordinate).isNotNull()).groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    spine = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def normalize_rows_to_max(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value over the row's maximum; a silent row is 0, a missing value stays missing."""
    top = F.max(value).over(Window.partitionBy(*keys))
    return rows.withColumn("normalised", F.when(F.col(value).isNull(), None).when(top == 0, 0.0).otherwise(F.try_divide(F.col(value), top)))


def data_stats(rows: DataFrame, keys: Sequence[str], value: str, central: float = 0.95) -> DataFrame:
    """Mean, deviation, median, quartiles and the central interval of each key; quantiles exact, from ranges of distinct values."""
    from motorspark.functions.stats import _met, quantiles

    shares = {"median": 0.5, "q1": 0.25, "q3": 0.75, "low": (1 - central) / 2, "high": (1 + central) / 2}
    found = quantiles(rows, keys, value, shares)
    plain = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    out = _met(plain, found, keys, "left")
    return out.select(*keys, "mean", "std", "median", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "low", "high")


def condition_success_matrix(trials: DataFrame, columns: Sequence[str], force: str | None = None, max_forces: int = 9, success: str = "success") -> DataFrame:
    """Success rate and n per condition; more than ``max_forces`` forces go into bins of 1 whose ends both belong to them."""
    found = trials
    if force is not None and found.select(force).distinct().limit(max_forces + 1).count() > max_forces:
        low = F.floor(force).cast("double")
        # A whole number ends one bin and begins the next, and counts in both.
        bins = F.when(F.col(force) == low, F.array(low - 1, low)).otherwise(F.array(low))
        found = found.withColumn(force, F.explode(bins))
    return found.groupBy(*([force] if force else []), *columns).agg(F.avg(success).alias("success_rate"), _n().alias("n"))


def performance_by_date(trials: DataFrame, date: str = "date", success: str = "success") -> DataFrame:
    total = trials.groupBy(date).agg(_n().alias("total"), F.sum(success).alias("correct"))
    return total.withColumn("incorrect", F.col("total") - F.col("correct")).withColumn("percent", F.col("correct") * 100.0 / F.col("total"))


def cumulative_performance(by_date: DataFrame, date: str = "date", days: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over all dates up to each (or its last ``days`` dates); one row per date goes in."""
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding if days is None else -(days - 1), 0)
    return by_date.withColumns({"total_to_date": F.sum("total").over(w), "correct_to_date": F.sum("correct").over(w)})


def timepoint_coverage(timepoints: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session",)) -> DataFrame:
    """Share of trials in which each timepoint is present."""
    present = lambda c: (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("double")
    return timepoints.groupBy(*keys).agg(*[F.avg(present(c)).alias(f"has_{c}") for c in columns], _n().alias("n"))


def stage_status(manifest: DataFrame, input_time: str = "input_time", output_time: str = "output_time") -> DataFrame:
    """NEG without input, ZER without output, COR where the output is newer, else POS."""
    i, o = F.col(input_time), F.col(output_time)
    return manifest.withColumn("status", F.when(i.isNull(), "NEG").when(o.isNull(), "ZER").when(o >= i, "COR").otherwise("POS"))


def file_manifest(files: DataFrame, trials: DataFrame, stages: dict[str, tuple[str, str]]) -> DataFrame:
    """session, trial, stage, input_time and output_time of every trial and stage, from the modification times of files.

    ``files`` has path and modified; ``trials`` session and trial. A stage is
    the pattern of its input files and that of its output files, each with two
    groups, session and trial. Of several inputs the newest counts, of several
    outputs too.
    """
    of = lambda stage, role, p: F.struct(F.lit(stage).alias("stage"), F.lit(role).alias("role"), F.regexp_extract("path", p, 1).alias("session"), F.regexp_extract("path", p, 2).alias("trial"))
    every = F.array(*[of(stage, i, p) for stage, patterns in stages.items() for i, p in enumerate(patterns)])
    met = files.select("modified", F.explode(F.filter(every, lambda m: m["session"] != "")).alias("m")).select("modified", "m.*")
    newest = lambda role: F.max(F.when(F.col("role") == role, F.col("modified")))
    times = met.groupBy(F.col("session").alias("_session"), F.col("trial").alias("_trial"), F.col("stage").alias("_stage")).agg(newest(0).alias("input_time"), newest(1).alias("output_time"))
    spine = trials.select("session", "trial").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    same = (F.col("session").cast("string") == F.col("_session")) & (F.col("trial").cast("string") == F.col("_trial")) & (F.col("stage") == F.col("_stage"))
    return spine.join(times, same, "left").drop("_session", "_trial", "_stage")


def processing_status(manifest: DataFrame, keys: Sequence[str] = ("session", "stage")) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return stage_status(manifest).groupBy(*keys).agg(count("NEG"), count("ZER"), count("POS"), count("COR"), _n().alias("n"))


def encoding_summary(lags: DataFrame, scores: DataFrame, edge: float = 1.0, predictor: str = "predictor") -> DataFrame:
    """Per predictor: median lag without those at the edges, and median adjusted pR2."""
    inner = lags.where(F.abs("lag") < edge - 1e-9).groupBy(predictor).agg(F.median("lag").alias("median_lag"), _n().alias("n_lags"))
    return inner.join(scores.groupBy(predictor).agg(F.median("adj_pr2").alias("median_adj_pr2"), _n().alias("n_units")), predictor, "full")


def mode_lag(lags: DataFrame, keys: Sequence[str], lag: str = "lag") -> DataFrame:
    """The most frequent lag, the smallest of ties."""
    return lags.groupBy(*keys).agg(F.mode(lag, True).alias("mode_lag"))


def static_pose(samples: DataFrame, channel: str = "channel", trial: str = "trial", value: str = "value") -> DataFrame:
    """Median over the frames of each trial, then over trials."""
    return samples.groupBy(channel, trial).agg(F.median(value).alias("m")).groupBy(channel).agg(F.median("m").alias("pose"))


def marker_completeness(markers: DataFrame, keys: Sequence[str] = ("marker",), value: str = "x") -> DataFrame:
    return markers.groupBy(*keys).agg(F.avg((F.col(value).isNotNull() & ~F.isnan(value)).cast("double")).alias("completeness"))


def common_conditions(peth: DataFrame, keys: Sequence[str] = ("session",), unit: str = "unit_id", condition: str = "condition") -> tuple[DataFrame, DataFrame]:
    """Conditions that all units have, and those that some lack."""
    units = peth.groupBy(*keys).agg(F.count_distinct(unit).alias("_all"))
    has = peth.groupBy(*keys, condition).agg(F.count_distinct(unit).alias("_n")).join(units, list(keys))
    pick = lambda rule: has.where(rule).select(*keys, condition)
    return pick("_n = _all"), pick("_n < _all")


def condition_matrix(peth: DataFrame, keys: Sequence[str] = ("session",), value: str = "rate_avg") -> DataFrame:
    """One row per session, condition and bin, with the units' values as a map, on common conditions."""
    kept, _ = common_conditions(peth, keys)
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("unit_id").cast("string"), value))))
    return peth.join(kept, [*keys, "condition"], "left_semi").groupBy(*keys, "condition", "bin").agg(pairs.alias("rates"))


def marginal_means(peth: DataFrame, value: str = "rate_avg", keys: Sequence[str] = ("session", "unit_id")) -> DataFrame:
    """Demixed parts of each unit: over time, over conditions, and their interaction.

    ``m_time`` is the time mean less the grand mean; ``m_condition`` holds the
    condition part and the interaction, as both answer to the condition.
    """
    by = lambda *more: Window.partitionBy(*keys, *more)
    grand, time, cond = F.avg(value).over(by()), F.avg(value).over(by("bin")), F.avg(value).over(by("condition"))
    return peth.withColumns({"grand": grand, "m_time": time - grand, "m_only_condition": cond - grand, "m_interaction": F.col(value) - time - cond + grand}).withColumn(
        "m_condition", F.col("m_only_condition") + F.col("m_interaction")
    )


#: Points of a name in the choice of the pulse channel (fixed values).
TTL_POINTS = (("ttl", 3), ("sync", 2), ("ap", 1), ("message", -1))


def ttl_channel_choice(events: DataFrame, keys: Sequence[str] = ("session",), name: str = "stream_name") -> DataFrame:
    """The best channel: most points of its name, then most events, then the first name."""
    points = sum((F.when(F.lower(name).contains(word), p).otherwise(0) for word, p in TTL_POINTS), F.lit(0))
    counts = events.groupBy(*keys, name).agg(_n().alias("n")).withColumn("points", points)
    w = Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc("n"), name)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def electrode_table(units: DataFrame, keys: Sequence[str] = ("session", "channel_id"), pitch: float = 400.0) -> DataFrame:
    """One row per channel, the first unit's, with its place on the grid; channels without geometry are left out."""
    w = Window.partitionBy(*keys).orderBy("unit_id")
    one = units.where("channel_row IS NOT NULL AND channel_col IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.withColumns({"x_um": F.col("channel_col") * pitch, "y_um": F.col("channel_row") * pitch})


def validate_design(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows, values that aren't finite, and the columns that are constant."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bad = sum((F.count_if(~finite(c)) for c in columns), F.lit(0))
    constant = F.array_compact(F.array(*[F.when(F.stddev_pop(F.when(finite(c), F.col(c))) == 0, c) for c in columns]))
    return rows.groupBy(*keys).agg(_n().alias("n"), bad.alias("not_finite"), constant.alias("constant"))


def evaluate_status(rows: DataFrame, rules: Sequence[tuple[str, Column]], default: str = "NEG") -> DataFrame:
    """``status`` by the first of the caller's rules (name, condition) that holds."""
    made = None
    for name, rule in rules:
        made = F.when(rule, name) if made is None else made.when(rule, name)
    return rows.withColumn("status", F.lit(default) if made is None else made.otherwise(default))


def cumulative_success_matrix(trials: DataFrame, columns: Sequence[str], session: str = "session", success: str = "success") -> DataFrame:
    """Success rate and n per condition over all sessions up to each, as they are ordered."""
    by = trials.groupBy(*columns, session).agg(F.sum(success).alias("_s"), _n().alias("_k"))
    w = Window.partitionBy(*columns).orderBy(session).rowsBetween(Window.unboundedPreceding, 0)
    return by.select(*columns, session, (F.sum("_s").over(w) / F.sum("_k").over(w)).alias("success_rate"), F.sum("_k").over(w).alias("n"))
