"""Projections, filters and predicates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION_NAME = r"^(\d{4})_(\d{2})_(\d{2})(?:_Set(\d+))?"
#: Manual codes that take a trial out of analysis (fixed values).
BAD_CODES = ("0", "2", "3", "4", "5", "?", "14")


def select_sessions(df: DataFrame, column: str = "session") -> DataFrame:
    """Sessions whose names are dates, with ``date`` and ``set_number`` (1 without a set)."""
    part = lambda i: F.regexp_extract(column, SESSION_NAME, i)
    return df.where(F.col(column).rlike(SESSION_NAME)).withColumns({
        "date": F.try_to_date(F.concat_ws("-", part(1), part(2), part(3))),
        "set_number": F.coalesce(part(4).try_cast("int"), F.lit(1)),
    })


def sessions_by_date(df: DataFrame, column: str = "session") -> DataFrame:
    return select_sessions(df, column).groupBy("date").agg(F.array_sort(F.collect_set(column)).alias("sessions"))


def filter_trials(trials: DataFrame, only_successful: bool = True, manual: DataFrame | None = None, keys: Sequence[str] = ("session", "trial_number"), bad: Sequence[str] = BAD_CODES) -> DataFrame:
    """Successful trials without a manual code in ``bad``; ``manual`` has ``codes`` (array<string>) by key."""
    found = trials.where("success = 1") if only_successful else trials
    if manual is None:
        return found
    codes = manual.select(*keys, F.col("codes").alias("_codes"))
    hit = F.arrays_overlap("_codes", F.array(*map(F.lit, bad)))
    return found.join(codes, list(keys), "left").where(~F.coalesce(hit, F.lit(False))).drop("_codes")


def split_codes(column: str) -> Column:
    """'1,3' as an array of trimmed codes; empty or null as an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ","), F.trim), lambda x: x != "")


def filter_dofs(df: DataFrame, joint_group: Sequence[str] | None = None, column: str = "channel", prefix: str = "ra_", suffix: str = "_d") -> DataFrame:
    """Channels that start with ``prefix`` and don't end with ``suffix``, of a group if one is given."""
    found = df.where(F.col(column).startswith(prefix) & ~F.col(column).endswith(suffix))
    return found if joint_group is None else found.where(F.col(column).isin(list(joint_group)))


def normalise_label(column: str) -> Column:
    return F.lower(F.trim(column))


def select_units(units: DataFrame, labels: Sequence[str], column: str = "label") -> DataFrame:
    """Units whose label, trimmed and in lower case, is in ``labels``; no labels is an error."""
    wanted = sorted({x.strip().lower() for x in labels if x.strip()})
    if not wanted:
        raise ValueError("no label is given")
    return units.where(normalise_label(column).isin(wanted))


def resolve_unit_selection(units: DataFrame, wanted: Sequence[object], column: str = "unit_id") -> tuple[DataFrame, DataFrame]:
    """The units asked for (all without any), and the ids that aren't there."""
    spark = units.sparkSession
    asked = spark.createDataFrame([(str(w),) for w in wanted], "asked string")
    present = units.select(F.col(column).cast("string").alias("asked")).distinct()
    if not list(wanted):
        return units, asked
    return units.join(F.broadcast(asked), F.col(column).cast("string") == F.col("asked"), "left_semi"), asked.join(present, "asked", "left_anti")


def curate_units(units: DataFrame, query: str = "amplitude_cutoff < 0.2 AND isi_violations_ratio < 1 AND presence_ratio > 0.8 AND snr > 4") -> DataFrame:
    return units.where(F.expr(query))


def cluster_label(manual: str, auto: str) -> Column:
    """The manual group where there is one, else the automatic label."""
    return F.coalesce(F.nullif(F.trim(manual), F.lit("")), F.col(auto))


def drop_noise_clusters(spikes: DataFrame, clusters: DataFrame, keys: Sequence[str] = ("session", "unit_id")) -> DataFrame:
    noise = clusters.where(F.lower(cluster_label("manual", "auto")) == "noise").select(*keys)
    return spikes.join(noise, list(keys), "left_anti")


def period_window(period: str) -> tuple[Column, Column]:
    """Start and end of a period from the timepoints of a trial."""
    finite = lambda c: F.when(~F.isnan(c), F.col(c))
    if period == "active_movement":
        return F.least(*[finite(f"{j}_onset") for j in ("shoulder", "elbow", "wrist", "finger")]), finite("hand_retreat_time")
    if period == "active_grasp":
        return finite("first_grasp_start"), finite("release")
    raise ValueError(f"no such period: {period}")


def crop_to_period(samples: DataFrame, timepoints: DataFrame, period: str, keys: Sequence[str] = ("session", "trial"), time: str = "t") -> DataFrame:
    """Samples within the period, bounds included; trials whose window is missing or empty go."""
    if period == "all":
        return samples
    start, stop = period_window(period)
    w = timepoints.select(*keys, start.alias("_start"), stop.alias("_stop")).where("_start < _stop")
    return samples.join(w, list(keys)).where(F.col(time).between(F.col("_start"), F.col("_stop"))).drop("_start", "_stop")


def enforce_rom(samples: DataFrame, dofs: DataFrame, padding: float = 0.0, column: str = "channel", value: str = "value") -> DataFrame:
    """Values held within their channel's range, which is made narrower by ``padding`` on both sides."""
    r = dofs.select(F.col("dof_name").alias(column), "range_min", "range_max")
    held = F.least(F.greatest(F.col(value), F.col("range_min") + padding), F.col("range_max") - padding)
    return samples.join(r, column, "left").withColumn(value, F.when(F.col("range_min").isNull(), F.col(value)).otherwise(held)).drop("range_min", "range_max")


def filter_active_units(rates: DataFrame, min_rate: float, keys: Sequence[str] = ("session", "unit_id"), value: str = "rate") -> DataFrame:
    """Rows of units whose mean rate is over ``min_rate``."""
    active = rates.groupBy(*keys).agg(F.avg(value).alias("_m")).where(F.col("_m") > min_rate).select(*keys)
    return rates.join(active, list(keys), "left_semi")


def to_radians(samples: DataFrame, dofs: DataFrame, column: str = "channel", value: str = "value") -> DataFrame:
    r = dofs.select(F.col("dof_name").alias(column), F.col("rotation").alias("_rotation"))
    turned = F.when(F.col("_rotation") == 1, F.col(value) / 180.0 * math.pi).otherwise(F.col(value))
    return samples.join(r, column, "left").withColumn(value, turned).drop("_rotation")


def reflect_and_rotate(points: DataFrame, reflect: bool = False, scale: float = 0.001, shift: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points turned by 90 degrees about y, then 180 about z's partner axis x: (x, y, z) -> (z, -y, x), scaled and shifted."""
    x = -F.col("x") if reflect else F.col("x")
    return points.withColumns({"x": F.col("z") * scale - shift[0], "y": -F.col("y") * scale - shift[1], "z": x * scale - shift[2]})


def resolve_setting(explicit: str, meta: str, default: object) -> Column:
    """The first that isn't missing; an empty string in ``meta`` counts as missing."""
    return F.coalesce(F.col(explicit), F.nullif(F.col(meta), F.lit("")), F.lit(default))


def resolve_sessions(meta: DataFrame, selectors: Sequence[str], lists: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Sessions that any selector names, in the order of the selectors, each once.

    A selector is a session, ``sel:<list>``, ``region:<name>`` or
    ``burr_hole:<name>``; the last two ignore case. Selectors that match
    nothing at all are an error, never "all".
    """
    parts = []
    for i, s in enumerate(selectors):
        kind, _, name = s.partition(":")
        if kind == "sel" and name:
            hit = F.col("session").isin(list((lists or {}).get(name, [])))
        elif kind in ("region", "burr_hole") and name:
            hit = F.lower(F.trim(kind)) == name.strip().lower()
        else:
            hit = F.col("session") == s
        parts.append(F.when(hit, i))
    first = F.least(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(None)
    found = meta.withColumn("position", first).where("position IS NOT NULL").groupBy("session").agg(F.min("position").alias("position"))
    if found.isEmpty():
        raise ValueError("the selectors match no session")
    return found
