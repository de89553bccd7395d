"""Scalar functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, and the hand segments of each, as patterns (fixed values).
DIGITS = {"thumb": r"^(thumb|pollex|1(mc|pp|dp))", "index": r"^(index|2(mc|pm|md|pd|dp))", "middle": r"^(middle|3(mc|pm|md|pd|dp))", "ring": r"^(ring|4(mc|pm|md|pd|dp))", "pinky": r"^(pinky|little|5(mc|pm|md|pd|dp))"}


def format_p(p: str | Column) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    value = lambda n: F.concat(F.lit("p = "), F.format_string(f"%.{n}f", F.round(p, n)))
    return F.when(p < 0.0001, "p < 0.0001").when(p < 0.001, value(4)).when(p < 0.01, value(3)).otherwise(value(2))


def experiment_type(name: str) -> Column:
    low = F.lower(name)
    return F.when(low.contains("force"), "force").when(low.contains("passive"), "passive").when(low.contains("grasp"), "grasp").otherwise("unknown")


def extract_date(text: str) -> Column:
    """The first date of the form Y.M.D with . - or _ between; two-digit years are of this century."""
    pattern = r"(\d{4}|\d{2})[._-](\d{1,2})[._-](\d{1,2})"
    y, m, d = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y < 100, y + 2000).otherwise(y)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, m, d))


def trailing_int(text: str) -> Column:
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("long")


def unit_id_text(value: str) -> Column:
    """12.0 as '12', other numbers as they are."""
    v = F.col(value).cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def digit_of(segment: str) -> Column:
    out = F.when(F.lower(segment).rlike(DIGITS["thumb"]), "thumb")
    for name in ("index", "middle", "ring", "pinky"):
        out = out.when(F.lower(segment).rlike(DIGITS[name]), name)
    return out


def grid_position(row: str, col: str, pitch: float = 400.0) -> tuple[Column, Column]:
    return F.col(col) * pitch, F.col(row) * pitch


def probe_position(index: str, pitch: float = 20.0, staggered: bool = False, shift: float = 16.0) -> tuple[Column, Column]:
    """Linear probe: a column of sites; staggered: two columns in turn."""
    i = F.col(index)
    if not staggered:
        return F.lit(0.0), i * pitch
    return (i % 2) * F.lit(shift), F.floor(i / 2) * pitch


def condition_label(definition: str, leave_out: str = "force") -> Column:
    """Entries of a map as k=v, without those whose key has ``leave_out`` in it."""
    kept = F.map_filter(definition, lambda k, _: ~F.lower(k).contains(leave_out))
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", ")


def trial_event_time(event: str) -> Column:
    if event == "movement_onset":
        return F.least("shoulder_onset", "elbow_onset", "wrist_onset", "finger_onset")
    if event == "initial_grasp":
        return F.col("first_grasp_start")
    if event == "mid_grasp":
        return (F.col("first_grasp_start") + F.col("release")) / 2
    raise ValueError(f"no such event: {event}")


def dup_suffix(trial: str, dup: str) -> Column:
    return F.concat(F.lit("trial"), F.col(trial).cast("string"), F.when(F.col(dup) > 0, F.concat(F.lit("_"), F.col(dup).cast("string"))).otherwise(""))
