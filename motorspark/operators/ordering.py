"""Sorting, top-k, sampling and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions.columns import numbered


def rank_fraction(df: DataFrame, value: str, top: float, bottom: float, keys: Sequence[str] = ("session",), tie: str = "unit_id") -> DataFrame:
    """Rows among the largest / smallest round(f * n) finite values (one at least), as ``part``; ties by ``tie``."""
    f = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    f = f.withColumn("_n", n).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value, tie)))
    low = F.greatest(F.bround(F.col("_n") * bottom), F.lit(1.0))
    high = F.greatest(F.bround(F.col("_n") * top), F.lit(1.0))
    part = F.when(F.col("_r") > F.col("_n") - high, "top").when(F.col("_r") <= low, "bottom")
    return f.withColumn("part", part).where("part IS NOT NULL").drop("_n", "_r")


def natural_key(column: str, width: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers."""
    marked = F.regexp_replace(column, r"(\d+)", "\u0001$1\u0002")
    parts = F.split(marked, "[\u0001\u0002]")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(F.lower(p))), "")


def natural_sort(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(column), column)


def positions(df: DataFrame, key: str, prefix: int = 2) -> DataFrame:
    """``df`` with ``position`` from 1 in the order of the text ``key``.

    Rows are ordered within what begins alike, and each such part starts where
    those before it end, so no task orders everything.
    """
    part = F.substring(F.col(key), 1, prefix)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return df.withColumn("_part", part).withColumn("_in", inside).join(starts, "_part").withColumn("position", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def modulated_units(rates: DataFrame, alpha: float, keys: Sequence[str] = ("session", "unit_id"), group: str = "condition", value: str = "rate") -> DataFrame:
    """Units whose rate differs between conditions (Kruskal-Wallis, p < alpha), in order of p."""
    from motorspark.functions.stats import kruskal

    p = kruskal(rates, keys, group, value).where(F.col("p") < alpha)
    # What rounding tells apart is a tie.
    return p.withColumn("position", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(F.round("p", 9), keys[-1])) - 1)


def unique_unit_ids(units: DataFrame, keys: Sequence[str] = ("session",), label: str = "unit_label", order: str = "seq") -> DataFrame:
    """Ids from labels, repeats with _1, _2 ..."""
    f = numbered(units, [*keys, label], [order], "_k")
    return f.withColumn("unit_id", F.when(F.col("_k") == 0, F.col(label)).otherwise(F.concat_ws("_", label, F.col("_k").cast("string")))).drop("_k")


def sample_trials(trials: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ("session",), trial: str = "trial", even: bool = False) -> DataFrame:
    """``n`` trials of a session: by a seeded hash, or evenly spaced from the first to the last."""
    if not even:
        w = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, trial), trial)
        return trials.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    f = numbered(trials, keys, [trial], "_i").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(max(n - 1, 1))).cast("int"))
    return f.where(F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def condition_sets(a: DataFrame, b: DataFrame, column: str = "condition") -> DataFrame:
    """Each value with where it is: both, only a, only b."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    parts = ((x.intersect(y), "both"), (x.subtract(y), "a"), (y.subtract(x), "b"))
    made = [p.withColumn("where", F.lit(w)) for p, w in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


def union_of_times(*parts: DataFrame, keys: Sequence[str] = ("session",), time: str = "t") -> DataFrame:
    out = parts[0].select(*keys, time)
    for p in parts[1:]:
        out = out.union(p.select(*keys, time))
    return out.distinct()


def concat_logs(*parts: DataFrame) -> DataFrame:
    """Logs under each other, with ``part`` in front of ``seq`` as the order."""
    made = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = made[0]
    for p in made[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pseudopopulation(trials: DataFrame, seed: int = 0, condition: str = "condition", trial: str = "trial", by: Sequence[str] = ()) -> DataFrame:
    """(session, condition, trial, draw): per condition as many draws as the session with the fewest trials has.

    Conditions that a session lacks are left out. With ``by``, each group is a
    population of its own.
    """
    keys = list(by)
    own = Window.partitionBy(*keys, "session", condition)
    f = trials.select(*keys, "session", condition, trial).distinct()
    f = f.withColumn("draw", (F.row_number().over(own.orderBy(F.xxhash64(F.lit(seed), "session", condition, trial), trial)) - 1).cast("int"))
    sizes = f.groupBy(*keys, "session", condition).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.groupBy(*keys).agg(F.count_distinct("session").alias("_s"))
    least = sizes.groupBy(*keys, condition).agg(F.min("_n").alias("_n"), F.count(F.lit(1)).alias("_has"))
    least = (least.join(total, keys) if keys else least.crossJoin(F.broadcast(total))).where("_has = _s")
    return f.join(least, [*keys, condition]).where("draw < _n").select(*keys, "session", condition, trial, "draw")
