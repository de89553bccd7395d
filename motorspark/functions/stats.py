"""Statistics: ranks and sums in Spark, p-values from a small helper on the sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions import kernels
from motorspark.functions.columns import pearson
from motorspark.sources.scratch import stored


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joined on keys of which null is one like any other."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def cumulated(counts: DataFrame, keys: Sequence[str], value: str, n: str = "ties", end: str = "end") -> DataFrame:
    """``counts`` (one row for each key and distinct value, with ``n`` rows of it) and ``end``, the rows of the key up to this value.

    Values are dealt by ranges, summed within their range, and a range starts
    where the key's ranges before it end: a key of very many values is many
    tasks, and none holds or sorts all of them. The ranges are a table, so
    that both passes see the same ones.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()), "stats-ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    starts = ranged.groupBy(*keys, "_range").agg(F.sum(n).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = F.sum(n).over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return _met(ranged.withColumn("_in", inside), starts, [*keys, "_range"]).withColumn(end, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def average_ranks(counts: DataFrame, keys: Sequence[str], value: str, rank: str = "rank", ties: str = "ties") -> DataFrame:
    """The average rank of each distinct value of a key; ``counts`` has one row for each, with the size of its tie."""
    f = cumulated(counts, keys, value, ties, "_end")
    return f.withColumn(rank, F.col("_end") - (F.col(ties) - 1) / 2.0).drop("_end")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of each key, named by ``shares``, interpolated between order statistics; nulls don't count.

    Only distinct values with their numbers are shuffled, and no task holds a
    key's values.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    f = cumulated(c, keys, value, "_n", "_end")
    f = _met(f, c.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    place = lambda p: (F.col("_all") - 1) * F.lit(float(p))
    at = lambda k: F.max(F.when((F.col("_end") - F.col("_n") <= k) & (k < F.col("_end")), F.col(value)))
    found = f.groupBy(*keys, "_all").agg(*[e for name, p in shares.items() for e in (at(F.floor(place(p))).alias(f"_lo_{name}"), at(F.ceil(place(p))).alias(f"_hi_{name}"))])
    part = lambda p: place(p) - F.floor(place(p))
    return found.select(*keys, *[(F.col(f"_lo_{name}") * (1 - part(p)) + F.col(f"_hi_{name}") * part(p)).alias(name) for name, p in shares.items()])


def _finite(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def _tied() -> Column:
    """What a tie takes from the variance of ranks."""
    t = F.col("ties").cast("double")
    return t * (t * t - 1)


def mann_whitney(df: DataFrame, keys: Sequence[str], group: str, value: str, first: object, second: object, alternative: str = "two-sided") -> DataFrame:
    """U of the first sample, p, rank-biserial r = 1 - 2 U / (n1 n2), n1 and n2.

    With this formula r is negative where the first sample is the larger.
    """
    each = _finite(df, value).where(F.col(group).isin([first, second])).groupBy(*keys, value)
    f = average_ranks(each.agg(F.count(F.lit(1)).alias("ties"), F.count_if(F.col(group) == first).alias("_one")), keys, value)
    n1, n2 = F.sum("_one"), F.sum(F.col("ties") - F.col("_one"))
    s = f.groupBy(*keys).agg((F.sum(F.col("rank") * F.col("_one")) - n1 * (n1 + 1) / 2).alias("u"), n1.alias("n1"), n2.alias("n2"), F.sum(_tied()).alias("_ties"))

    @F.pandas_udf("double")
    def p(u: pd.Series, a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([kernels.mann_whitney_p(*x, alternative) for x in zip(u, a, b, t, strict=True)])

    return s.withColumn("p", p("u", "n1", "n2", "_ties")).withColumn("r", 1 - F.try_divide(2 * F.col("u"), (F.col("n1") * F.col("n2")).cast("double"))).drop("_ties")


def signed_rank(df: DataFrame, keys: Sequence[str], a: str, b: str, zero_method: str = "wilcox") -> DataFrame:
    """W = min(W+, W-), p, rank-biserial (W+ - W-) / (W+ + W-), n. Zeros: wilcox drops, pratt ranks, zsplit halves them."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).where("_d IS NOT NULL AND NOT isnan(_d)")
    if zero_method == "wilcox":
        d = d.where("_d <> 0")
    each = d.withColumn("_abs", F.abs("_d")).groupBy(*keys, "_abs")
    counts = each.agg(F.count(F.lit(1)).alias("ties"), F.count_if(F.col("_d") > 0).alias("_up"), F.count_if(F.col("_d") < 0).alias("_down"))
    f = average_ranks(counts, keys, "_abs")
    zero = F.col("ties") - F.col("_up") - F.col("_down")
    half = F.sum(F.col("rank") * zero) / 2 if zero_method == "zsplit" else F.lit(0.0)
    s = f.groupBy(*keys).agg(
        (F.sum(F.col("rank") * F.col("_up")) + half).alias("_plus"), (F.sum(F.col("rank") * F.col("_down")) + half).alias("_minus"), F.sum("ties").alias("n"), F.sum(zero).alias("_zeros"),
        F.sum(F.when(F.col("_abs") > 0, _tied()).otherwise(0.0)).alias("_ties"),
    )

    @F.pandas_udf("double")
    def p(plus: pd.Series, minus: pd.Series, n: pd.Series, zeros: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for x, y, m, z, t in zip(plus, minus, n, zeros, ties, strict=True):
            if zero_method == "pratt" and z:
                mean = m * (m + 1) / 4 - z * (z + 1) / 4
                var = (m * (m + 1) * (2 * m + 1) - z * (z + 1) * (2 * z + 1)) / 24 - t / 48
                out.append(kernels.signed_rank_p(x, y, m, t, False, mean, var))
            else:
                out.append(kernels.signed_rank_p(x, y, m, t, t == 0 and z == 0))
        return pd.Series(out)

    effect = F.try_divide(F.col("_plus") - F.col("_minus"), F.col("_plus") + F.col("_minus"))
    return s.select(*keys, F.least("_plus", "_minus").alias("w"), p("_plus", "_minus", "n", "_zeros", "_ties").alias("p"), effect.alias("r"), "n")


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Tie-corrected H, its chi-square p, groups and n."""
    each = _finite(df, value).groupBy(*keys, value, group).agg(F.count(F.lit(1)).alias("_m"))
    # A value's numbers by group travel with it: as many as there are groups.
    f = average_ranks(each.groupBy(*keys, value).agg(F.sum("_m").alias("ties"), F.collect_list(F.struct(F.col(group).alias("g"), F.col("_m").alias("m"))).alias("_by")), keys, value)
    ties = f.groupBy(*keys).agg(F.sum(_tied()).alias("_t"))
    g = f.select(*keys, "rank", F.explode("_by").alias("_b")).groupBy(*keys, "_b.g").agg(F.sum(F.col("rank") * F.col("_b.m")).alias("_r"), F.sum("_b.m").alias("_n"))
    s = g.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups"))
    s = _met(s, ties, keys)
    n = F.col("n").cast("double")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1), 1 - F.try_divide(F.col("_t"), n * n * n - n))

    @F.pandas_udf("double")
    def p(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([math.nan if pd.isna(x) or g < 2 else kernels.chi2_tail(x, int(g) - 1) for x, g in zip(h, k, strict=True)])

    return s.withColumn("h", h).withColumn("p", p("h", "groups")).select(*keys, "h", "p", "groups", "n")


def encoding_pair_tests(results: DataFrame, value: str = "adj_pr2", keys: Sequence[str] = ("session", "unit_id")) -> DataFrame:
    """Per pair of predictors: median difference, signed-rank p and effect."""
    from motorspark.operators.pairing import paired_units

    pairs = paired_units(results, value, keys=keys)
    by = ["predictor_a", "predictor_b"]
    medians = pairs.groupBy(*by).agg(F.median(F.col("value_a") - F.col("value_b")).alias("median_difference"))
    return medians.join(signed_rank(pairs, by, "value_a", "value_b"), by)


def histogram(df: DataFrame, keys: Sequence[str], value: str, limit: float, bins: int) -> DataFrame:
    """Counts in equal bins of the symmetric range [-limit, limit], the top edge in the last."""
    place = F.least(F.width_bucket(value, F.lit(-limit), F.lit(limit), F.lit(bins)), F.lit(bins)).cast("int") - 1
    return df.where(F.abs(value) <= limit).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, keys: Sequence[str], y: str, prediction: str) -> DataFrame:
    """Pearson r, rmse and r2 of predictions; r is null at zero variance, r2 where y is constant."""
    e = F.col(y) - F.col(prediction)
    return df.groupBy(*keys).agg(
        pearson(y, prediction).alias("r"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.count(y).alias("n")
    )


def poisson_deviance(y: Column, mu: Column) -> Column:
    return F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu)


def poisson_pr2(df: DataFrame, keys: Sequence[str], y: str, mu: str, predictors: int = 1) -> DataFrame:
    """1 - deviance / deviance of the mean-only model; and adjusted for n and the number of predictors."""
    # Means are one row a key, stored, so that Spark knows how small they are; no task gets a key's rows.
    means = stored(df.groupBy(*keys).agg(F.avg(y).alias("_mean")), "poisson-means")
    f = _met(df, means, keys)
    dev, null = F.sum(poisson_deviance(F.col(y), F.col(mu))), F.sum(poisson_deviance(F.col(y), F.col("_mean")))
    s = f.groupBy(*keys).agg((1 - F.try_divide(dev, null)).alias("pr2"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("adj_pr2", 1 - (1 - F.col("pr2")) * F.try_divide((F.col("n") - 1).cast("double"), (F.col("n") - predictors - 1).cast("double")))


def effect_size(observed: DataFrame, null: DataFrame, keys: Sequence[str], greater: bool = True) -> DataFrame:
    """z, robust z (MAD * 1.4826), percentile of the observed value in the null, and p = (1 + k) / (n + 1)."""
    f = null.select(*keys, F.col("value").alias("_v")).join(observed.select(*keys, F.col("value").alias("_o")), list(keys))
    med = f.groupBy(*keys).agg(F.median("_v").alias("_med"))
    f = f.join(med, list(keys))
    k = F.count_if(F.col("_v") >= F.col("_o") if greater else F.col("_v") <= F.col("_o"))
    n = F.count(F.lit(1))
    return f.groupBy(*keys, F.col("_o").alias("observed")).agg(
        F.try_divide(F.first("_o") - F.avg("_v"), F.stddev_pop("_v")).alias("z"),
        F.try_divide(F.first("_o") - F.first("_med"), F.median(F.abs(F.col("_v") - F.col("_med"))) * 1.4826).alias("robust_z"),
        (F.count_if(F.col("_v") < F.col("_o")) * 100.0 / n).alias("percentile"), ((k + 1.0) / (n + 1.0)).alias("p"), n.alias("n"),
    )


def chance_level(null: DataFrame, keys: Sequence[str], value: str = "accuracy", percentile: float = 0.95) -> DataFrame:
    return null.groupBy(*keys).agg(F.percentile(value, F.lit(percentile)).alias("chance"))


def theoretical_chance(trials: DataFrame, keys: Sequence[str], condition: str = "condition") -> DataFrame:
    return trials.groupBy(*keys).agg((1.0 / F.count_distinct(condition)).alias("chance"))
