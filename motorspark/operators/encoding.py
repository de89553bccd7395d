"""Encoding jobs: the optimal lag in two steps, and runs that pass over what is stored.

The cheap step scans all lags with sums of products over chunks of trials; the
dear one fits a Poisson GLM once for each unit, at the lag that the cheap one
found. Each unit is routed to the design of its own lag: a session's design is
laid out once for each lag that some unit of it has, with these units alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorspark.operators.models import _keys_ddl, per_group, poisson_glm_cv
from motorspark.sources.results import ResultStore
from motorspark.sources.scratch import stored

#: The least mean rate that is searched, and the least adjusted pR2 that counts in a session's lag.
MIN_RATE_HZ, MIN_ADJ_R2 = 0.5, 0.025
#: Columns of the stored results.
LAGS = "session date, unit_id string, mean_rate double, searched_lag int, best_lag int, best_pr2 double, adj_pr2 double, mode_lag int"
ENCODINGS = "session date, lag int, unit_id string, pr2 double, adj_pr2 double, folds array<double>"
#: Bins of a chunk of trials.
CHUNK = 8192


def _places(design: DataFrame, keys: Sequence[str]) -> DataFrame:
    return design.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "trial").orderBy("t")))


def lag_surrogate(design: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("session",), units: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """keys, unit_id, lag, r2: of least squares of the root of a unit's rate at t on x at t + lag, for all units of a design at once.

    A chunk of trials gives one sum of products a lag; these are added up by
    Spark. Lags of no more samples than predictors have no r2, nor do units
    of constant rate. ``units`` (keys, unit_id) are those that are searched.
    """
    design = stored(design, "encoding-sweep")
    f = design if units is None else design.join(units.groupBy(*keys).agg(F.collect_set("unit_id").alias("_units")), list(keys)).withColumn("y", F.map_filter("y", lambda u, _: F.array_contains("_units", u))).drop("_units")
    sizes = f.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("y"))))).alias("_units"))
    rows = f.join(sizes, list(keys)).where(F.size("_units") > 0)
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("trial"), F.col("_chunks")))
    rows = rows.select(*keys, "_chunk", "trial", "t", "x", F.transform("_units", lambda u: F.sqrt(F.greatest(F.coalesce(F.element_at("y", u), F.lit(0.0)), F.lit(0.0)))).alias("s"))

    def sums(pdf: pd.DataFrame) -> list[dict]:
        out: dict[int, np.ndarray] = {}
        for _, g in pdf.sort_values(["trial", "t"]).groupby("trial", sort=False):
            x, s = np.array(g["x"].tolist(), float), np.array(g["s"].tolist(), float)
            for k in lags:
                a, b = (x[k:], s[: len(s) - k]) if k >= 0 else (x[:k], s[-k:])
                if len(a):
                    z = np.concatenate((np.ones((len(a), 1)), a), 1)
                    part = np.concatenate(((z.T @ z).reshape(-1), (z.T @ b).reshape(-1), (b * b).sum(0)))
                    out[k] = out[k] + part if k in out else part
        d, u = len(pdf["x"].iloc[0]) + 1, len(pdf["s"].iloc[0])
        return [{"lag": int(k), "d": d, "u": u, "part": v.tolist()} for k, v in out.items()]

    parts = per_group(rows, [*keys, "_chunk"], sums, "lag int, d int, u int, part array<double>")
    by = [*keys, "lag", "d", "u"]
    added = parts.select(*by, F.posexplode("part").alias("_at", "_v")).groupBy(*by, "_at").agg(F.sum("_v").alias("_v"))
    added = added.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda p: p["_v"]).alias("g"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                d, u, g = r["d"], r["u"], np.asarray(r["g"], float)
                zz, zs, ss = g[: d * d].reshape(d, d), g[d * d : d * d + d * u].reshape(d, u), g[d * d + d * u :]
                n = zz[0, 0]
                if n <= d:
                    continue
                c, cs, tss = zz[1:, 1:] - np.outer(zz[0, 1:], zz[0, 1:]) / n, zs[1:] - np.outer(zz[0, 1:], zs[0]) / n, ss - zs[0] ** 2 / n
                explained = (np.linalg.lstsq(c, cs, rcond=None)[0] * cs).sum(0)
                out += [{k: r[k] for k in keys} | {"lag": r["lag"], "unit_id": name, "r2": float(e / t)} for name, e, t in zip(r["_units"], explained, tss, strict=True) if t > 1e-12 * max(n, 1)]
            yield pd.DataFrame(out, columns=[*keys, "lag", "unit_id", "r2"])

    # The names of the units are one row a design.
    return added.join(sizes.select(*keys, "_units"), list(keys)).mapInPandas(solve, f"{_keys_ddl(design, keys)}, lag int, unit_id string, r2 double")


def at_lags(design: DataFrame, lags: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The design once for each lag that some unit has: x at t + lag, y of these units alone. ``lags`` has keys, unit_id, lag in bins."""
    groups = lags.groupBy(*keys, "lag").agg(F.collect_set("unit_id").alias("_own"))
    f = _places(design, keys)
    y = f.join(groups, list(keys)).withColumn("y", F.map_filter("y", lambda u, _: F.array_contains("_own", u))).drop("x", "_own")
    x = f.select(*keys, "trial", F.col("_i").alias("_j"), "x")
    return y.withColumn("_j", F.col("_i") + F.col("lag")).join(x, [*keys, "trial", "_j"]).drop("_i", "_j")


def optimal_lags(design: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("session",), min_rate: float = MIN_RATE_HZ, min_adj_r2: float = MIN_ADJ_R2, **fit: object) -> DataFrame:
    """keys, unit_id, mean_rate, searched_lag, best_lag, best_pr2, adj_pr2 and the session's mode_lag, in bins, of every unit.

    Units of at most ``min_rate`` aren't searched. The searched lag is that of
    the best surrogate, edge lags left out, ties to the smallest; the GLM is
    fitted there. Below ``min_adj_r2`` a unit has no best lag. The session's
    lag is the most frequent one, the smallest of ties, and 0 without any.
    """
    design = stored(design, "encoding-design")
    each = design.select(*keys, F.explode("y").alias("unit_id", "rate"))
    rates = each.groupBy(*keys, "unit_id").agg((F.sum("rate")).alias("_sum")).join(design.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), list(keys))
    rates = rates.select(*keys, "unit_id", (F.col("_sum") / F.col("_n")).alias("mean_rate"))
    order = sorted(lags)
    inner = order[1:-1] if len(order) > 2 else order
    sweep = lag_surrogate(design, order, keys, rates.where(F.col("mean_rate") > min_rate))
    best = sweep.where(F.col("lag").isin(list(inner))).groupBy(*keys, "unit_id").agg(F.max_by("lag", F.struct(F.round("r2", 12), -F.col("lag"))).alias("lag"))
    best = stored(best, "encoding-lags")
    confirmed = poisson_glm_cv(stored(at_lags(design, best, keys), "encoding-at-lags"), [*keys, "lag"], **fit)
    confirmed = confirmed.select(*keys, "unit_id", F.col("lag").alias("searched_lag"), "pr2", "adj_pr2")
    good = ~F.isnan("adj_pr2") & (F.col("adj_pr2") >= min_adj_r2)
    confirmed = confirmed.withColumns({"best_lag": F.when(good, F.col("searched_lag")), "best_pr2": F.when(good, F.col("pr2"))}).drop("pr2")
    out = rates.join(confirmed, [*keys, "unit_id"], "left")
    modes = out.where("best_lag IS NOT NULL").groupBy(*keys).agg(F.mode("best_lag", True).alias("mode_lag"))
    out = out.join(modes, list(keys), "left").withColumn("mode_lag", F.coalesce("mode_lag", F.lit(0)))
    return out.select(*keys, "unit_id", "mean_rate", "searched_lag", "best_lag", "best_pr2", "adj_pr2", "mode_lag")


def encode_at_lag(design: DataFrame, modes: DataFrame, keys: Sequence[str] = ("session",), **fit: object) -> DataFrame:
    """The GLM of every unit at its session's mode lag, 0 without one."""
    lag = design.select(*keys, F.explode(F.map_keys("y")).alias("unit_id")).distinct()
    lag = lag.join(modes.select(*keys, F.col("mode_lag").cast("int").alias("lag")).distinct(), list(keys), "left").withColumn("lag", F.coalesce("lag", F.lit(0)))
    return poisson_glm_cv(stored(at_lags(design, lag, keys), "encoding-at-lags"), [*keys, "lag"], **fit)


def run_encoding(design: DataFrame, lags: Sequence[int], lag_store: ResultStore, encoding_store: ResultStore, keys: Sequence[str] = ("session",), overwrite: bool = False, min_rate: float = MIN_RATE_HZ, min_adj_r2: float = MIN_ADJ_R2, **fit: object) -> tuple[DataFrame, DataFrame]:
    """Lags and encodings of all designs, from the stores where they are there, and added to them where not.

    A session whose lag is stored but whose encoding isn't gets the encoding
    at the stored lag. Returns both tables as they are stored then.
    """
    design = stored(design, "encoding-design")
    there = design.select(*keys).distinct()
    todo = there if overwrite else lag_store.missing(there)
    lag_store.upsert(optimal_lags(design.join(todo, list(keys), "left_semi"), lags, keys, min_rate, min_adj_r2, **fit), todo)
    todo = there if overwrite else encoding_store.missing(there)
    modes = lag_store.read().select(*keys, "mode_lag").distinct()
    encoding_store.upsert(encode_at_lag(design.join(todo, list(keys), "left_semi"), modes, keys, **fit), todo)
    return lag_store.read(), encoding_store.read()
