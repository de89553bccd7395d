"""Models fitted per group. Groups are sessions, units, bins or draws; Spark deals them out."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions import models as M
from motorspark.operators import series as W
from motorspark.operators.predicates import crop_to_period
from motorspark.sources.scratch import stored

#: Predictors, and the signals that each takes its channels from.
PREDICTORS = {
    "joint_angles": ("joint_angles",),
    "joint_velocity": ("joint_velocity",),
    "digit_forces": ("digit_forces",),
    "segment_forces": ("segment_forces",),
    "torques": ("torques",),
    "position_velocity": ("joint_angles", "joint_velocity"),
    "position_torques": ("joint_angles", "torques"),
    "position_segment_forces": ("joint_angles", "segment_forces"),
}


def _keys_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def per_group(df: DataFrame, keys: Sequence[str], fit: Callable[[pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """Rows that ``fit`` makes of each group, with the group's keys in front.

    Groups are few bytes and much work, so they are dealt over as many tasks
    as there are shuffle partitions, which adaptive execution must not join.
    """
    names = [p.split()[0] for p in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(fit(pdf), columns=names)
        for i, k in enumerate(keys):
            made.insert(i, k, pdf[k].iloc[0])
        return made

    return _spread(df, keys).groupBy(*keys).applyInPandas(run, f"{_keys_ddl(df, keys)}, {schema}")


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def seed_of(*parts: object) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def design_matrix(rates: DataFrame, signals: DataFrame, predictor: str, keys: Sequence[str] = ("session", "trial"), period: str = "all", timepoints: DataFrame | None = None) -> DataFrame:
    """One row per trial and bin time: ``x`` (the channels of the predictor, in name order) and ``y`` (unit -> rate).

    ``rates`` has keys, unit_id, t, rate; ``signals`` has keys, signal,
    channel, t, value. Channels are interpolated at the bins within the
    trial's common range.
    """
    kinds = PREDICTORS[predictor]
    s = signals.where(F.col("signal").isin(list(kinds))).withColumn("channel", F.concat_ws(".", "signal", "channel"))
    span = s.groupBy(*keys, "channel").agg(F.min("t").alias("a"), F.max("t").alias("b")).groupBy(*keys).agg(F.max("a").alias("_a"), F.min("b").alias("_b"))
    grid = rates.select(*keys, "t").distinct().join(span, list(keys)).where("t >= _a AND t <= _b").drop("_a", "_b")
    if timepoints is not None:
        grid = crop_to_period(grid, timepoints, period, keys)
    at = W.interpolate(grid.join(s.select(*keys, "channel").distinct(), list(keys)), s, [*keys, "channel"])
    x = at.groupBy(*keys, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda c: c["value"]).alias("x"))
    y = rates.groupBy(*keys, "t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("unit_id").cast("string"), "rate")))).alias("y"))
    return x.join(y, [*keys, "t"])


def gram(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Counts, sums and sums of products of the columns: a distributed Gram matrix in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in columns]).alias("sums"), F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("products"))


def pca(rows: DataFrame, columns: Sequence[str], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Component weights and explained shares of z-scored columns, from the Gram matrix: samples are never gathered."""
    d = len(columns)
    g = gram(rows, columns, keys) if keys else gram(rows.withColumn("_all", F.lit(0)), columns, ["_all"])
    by = list(keys) or ["_all"]

    def fit(pdf: pd.DataFrame) -> list[dict]:
        r = pdf.iloc[0]
        mean = np.array(r["sums"]) / r["n"]
        c = np.zeros((d, d))
        c[np.triu_indices(d)] = np.array(r["products"]) / r["n"]
        c = c + np.triu(c, 1).T - np.outer(mean, mean)
        s = np.sqrt(np.maximum(np.diag(c), 0))
        s = np.where(s > 1e-12, s, 1.0)
        v, u = np.linalg.eigh(c / np.outer(s, s))
        order = np.argsort(-v)[:n]
        out = []
        for k, j in enumerate(order):
            w = u[:, j] * np.sign(u[np.abs(u[:, j]).argmax(), j])
            out.append({"component": k, "weights": w.tolist(), "explained": float(v[j] / v.sum())})
        return out

    found = per_group(g, by, fit, "component int, weights array<double>, explained double")
    return found if keys else found.drop("_all")


def pca_scores(rows: DataFrame, columns: Sequence[str], components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long scores: own columns, component, score. ``components`` has at most as many rows a key as columns."""
    # Means, deviations and components are few rows a key, stored, so that Spark knows how small they are; no task gets a key's rows.
    stats = stored(rows.groupBy(*keys).agg(*[e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]), "pca-stats")
    components = stored(components, "pca-components")
    f = rows.join(stats, list(keys)) if keys else rows.crossJoin(F.broadcast(stats))
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns]
    f = f.select(*rows.columns, F.array(*z).alias("_z"))
    f = f.join(components, list(keys)) if keys else f.crossJoin(F.broadcast(components))
    score = F.aggregate(F.zip_with("_z", "weights", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return f.withColumn("score", score).drop("_z", "weights", "explained")


def demixed_pca(marginals: DataFrame, n: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Decoder, encoder and explained share of the parts time and condition of each session's population."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        wide = {c: pdf.pivot_table(c, "unit_id", ["condition", "bin"]).to_numpy(float) for c in ("centred", "m_time", "m_condition")}
        out = []
        for part in ("m_time", "m_condition"):
            dec, enc = M.dpca(wide["centred"], wide[part], n)
            total = (wide["centred"] ** 2).sum()
            for k in range(len(dec)):
                rec = np.outer(enc[:, k], dec[k] @ wide["centred"])
                share = 1 - ((wide["centred"] - rec) ** 2).sum() / total if total > 0 else 0.0
                out.append({"part": part[2:], "component": k, "decoder": dec[k].tolist(), "encoder": enc[:, k].tolist(), "explained": float(share)})
        return out

    rows = marginals.withColumn("centred", F.col("m_time") + F.col("m_condition"))
    return per_group(rows, keys, fit, "part string, component int, decoder array<double>, encoder array<double>, explained double")


def demixed_traces(peth: DataFrame, components: DataFrame, keys: Sequence[str] = ("session",), value: str = "rate_avg", sem: str = "rate_sem") -> DataFrame:
    """Condition averages on each demixed component through time, with a band: keys, part, component, condition, bin, trace, band.

    ``peth`` has a mean and its standard error for each unit, condition and
    bin; ``components`` are those of ``demixed_pca``, whose decoders follow the
    units' order. The band is the root of the sum of the squared, weighted
    standard errors; a missing one counts 0.
    """
    units = peth.select(*keys, "unit_id").distinct().withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("unit_id")) - 1)
    weights = components.select(*keys, "part", "component", F.posexplode("decoder").alias("_at", "_w")).join(units, [*keys, "_at"]).drop("_at")
    # As many rows a unit as there are components; sums are partial before the shuffle.
    f = peth.select(*keys, "unit_id", "condition", "bin", F.col(value).alias("_v"), F.coalesce(sem, F.lit(0.0)).alias("_s")).join(weights, [*keys, "unit_id"])
    band = F.sqrt(F.sum(F.col("_w") * F.col("_w") * F.col("_s") * F.col("_s")))
    return f.groupBy(*keys, "part", "component", "condition", "bin").agg(F.sum(F.col("_w") * F.col("_v")).alias("trace"), band.alias("band"))


def poisson_glm_cv(design: DataFrame, keys: Sequence[str] = ("session",), folds: int = 5, seed: int = 0, alpha: float = 1e-4, max_predictors: int | None = None, units: int = 16) -> DataFrame:
    """Held-out pR2 of every unit, as the mean over folds of whole bins; with ``max_predictors``, of the strongest by lasso.

    Units are dealt into blocks of about ``units`` by a hash, and a block is
    a group with the session's X once: a session of hundreds of units is the
    work of many tasks, and its X is moved once for each block. A unit that a
    bin has no rate for counts 0 there.
    """
    names = design.select(*keys, F.explode(F.map_keys("y")).alias("unit_id")).distinct()
    blocks = names.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / units).cast("int").alias("_blocks"))
    # A key has as many blocks as its units need, each with the part of y that is its own.
    dealt = design.join(blocks, list(keys)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    own = F.map_filter("y", lambda u, _: F.pmod(F.xxhash64(u), F.col("_blocks")) == F.col("_block"))

    def fit(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values([c for c in ("trial", "t") if c in pdf])
        x, out = _matrix(pdf["x"]), []
        ys = [dict(y) for y in pdf["y"]]
        for unit in sorted({u for y in ys for u in y}):
            y = np.array([v.get(unit, 0.0) or 0.0 for v in ys])
            pr2, adj, each = M.poisson_cv(x, y, folds, seed_of(seed, unit), alpha, max_predictors)
            out.append({"unit_id": unit, "pr2": pr2, "adj_pr2": adj, "folds": each})
        return out

    return per_group(dealt.withColumn("y", own).drop("_blocks"), [*keys, "_block"], fit, "unit_id string, pr2 double, adj_pr2 double, folds array<double>").drop("_block")


def lag_sweep(samples: DataFrame, lags: Sequence[int], x: Sequence[str], y: str = "y", keys: Sequence[str] = ("session",), trial: str = "trial", unit: str = "unit_id", order: str = "bin") -> DataFrame:
    """R2 of least squares of sqrt(y)[t] on x[t + lag] for each unit and lag.

    One window gives a sample at all lags; these fan out after it and are
    summed at once, so what is shuffled then are sums of products.
    """
    w = Window.partitionBy(*keys, trial, unit).orderBy(order)
    at = lambda k: F.struct(F.lit(int(k)).alias("lag"), *[(F.lead(c, k) if k >= 0 else F.lag(c, -k)).over(w).alias(c) for c in x])
    fanned = samples.select(*keys, unit, F.sqrt(y).alias("_y"), F.array(*[at(k) for k in lags]).alias("_at")).select(*keys, unit, "_y", F.explode("_at").alias("_p"))
    moved = fanned.select(*keys, unit, "_y", "_p.lag", *[F.col(f"_p.`{c}`").alias(c) for c in x])
    made = gram(moved.where(f"`{x[0]}` IS NOT NULL"), [*x, "_y"], [*keys, unit, "lag"])
    d = len(x)

    def r2(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.Series:
        out = []
        for m, s, p in zip(n, sums, products, strict=True):
            c = np.zeros((d + 1, d + 1))
            c[np.triu_indices(d + 1)] = np.array(p) / m
            mean = np.array(s) / m
            c = c + np.triu(c, 1).T - np.outer(mean, mean)
            if c[d, d] <= 0:
                out.append(None)
                continue
            b = np.linalg.lstsq(c[:d, :d], c[:d, d], rcond=None)[0]
            out.append(float(b @ c[:d, d] / c[d, d]))
        return pd.Series(out, dtype="float64")

    return made.withColumn("r2", F.pandas_udf(r2, "double")("n", "sums", "products")).drop("sums", "products")


def optimal_lag(sweep: DataFrame, keys: Sequence[str] = ("session", "unit_id"), least: float | None = None) -> DataFrame:
    """The lag of the best R2 of each unit, the edge lags left out, ties to the smallest."""
    edges = sweep.agg(F.min("lag").alias("_lo"), F.max("lag").alias("_hi"))
    inner = sweep.crossJoin(F.broadcast(edges)).where("lag > _lo AND lag < _hi AND r2 IS NOT NULL")
    best = inner.groupBy(*keys).agg(F.max_by("lag", F.struct("r2", -F.col("lag"))).alias("best_lag"), F.max("r2").alias("best_r2"))
    return best if least is None else best.where(F.col("best_r2") >= least)


def trial_activity(counts: DataFrame, width: float, sigma_bins: float, drift: DataFrame | None = None, keys: Sequence[str] = ("session", "unit_id")) -> DataFrame:
    """Square root of the causal-smoothed, drift-corrected and clipped rate per trial, unit and bin."""
    r = W.causal_smooth(counts, sigma_bins, [*keys, "trial"]).withColumn("rate", F.col("rate") / width)
    if drift is not None:
        r = r.join(drift, list(keys)).withColumn("rate", F.col("rate") - F.col("slope") * (F.col("tp") - F.col("t_ref"))).drop("slope", "t_ref")
    return r.withColumn("value", F.sqrt(F.greatest("rate", F.lit(0.0))))


def _by_bin(activity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per trial and bin with its vector over units, in unit order."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(F.col("unit_id").cast("string").alias("u"), "value"))), lambda s: s["value"])
    return activity.groupBy(*keys, "trial", "condition", "bin").agg(v.alias("x"))


def lda_through_time(activity: DataFrame, keys: Sequence[str] = ("session",), folds: int = 5, seed: int = 0) -> DataFrame:
    """Cross-validated accuracy per bin, and that with shuffled labels."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values("trial")
        x, y = _matrix(pdf["x"]), pdf["condition"].to_numpy()
        if len(np.unique(y)) < 2:
            return []
        mixed = np.random.default_rng(seed_of(seed, int(pdf["bin"].iloc[0]))).permutation(y)
        return [{"accuracy": M.lda_cv(x, y, folds, seed), "shuffled": M.lda_cv(x, mixed, folds, seed), "n": len(y)}]

    return per_group(_by_bin(activity, keys), [*keys, "bin"], fit, "accuracy double, shuffled double, n long")


def classified(rows: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 0, percentile: float = 0.99) -> DataFrame:
    """LDA at every bin of ``rows`` (keys, bin, trial, condition, x), with ``chance``: the percentile of the shuffled accuracies over a key's bins."""
    from motorspark.functions.stats import chance_level

    def fit(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values("trial")
        x, y = _matrix(pdf["x"]), pdf["condition"].to_numpy()
        if len(np.unique(y)) < 2:
            return []
        mixed = np.random.default_rng(seed_of(seed, int(pdf["bin"].iloc[0]))).permutation(y)
        return [{"accuracy": M.lda_cv(x, y, folds, seed), "shuffled": M.lda_cv(x, mixed, folds, seed), "n": len(y), "units": x.shape[1], "conditions": len(np.unique(y))}]

    found = per_group(rows, [*keys, "bin"], fit, "accuracy double, shuffled double, n long, units int, conditions int")
    return found.join(chance_level(found, keys, "shuffled", percentile), list(keys)).withColumn("theoretical", 1.0 / F.col("conditions"))


def depth_groups(units: DataFrame, top: float = 0.25, bottom: float = 0.25, keys: Sequence[str] = ("session",), depth: str = "depth") -> DataFrame:
    """keys, unit_id and ``depth_group`` (top, bottom) of the units farthest from the tip and nearest to it; the rest have none."""
    if not (0 < top <= 1 and 0 < bottom <= 1 and top + bottom <= 1):
        raise ValueError("the depth groups would share units")
    f = units.where(F.col(depth).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(depth).desc(), "unit_id"))
    f = f.withColumns({"_n": n, "_r": rank})
    # As many as the rounded share, one at least.
    first, last = (F.greatest(F.lit(1), F.round(F.col("_n") * share).cast("int")) for share in (top, bottom))
    group = F.when(F.col("_r") <= first, "top").when(F.col("_r") > F.col("_n") - last, "bottom")
    return f.select(*keys, "unit_id", group.alias("depth_group")).where("depth_group IS NOT NULL")


def classify_pooled(activity: DataFrame, groups: DataFrame | None = None, folds: int = 5, seed: int = 0, percentile: float = 0.99) -> DataFrame:
    """Condition from activity through time: of each session, and of all sessions' units together (``session`` null), by unit group.

    ``activity`` has session, unit_id, trial, condition, bin, value; ``groups``
    (session, unit_id, depth_group) splits the units, without it all are
    "all". Pooled trials are draws: for each condition that every session of
    the group has, as many as the session with the fewest trials gives, each
    session's own trials in an order from a hash; a pooled vector has the
    units of all sessions side by side.
    """
    from motorspark.operators.ordering import pseudopopulation

    if groups is None:
        f = activity.withColumn("depth_group", F.lit("all"))
    else:
        f = activity.join(groups.select("session", "unit_id", "depth_group"), ["session", "unit_id"])
    vector = lambda *order: F.transform(F.array_sort(F.collect_list(F.struct(*order, "value"))), lambda s: s["value"]).alias("x")
    own = f.groupBy("depth_group", "session", "bin", "trial", "condition").agg(vector(F.col("unit_id").cast("string").alias("u")))
    alone = classified(own.withColumn("trial", F.col("trial").cast("string")), ["depth_group", "session"], folds, seed, percentile)
    draws = pseudopopulation(f.select("depth_group", "session", "condition", "trial").distinct(), seed, by=("depth_group",))
    met = f.join(draws, ["depth_group", "session", "condition", "trial"])
    pooled = met.groupBy("depth_group", "bin", "condition", "draw").agg(vector("session", F.col("unit_id").cast("string").alias("u")))
    pooled = pooled.withColumn("trial", F.concat_ws(":", F.col("condition").cast("string"), F.lpad(F.col("draw").cast("string"), 9, "0"))).drop("draw")
    together = classified(pooled, ["depth_group"], folds, seed, percentile).withColumn("session", F.lit(None).cast(activity.schema["session"].dataType))
    return alone.unionByName(together)


def _trials(pdf: pd.DataFrame, column: str) -> list[np.ndarray]:
    return [_matrix(g.sort_values("bin")[column]) for _, g in pdf.groupby("trial")]


def _deal(df: DataFrame, keys: Sequence[str], folds: int, seed: int) -> DataFrame:
    """Every session once per fold, with trials marked as held out by a hash: folds are fitted in parallel."""
    own = F.pmod(F.xxhash64(F.lit(seed), *keys, "trial"), F.lit(folds)).cast("int")
    return df.withColumn("_own", own).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("held", F.col("_own") == F.col("fold")).drop("_own")


def _score(y: np.ndarray, p: np.ndarray) -> dict:
    r = [float(np.corrcoef(y[:, j], p[:, j])[0, 1]) if y[:, j].std() > 0 and p[:, j].std() > 0 else None for j in range(y.shape[1])]
    return {"r2": M.r2(y, p), "rmse": float(np.sqrt(((y - p) ** 2).mean())), "r": r}


DECODED = "trial long, r2 double, rmse double, r array<double>"


def kalman_decode_cv(rows: DataFrame, keys: Sequence[str] = ("session",), folds: int = 5, seed: int = 0) -> DataFrame:
    """``rows``: keys, trial, bin, x (rates), y (states). Scores of held-out trials, decoded from their rates alone."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        tr = pdf[~pdf["held"]]
        if tr.empty:
            return []
        a = M.kalman_fit(_trials(tr, "y"), _trials(tr, "x"))
        out = []
        for t, g in pdf[pdf["held"]].groupby("trial"):
            g = g.sort_values("bin")
            y = _matrix(g["y"])
            out.append({"trial": t} | _score(y, M.kalman_filter(_matrix(g["x"]), *a)))
        return out

    return per_group(_deal(rows, keys, folds, seed), [*keys, "fold"], fit, DECODED)


def wiener_decode_cv(rows: DataFrame, keys: Sequence[str] = ("session",), lags: int = 5, alpha: float = 1.0, folds: int = 5, seed: int = 0, components: int | None = None, decoder: Callable | None = None) -> DataFrame:
    """Lagged, standardised ridge (or ``decoder``(x, y, x_test) -> prediction), optionally on principal components of the fold."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        tr, te = pdf[~pdf["held"]], pdf[pdf["held"]]
        if tr.empty or te.empty:
            return []
        xs, ys = _trials(tr, "x"), np.concatenate(_trials(tr, "y"))
        back = np.eye(xs[0].shape[1])
        if components is not None:
            back = M.pca(np.concatenate(xs), components)[1].T
        x = np.concatenate([M.lagged(v @ back, lags) for v in xs])
        held = [(t, g.sort_values("bin")) for t, g in te.groupby("trial")]
        # Fitted once a fold; its trials are decoded together.
        z, zt = M.standardise(x, np.concatenate([M.lagged(_matrix(g["x"]) @ back, lags) for _, g in held]))
        if decoder is not None:
            p = decoder(z, ys, zt)
        else:
            w, b = M.ridge(z, ys, alpha)
            p = zt @ w + b
        parts = np.split(p, np.cumsum([len(g) for _, g in held])[:-1])
        return [{"trial": t} | _score(_matrix(g["y"]), part) for (t, g), part in zip(held, parts, strict=True)]

    return per_group(_deal(rows, keys, folds, seed), [*keys, "fold"], fit, DECODED)


def shuffle_alignment(rows: DataFrame, column: str, seed: int = 0, keys: Sequence[str] = ("session", "trial"), order: str = "bin") -> DataFrame:
    """Roll ``column`` within each trial by an offset from a hash; bins are numbered from 0 without gaps."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    shift = F.pmod(F.xxhash64(F.lit(seed), *keys), F.greatest(F.col("_n") - 1, F.lit(1))) + 1
    f = rows.withColumn("_n", n)
    moved = f.select(*keys, ((F.col(order) + shift) % F.col("_n")).cast("int").alias(order), F.col(column).alias(column))
    return rows.drop(column).join(moved, [*keys, order])


def standardize_blocks(rows: DataFrame, blocks: dict[str, Sequence[str]], keys: Sequence[str] = ("session",), weight: bool = True) -> DataFrame:
    """z-score of each column, over the root of its block's size."""
    w = Window.partitionBy(*keys)
    z = lambda c, m: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)), F.lit(0.0)) / (len(m) ** 0.5 if weight else 1.0)
    return rows.withColumns({c: z(c, members) for members in blocks.values() for c in members})


def whiten_block(rows: DataFrame, keys: Sequence[str] = ("session",), column: str = "x", order: str = "bin") -> DataFrame:
    def fit(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values(order)
        return [{order: int(b), "white": v.tolist()} for b, v in zip(pdf[order], M.whiten(_matrix(pdf[column])), strict=True)]

    return per_group(rows, keys, fit, f"{order} long, white array<double>")


def point_features(signals: DataFrame, events: DataFrame, keys: Sequence[str] = ("session", "trial")) -> DataFrame:
    """Channels of each trial at its event time ``t``, z-scored over the trials of a session."""
    grid = events.select(*keys, "t").join(signals.select(*keys, "channel").distinct(), list(keys))
    at = W.interpolate(grid, signals, [*keys, "channel"])
    w = Window.partitionBy(*keys[:-1], "channel")
    return at.withColumn("z", F.coalesce(F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_pop("value").over(w)), F.lit(0.0)))


def spike_point_features(spikes: DataFrame, events: DataFrame, width: float = 0.2, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Spike counts in [t - width / 2, t + width / 2) around each trial's event, z-scored, with zeros."""
    from motorspark.operators.pairing import spikes_in_windows

    w = events.select(*keys, "trial", (F.col("t") - width / 2).alias("start"), (F.col("t") + width / 2).alias("stop"))
    # The window is half-open: a spike at its start counts.
    opened = w.withColumn("start", F.col("start") - 1e-9)
    n = spikes_in_windows(spikes, opened, keys, relative=False).groupBy(*keys, "unit_id", "trial").agg(F.count(F.lit(1)).alias("n"))
    spine = w.select(*keys, "trial").join(spikes.select(*keys, "unit_id").distinct(), list(keys))
    f = spine.join(n, [*keys, "unit_id", "trial"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    u = Window.partitionBy(*keys, "unit_id")
    return f.withColumn("z", F.coalesce(F.try_divide(F.col("n") - F.avg("n").over(u), F.stddev_pop("n").over(u)), F.lit(0.0)))


def depth_activity(rates: DataFrame, units: DataFrame, bins: int = 200, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Mean rate per depth bin and time bin, each depth over its own maximum."""
    from motorspark.operators.aggregates import normalize_rows_to_max

    f = rates.join(units.select(*keys, "unit_id", "depth"), [*keys, "unit_id"]).where("depth IS NOT NULL")
    w = Window.partitionBy(*keys)
    lo, hi = F.min("depth").over(w), F.max("depth").over(w)
    f = f.withColumns({"_lo": lo, "_hi": hi})
    place = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.width_bucket("depth", "_lo", "_hi", F.lit(bins)), F.lit(bins)) - 1).cast("int")
    m = f.groupBy(*keys, place.alias("depth_bin"), "bin").agg(F.avg("rate").alias("rate"))
    return normalize_rows_to_max(m, [*keys, "depth_bin"], "rate")


def result_json(row: dict, places: int = 4) -> str:
    """A result as JSON: numbers rounded, NaN as null."""

    def tidy(v: object) -> object:
        if isinstance(v, float):
            return None if v != v else round(v, places)
        if isinstance(v, dict):
            return {k: tidy(x) for k, x in v.items()}
        return [tidy(x) for x in v] if isinstance(v, (list, tuple)) else v

    return json.dumps(tidy(row))
