"""Neural activity against behaviour: three methods, both directions, nulls and effect sizes, for any number of designs.

A design is one comparison of one session: rows of (keys, trial, bin) with the
rates ``x``, the behaviour ``y`` and ``blocks``, the sizes of the behaviour's
blocks. How the columns are laid out is data, so designs of any widths go
through one plan.

Samples are packed into pieces of PIECE bins. Fits see sums of products over
pieces, never samples: reduced-rank regression and canonical correlations from
the sums of each fold, dynamics from the sums of delay-embedded rows, for
which a piece takes the last bins of the one before it. Nulls change the
behaviour and keep the rates: a draw moves the behaviour of one design, and
each piece of its rates gives the sums of the draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorspark.functions import models as M
from motorspark.functions import spaces as S
from motorspark.operators import series as W
from motorspark.operators.models import _keys_ddl, _spread, per_group, seed_of
from motorspark.operators.predicates import crop_to_period
from motorspark.sources.scratch import stored

#: The comparisons, their behaviour blocks in order, and the period they are made on.
COMPARISONS = {
    "joint_angles": (("joint_angles",), "active_movement"),
    "joint_angles_segment_forces": (("joint_angles", "segment_forces"), "active_movement"),
    "joint_angles_torques": (("joint_angles", "torques"), "active_movement"),
}
#: The surrogate that is each method's null.
DEFAULT_NULL = {"rrr": "circular_shift", "cca": "circular_shift", "dsa": "phase_randomize"}
SURROGATES = ("time_shuffle", "circular_shift", "phase_randomize", "trial_shuffle")
METHODS = ("rrr", "cca", "dsa")
KEYS = ("session", "comparison")
#: Bins in a piece; draws that one task makes one after the other.
PIECE, DRAWS = 8192, 25
#: Numbers that a task permutes in all its draws, as long as one draw is less.
PERMUTED = 1 << 22


def comparison_designs(rates: DataFrame, signals: DataFrame, comparisons: dict[str, tuple[Sequence[str], str]] = COMPARISONS, timepoints: DataFrame | None = None, keys: Sequence[str] = ("session",), trial: str = "trial") -> DataFrame:
    """Designs of every comparison: keys, comparison, trial, bin, ``x``, ``y`` and ``blocks``.

    ``rates`` has keys, trial, unit_id, t, rate; ``signals`` has keys, trial,
    signal, channel, t, value. A trial takes part in a comparison whose
    signals it has all. Channels are interpolated at the bins in the range
    that they share, and bins are cropped to the comparison's period where
    ``timepoints`` are given. A block's channels are in name order, the blocks
    in the comparison's. A session whose trials differ in channels keeps those
    with its widest layout.
    """
    spark, own = rates.sparkSession, [*keys, trial]
    wanted = spark.createDataFrame([(c, i, s, len(signals_)) for c, (signals_, _) in comparisons.items() for i, s in enumerate(signals_)], "comparison string, block int, signal string, _blocks int")
    # A channel's value at a bin is the same in every comparison: samples are never copied for comparisons, only channels and bins are.
    samples = signals.where(F.col("signal").isin(sorted({s for signals_, _ in comparisons.values() for s in signals_})))
    ranges = samples.groupBy(*own, "signal", "channel").agg(F.min("t").alias("a"), F.max("t").alias("b")).join(F.broadcast(wanted), "signal")
    named = F.struct("signal", "channel", F.concat_ws(".", F.lpad("block", 4, "0"), "channel").alias("_name"))
    span = ranges.groupBy(*own, "comparison").agg(F.max("a").alias("_a"), F.min("b").alias("_b"), F.count_distinct("block").alias("_has"), F.first("_blocks").alias("_blocks"), F.collect_list(named).alias("_channels")).where("_has = _blocks")
    grid = rates.select(*own, "t").distinct().join(span.drop("_has", "_blocks"), own).where("t >= _a AND t <= _b").drop("_a", "_b")
    if timepoints is not None:
        parts = [crop_to_period(grid.where(F.col("comparison").isin([c for c, (_, p) in comparisons.items() if p == period])), timepoints, period, own) for period in dict.fromkeys(p for _, p in comparisons.values())]
        grid = parts[0]
        for part in parts[1:]:
            grid = grid.unionByName(part)
    points = grid.select(*own, "comparison", "t", F.inline("_channels"))
    at = W.interpolate(points, samples.select(*own, "signal", "channel", "t", "value"), [*own, "signal", "channel"])
    y = at.groupBy(*own, "comparison", "t").agg(F.array_sort(F.collect_list(F.struct(F.col("_name").alias("channel"), "value"))).alias("_y"))
    sizes = F.transform(F.array_distinct(F.transform("_y", lambda c: F.left(c["channel"], F.lit(4)))), lambda b: F.size(F.filter("_y", lambda c: F.left(c["channel"], F.lit(4)) == b)))
    x = rates.groupBy(*own, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("unit_id").cast("string"), "rate"))), lambda u: u["rate"]).alias("x"))
    rows = y.select(*own, "comparison", "t", F.transform("_y", lambda c: c["value"]).alias("y"), sizes.alias("blocks")).join(x, [*own, "t"])
    rows = rows.withColumn("_layout", F.struct(F.size("y"), F.size("x"), "blocks"))
    widest = rows.groupBy(*keys, "comparison").agg(F.max("_layout").alias("_widest"))
    rows = rows.join(widest, [*keys, "comparison"]).where("_layout = _widest")
    return rows.select(*keys, "comparison", trial, F.col("t").alias("bin"), "x", "y", "blocks")


def numbered(designs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``designs`` with ``trial_no`` and ``idx``, the places of trial and row in the order of trial and bin, from 0; no task sorts a design."""
    lengths = designs.groupBy(*keys, "trial").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("trial")  # one row a trial
    starts = lengths.select(*keys, "trial", (F.row_number().over(w) - 1).alias("trial_no"), (F.sum("_n").over(w) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "trial").orderBy("bin")) - 1
    return designs.withColumn("_in", inside).join(starts, [*keys, "trial"]).withColumn("idx", F.col("_start") + F.col("_in")).drop("_start", "_in")


def pieces(designs: DataFrame, keys: Sequence[str] = KEYS, folds: int = 5, seed: int = 0, whole_trials: bool = False, piece: int = PIECE) -> DataFrame:
    """One row for ``piece`` bins of a design: keys, piece, p, q, blocks, and x, y, fold and trial of its bins as bytes.

    Folds are dealt by a hash of trial and bin, or of the trial alone. Rows
    with a missing or non-finite value take no part.
    """
    good = lambda c: ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = numbered(designs.where(F.col("x").isNotNull() & F.col("y").isNotNull() & good("x") & good("y")), keys)
    fold = F.pmod(F.xxhash64(F.lit(seed), *keys, "trial", *([] if whole_trials else ["bin"])), F.lit(folds)).cast("byte")
    rows = rows.select(*keys, F.floor(F.col("idx") / piece).alias("piece"), "idx", F.col("trial_no").cast("int").alias("trial_no"), fold.alias("fold"), "x", "y", "blocks")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x, y = np.array(pdf["x"].tolist(), float), np.array(pdf["y"].tolist(), float)
        one = {k: pdf[k].iloc[0] for k in [*keys, "piece"]}
        one |= {"n": len(pdf), "p": x.shape[1], "q": y.shape[1], "blocks": pdf["blocks"].iloc[0]}
        one |= {"x": x.tobytes(), "y": y.tobytes(), "fold": pdf["fold"].to_numpy(np.int8).tobytes(), "trials": pdf["trial_no"].to_numpy(np.int32).tobytes()}
        return pd.DataFrame([one])

    schema = f"{_keys_ddl(designs, keys)}, piece long, n int, p int, q int, blocks array<int>, x binary, y binary, fold binary, trials binary"
    return rows.groupBy(*keys, "piece").applyInPandas(pack, schema)


def _xy(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r["x"]).reshape(r["n"], r["p"]), np.frombuffer(r["y"]).reshape(r["n"], r["q"]), np.frombuffer(r["fold"], np.int8)


def _summed(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``g``: the element-wise sums of the arrays ``part`` of each key, which Spark adds up before and after its shuffle."""
    each = parts.select(*keys, F.posexplode("part").alias("_at", "_v")).groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("g"))


def moments(packed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, fold, p, q, blocks and ``g``: the upper triangle of the sums of products of ``[1, x, y]`` over the fold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x, y, fold = _xy(r)
                own = {k: r[k] for k in (*keys, "p", "q", "blocks")}
                g = S.fold_sums(x, y, fold, int(fold.max()) + 1)
                yield pd.DataFrame([own | {"fold": f, "part": S.triangle(g[f])} for f in range(len(g)) if g[f][0, 0] > 0])

    parts = packed.mapInPandas(run, f"{_keys_ddl(packed, keys)}, p int, q int, blocks array<int>, fold int, part array<double>")
    return _summed(parts, [*keys, "fold", "p", "q", "blocks"])


def _folds(pdf: pd.DataFrame) -> tuple[np.ndarray, int, list[int]]:
    g = np.stack([S.square(np.asarray(v, float)) for v in pdf.sort_values("fold")["g"]])
    return g, int(pdf["p"].iloc[0]), [int(b) for b in pdf["blocks"].iloc[0]]


def _null(v: float) -> float | None:
    return float(v) if np.isfinite(v) else None


def _directions(g: np.ndarray, p: int, blocks: list[int]) -> list[tuple[str, np.ndarray, int, list[int]]]:
    return [("x_to_y", g, p, blocks), ("y_to_x", *S.turned(g, p), [p])]


def rrr_curve(sums: DataFrame, keys: Sequence[str] = KEYS, ranks: Sequence[int] | None = None, alpha: float = 1.0, **preparation: object) -> DataFrame:
    """Held-out R2 of each rank in both directions, from ``moments``; ``selected`` marks the best rank."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        g, p, blocks = _folds(pdf)
        by, p, blocks = S.preparation(g, p, blocks, **preparation)
        out = []
        for name, own, k, _ in _directions(S.prepared(g, by), p, blocks):
            found = S.rrr_cv(own, k, list(ranks) if ranks else None, alpha)
            out += [{"direction": name, "rank": r, "r2": _null(v), "selected": r == found["rank"]} for r, v in zip(found["ranks"], found["r2"], strict=True)]
        return out

    return per_group(sums, keys, fit, "direction string, rank int, r2 double, selected boolean")


def rrr_targets(sums: DataFrame, keys: Sequence[str] = KEYS, ranks: Sequence[int] | None = None, alpha: float = 1.0, **preparation: object) -> DataFrame:
    """Held-out R2 of every target column at the selected rank, and its block's mean, in both directions."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        g, p, blocks = _folds(pdf)
        by, p, blocks = S.preparation(g, p, blocks, **preparation)
        out = []
        for name, own, k, sizes in _directions(S.prepared(g, by), p, blocks):
            targets = S.rrr_cv(own, k, list(ranks) if ranks else None, alpha)["targets"]
            edges = np.cumsum([0, *sizes])
            for b, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
                mean = S.mean_of_folds(targets[i:j, None])[0]
                out += [{"direction": name, "block": b, "target": int(c), "r2": _null(targets[c]), "block_r2": _null(mean)} for c in range(i, j)]
        return out

    return per_group(sums, keys, fit, "direction string, block int, target int, r2 double, block_r2 double")


def cca_loadings(sums: DataFrame, keys: Sequence[str] = KEYS, alpha_x: float = 1.0, alpha_y: float = 1.0, components: int | None = None, **preparation: object) -> DataFrame:
    """Structure correlations: each channel of a side with each canonical variate of that side, fitted on all rows."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        g, p, blocks = _folds(pdf)
        by, p, _ = S.preparation(g, p, blocks, **preparation)
        total = S.prepared(g, by).sum(0)
        _, a, b = S.cca_fit(total, p, alpha_x, alpha_y, components)
        return [{"side": s, "channel": i, "component": j, "loading": _null(v[i, j])} for s, v in zip("xy", S.loadings(total, p, a, b), strict=True) for i in range(v.shape[0]) for j in range(v.shape[1])]

    return per_group(sums, keys, fit, "side string, channel int, component int, loading double")


def cca_components(packed: DataFrame, sums: DataFrame, keys: Sequence[str] = KEYS, alpha_x: float = 1.0, alpha_y: float = 1.0, components: int | None = None, permutations: int = 100, percentile: float = 95.0, seed: int = 0, **preparation: object) -> DataFrame:
    """Canonical correlations of each component: in sample, held out, and whether the latter is beyond the threshold.

    Rows are paired anew within their held-out fold, ``permutations`` times.
    The threshold is the percentile of the absolute mean correlations over
    permutations and components. A task gets the variates of one fold (two
    numbers a row and component), never the channels. A design's draws are
    dealt by its size, so that many small designs are no more groups than
    they have folds; a draw doesn't depend on the task that makes it.
    """

    def fit(pdf: pd.DataFrame) -> list[dict]:
        g, p, blocks = _folds(pdf)
        most = float(g[:, 0, 0].max())
        by, p, _ = S.preparation(g, p, blocks, **preparation)
        g = S.prepared(g, by)
        folds = S.cca_folds(g, p, alpha_x, alpha_y, components)
        inside = S.cca_fit(g.sum(0), p, alpha_x, alpha_y, components)[0]
        number = sorted(pdf["fold"])
        k = len(inside)
        lanes = max(1, min(permutations, int(np.ceil(most * k * permutations / PERMUTED))))
        # Weights on the raw columns; constants don't matter to a correlation.
        width = int(pdf["p"].iloc[0])
        raw = [(by[1 : 1 + width, 1 : 1 + p] @ a, by[1 + width :, 1 + p :] @ b) for a, b, _ in folds]
        return [{"fold": int(f), "k": k, "lanes": lanes, "a": a.tobytes(), "b": b.tobytes(), "held": [_null(v) for v in r], "inside": inside.tolist()} for f, (a, b), (_, _, r) in zip(number, raw, folds, strict=True)]

    fits = stored(per_group(sums, keys, fit, "fold int, k int, lanes int, a binary, b binary, held array<double>, inside array<double>"), "cca-folds")
    weights = fits.groupBy(*keys).agg(F.collect_list(F.struct("fold", "k", "lanes", "a", "b")).alias("fits"))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x, y, fold = _xy(r)
                for f in r["fits"]:
                    at = fold == f["fold"]
                    if at.any():
                        a, b = (np.frombuffer(f[c]).reshape(-1, f["k"]) for c in "ab")
                        yield pd.DataFrame([{k: r[k] for k in keys} | {"piece": r["piece"], "fold": f["fold"], "k": f["k"], "lanes": f["lanes"], "u": (a.T @ x[at].T).tobytes(), "v": (b.T @ y[at].T).tobytes()}])

    variates = packed.join(weights, list(keys)).mapInPandas(project, f"{_keys_ddl(packed, keys)}, piece long, fold int, k int, lanes int, u binary, v binary")
    lanes = variates.withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))

    def permute(pdf: pd.DataFrame) -> list[dict]:
        pdf = pdf.sort_values("piece")
        k, n, lane, fold = (int(pdf[c].iloc[0]) for c in ("k", "lanes", "lane", "fold"))
        u, v = (np.concatenate([np.frombuffer(b).reshape(k, -1) for b in pdf[c]], 1) for c in "uv")
        u, v = ((z - z.mean(1, keepdims=True)) for z in (u, v))
        norm = np.sqrt((u * u).sum(1) * (v * v).sum(1))
        out = []
        for draw in range(lane * permutations // n, (lane + 1) * permutations // n):
            mixed = np.random.default_rng(seed_of(seed, draw, fold)).permutation(v.shape[1])
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(norm > 1e-12, (u * v[:, mixed]).sum(1) / norm, np.nan)
            out += map(_null, r)
        return [{"r": out}]

    # A row holds all draws and components of a fold and lane; folds meet by their places in it.
    chance = per_group(lanes, [*keys, "fold", "lane"], permute, "r array<double>")
    chance = chance.groupBy(*keys, "lane").agg(F.array_sort(F.collect_list(F.struct("fold", "r"))).alias("_f"))
    at = lambda i: F.filter(F.transform("_f", lambda f: F.get(f["r"], i)), lambda v: v.isNotNull())
    mean = lambda i: F.abs(F.try_divide(F.aggregate(at(i), F.lit(0.0), lambda a, v: a + v), F.size(at(i))))
    chance = chance.select(*keys, F.explode(F.transform(F.get("_f", F.lit(0))["r"], lambda _, i: mean(i))).alias("_r"))
    chance = chance.groupBy(*keys).agg(F.percentile("_r", F.lit(percentile / 100)).alias("threshold"))
    each = fits.select(*keys, "fold", F.posexplode(F.arrays_zip("held", "inside")).alias("component", "_c"))
    found = each.groupBy(*keys, "component").agg(F.first("_c.inside").alias("correlation"), F.avg("_c.held").alias("cv_correlation"))
    return found.join(chance, list(keys), "left").withColumn("significant", F.coalesce(F.abs("cv_correlation") > F.col("threshold"), F.lit(False)))


def _applied(by: np.ndarray, p: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prepared columns of raw rows."""
    k, d = x.shape[1], by.shape[1]
    return x @ by[1 : 1 + k, 1 : 1 + p] + by[0, 1 : 1 + p], y @ by[1 + k :, 1 + p : d] + by[0, 1 + p : d]


def _preparations(sums: DataFrame, keys: Sequence[str], alpha: float, **preparation: object) -> DataFrame:
    """For each design the preparing map, the prepared sums, and the selected ranks of both directions."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        g, p, blocks = _folds(pdf)
        by, p, blocks = S.preparation(g, p, blocks, **preparation)
        g = S.prepared(g, by)
        ranks = [S.rrr_cv(own, k, None, alpha)["rank"] for _, own, k, _ in _directions(g, p, blocks)]
        return [{"by": by.tobytes(), "d": by.shape[1], "pp": p, "sums": g.tobytes(), "numbers": sorted(map(int, pdf["fold"])), "ranks": ranks}]

    return per_group(sums, keys, fit, "by binary, d int, pp int, sums binary, numbers array<int>, ranks array<int>")


def transitions(packed: DataFrame, prepared: DataFrame, keys: Sequence[str] = KEYS, delays: int = 10, delay: int = 1) -> DataFrame:
    """keys, side (x or y), k and ``g``: the sums of products of delay-embedded rows (upper triangle), then those with their next rows.

    A piece takes the last bins of the one before it, so a design of any
    length is many tasks. The whole record is one series, as its trials stand.
    """
    need = (delays - 1) * delay + 1
    # Of the bytes of a piece those of its last bins.
    last = lambda c, k: F.expr(f"substring({c}, greatest(length({c}) - {need} * {k} * 8, 0) + 1)")
    tails = packed.select(*keys, (F.col("piece") + 1).alias("piece"), last("x", "p").alias("tail_x"), last("y", "q").alias("tail_y"))
    rows = packed.join(tails, [*keys, "piece"], "left").join(prepared.select(*keys, "by", "d", "pp"), list(keys))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x, y, _ = _xy(r)
                if r["tail_x"] is not None:
                    x = np.concatenate((np.frombuffer(r["tail_x"]).reshape(-1, r["p"]), x))
                    y = np.concatenate((np.frombuffer(r["tail_y"]).reshape(-1, r["q"]), y))
                if len(x) <= need:
                    continue
                for side, z in zip("xy", _applied(np.frombuffer(r["by"]).reshape(-1, r["d"]), r["pp"], x, y), strict=True):
                    now, after = S.transition_sums(z, delays, delay)
                    yield pd.DataFrame([{k: r[k] for k in keys} | {"side": side, "k": z.shape[1] * delays, "part": np.concatenate((S.triangle(now), after.reshape(-1)))}])

    parts = rows.mapInPandas(run, f"{_keys_ddl(packed, keys)}, side string, k int, part array<double>")
    return _summed(parts, [*keys, "side", "k"])


def operators(sums: DataFrame, keys: Sequence[str] = KEYS, rank: int = 10) -> DataFrame:
    """The reduced linear operators ``a_x`` and ``a_y`` of each design, of equal rank, and their distance ``dsa``; from ``transitions``."""

    def fit(pdf: pd.DataFrame) -> list[dict]:
        if len(pdf) < 2:
            return []
        r, found = min(rank, *map(int, pdf["k"])), {}
        for _, row in pdf.iterrows():
            k, g = int(row["k"]), np.asarray(row["g"], float)
            half = k * (k + 1) // 2
            found[row["side"]] = S.operator_from_sums(S.square(g[:half]), g[half:].reshape(k, k), r)
        return [{"rank": r, "a_x": found["x"].tobytes(), "a_y": found["y"].tobytes(), "dsa": S.field_distance(found["x"], found["y"])}]

    return per_group(sums, keys, fit, "rank int, a_x binary, a_y binary, dsa double")


def _headlines(g: np.ndarray, p: int, ranks: Sequence[int], methods: Sequence[str], alpha: float, alpha_x: float, alpha_y: float) -> dict[tuple[str, str], float]:
    """Headline numbers from prepared sums."""
    out = {}
    if "rrr" in methods:
        one, two = S.rrr_cv(g, p, [ranks[0]], alpha)["best"], S.rrr_cv(*S.turned(g, p), [ranks[1]], alpha)["best"]
        out |= {("rrr", "x_to_y"): one, ("rrr", "y_to_x"): two, ("rrr", "symmetric"): (one + two) / 2}
    if "cca" in methods:
        out["cca", "both"] = float(S.cca_cv(g, p, alpha_x, alpha_y)[0])
    return out


HEADLINE = "method string, direction string, value double"


def compare_behaviour(
    designs: DataFrame, methods: Sequence[str] = METHODS, null: str | Sequence[str] = "auto", n_null: int = 200, keys: Sequence[str] = KEYS, folds: int = 5, seed: int = 0, alpha: float = 1.0, alpha_x: float = 1.0,
    alpha_y: float = 1.0, delays: int = 10, delay: int = 1, rank: int = 10, piece: int = PIECE, whole_trials: bool = False, **preparation: object,
) -> tuple[DataFrame, DataFrame]:
    """Observed similarity with its effect size, and the null it is held against, of every design, method and direction.

    The first table: keys, method, direction (x_to_y, y_to_x, symmetric; else
    both), value, rank, and for each surrogate the null's mean and deviation,
    z, robust z, percentile, p and n. z is positive where the observed spaces
    are more alike than those of the null, also for the distance of dynamics.
    The second table has each draw. ``null`` is "auto" (each method's own),
    "all", or names of surrogates. A design of fewer bins than the delays
    need has no dynamics; NaN headlines are null and count in no null.
    """
    packed = stored(pieces(designs, keys, folds, seed, whole_trials, piece), "alignment-pieces")
    sums = stored(moments(packed, keys), "alignment-moments")
    fits = stored(_preparations(sums, keys, alpha, **preparation), "alignment-preparations")
    linear = [m for m in methods if m != "dsa"]

    def observed(pdf: pd.DataFrame) -> list[dict]:
        r = pdf.iloc[0]
        g = np.frombuffer(r["sums"]).reshape(-1, r["d"], r["d"])
        at = {"x_to_y": int(r["ranks"][0]), "y_to_x": int(r["ranks"][1])}
        return [{"method": m, "direction": d, "value": _null(v), "rank": at.get(d)} for (m, d), v in _headlines(g, int(r["pp"]), r["ranks"], linear, alpha, alpha_x, alpha_y).items()]

    found = per_group(fits, keys, observed, f"{HEADLINE}, rank int")
    if "dsa" in methods:
        dynamics = stored(operators(transitions(packed, fits, keys, delays, delay), keys, rank), "alignment-operators")
        found = found.unionByName(dynamics.select(*keys, F.lit("dsa").alias("method"), F.lit("both").alias("direction"), F.col("dsa").alias("value"), "rank"))
        fits = fits.join(dynamics.select(*keys, F.col("rank").alias("r"), "a_x"), list(keys), "left")
    else:
        fits = fits.select("*", F.lit(0).alias("r"), F.lit(None).cast("binary").alias("a_x"))
    found = stored(found, "alignment-observed")

    names = {m: SURROGATES if null == "all" else (DEFAULT_NULL[m],) if null == "auto" else (null,) if isinstance(null, str) else tuple(null) for m in methods}
    by_surrogate = {s: [m for m in methods if s in names[m]] for s in SURROGATES}
    kinds = [s for s in SURROGATES if by_surrogate[s]]
    whole = packed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "n", "y", "fold", "trials"))).alias("all"))
    # A lane is a block of draws of one surrogate, against one piece of the rates.
    lanes = packed.select(*keys, "piece", "n", "p", "q", "x").join(whole, list(keys)).join(fits, list(keys))
    lanes = lanes.withColumn("surrogate", F.explode(F.array(*map(F.lit, kinds)))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(-(-n_null // DRAWS) - 1))))
    lanes = _spread(lanes, [*keys, "surrogate", "lane", "piece"])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                y = np.concatenate([np.frombuffer(v["y"]).reshape(v["n"], r["q"]) for v in r["all"]])
                fold = np.concatenate([np.frombuffer(v["fold"], np.int8) for v in r["all"]])
                trial = np.concatenate([np.frombuffer(v["trials"], np.int32) for v in r["all"]])
                start = sum(v["n"] for v in r["all"] if v["piece"] < r["piece"])
                own, by, p = slice(start, start + r["n"]), np.frombuffer(r["by"]).reshape(-1, r["d"]), r["pp"]
                x, y = _applied(by, p, np.frombuffer(r["x"]).reshape(r["n"], r["p"]), y)
                x = np.concatenate((np.ones((len(x), 1)), x), 1)
                alone = "dsa" in by_surrogate[r["surrogate"]] and r["piece"] == 0 and r["a_x"] is not None and len(y) > (delays - 1) * delay + 1
                parts, fields = [], []
                for i in range(r["lane"] * DRAWS, min((r["lane"] + 1) * DRAWS, n_null)):
                    rng = np.random.default_rng(seed_of(seed, r["surrogate"], i, *(r[k] for k in keys)))
                    mixed = S.surrogate(y, r["surrogate"], rng, trial)
                    part = np.concatenate((x, mixed[own]), 1)
                    parts.append(np.stack([part[fold[own] == f].T @ mixed[own][fold[own] == f] for f in r["numbers"]]))
                    if alone:
                        fields.append(S.operator_from_sums(*S.transition_sums(mixed, delays, delay), int(r["r"])))
                dsa = S.field_distances(np.frombuffer(r["a_x"]).reshape(fields[0].shape), np.stack(fields)) if alone else np.full(len(parts), np.nan)
                yield pd.DataFrame([{k: r[k] for k in (*keys, "surrogate", "lane", "piece")} | {"parts": np.stack(parts).tobytes(), "dsa": dsa}])

    drawn = lanes.mapInPandas(draw, f"{_keys_ddl(packed, keys)}, surrogate string, lane int, piece long, parts binary, dsa array<double>")
    drawn = drawn.join(fits.select(*keys, "d", "pp", "sums", "ranks"), list(keys))

    def headlines(pdf: pd.DataFrame) -> list[dict]:
        r = pdf.iloc[0]
        g, p, out = np.frombuffer(r["sums"]).reshape(-1, r["d"], r["d"]), int(r["pp"]), []
        parts = np.sum([np.frombuffer(b).reshape(-1, len(g), r["d"], r["d"] - 1 - p) for b in pdf["parts"]], 0)
        dsa = np.nansum(np.stack([np.asarray(v, float) for v in pdf["dsa"]]), 0) if any(np.isfinite(np.asarray(v, float)).any() for v in pdf["dsa"]) else np.full(len(parts), np.nan)
        todo = by_surrogate[r["surrogate"]]
        for i, part in enumerate(parts):
            own = g.copy()
            own[:, :, 1 + p :], own[:, 1 + p :, :] = part, part.transpose(0, 2, 1)
            values = _headlines(own, p, r["ranks"], [m for m in todo if m != "dsa"], alpha, alpha_x, alpha_y)
            values |= {("dsa", "both"): dsa[i]} if "dsa" in todo else {}
            out += [{"draw": int(r["lane"]) * DRAWS + i, "method": m, "direction": d, "value": _null(v)} for (m, d), v in values.items()]
        return out

    nulls = stored(per_group(drawn, [*keys, "surrogate", "lane"], headlines, f"draw int, {HEADLINE}").drop("lane"), "alignment-nulls")
    return effect_sizes(found, nulls, [*keys, "method", "direction"]), nulls


def effect_sizes(found: DataFrame, nulls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``found`` with what its null says for each surrogate; for a distance (dsa) less is more alike."""
    each = nulls.where("value IS NOT NULL").select(*keys, "surrogate", F.col("value").alias("_v"))
    middle = each.groupBy(*keys, "surrogate").agg(F.median("_v").alias("_med"))
    f = each.join(middle, [*keys, "surrogate"]).join(found.select(*keys, F.col("value").alias("_o")), list(keys))
    sign = F.when(F.col("method") == "dsa", -1.0).otherwise(1.0)
    beyond = F.count_if((F.col("_v") - F.col("_o")) * sign >= 0)
    out = f.groupBy(*keys, "surrogate", "_o", "_med").agg(
        F.avg("_v").alias("null_mean"), F.stddev_pop("_v").alias("null_std"), F.median(F.abs(F.col("_v") - F.col("_med"))).alias("_mad"),
        (F.count_if(F.col("_v") <= F.col("_o")) * 100.0 / F.count(F.lit(1))).alias("percentile"), ((beyond + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p"), F.count(F.lit(1)).alias("n"),
    )
    z = F.try_divide(F.col("_o") - F.col("null_mean"), F.col("null_std")) * sign
    robust = F.try_divide(F.col("_o") - F.col("_med"), F.col("_mad") * 1.4826) * sign
    out = out.select(*keys, "surrogate", "null_mean", "null_std", z.alias("z"), robust.alias("robust_z"), "percentile", "p", "n")
    return found.join(out, list(keys), "left")


def headline_null(designs: DataFrame, headline: Callable[[np.ndarray, np.ndarray], float], n: int, surrogates: Sequence[str] = SURROGATES, keys: Sequence[str] = KEYS, seed: int = 0, piece: int = PIECE) -> DataFrame:
    """A headline of one's own, ``headline(x, y)`` on standardised columns: observed (surrogate null, draw null) and on surrogates of y.

    Such a function needs the samples, so a task holds a design; its draws are
    dealt in blocks of DRAWS.
    """
    packed = pieces(designs, keys, 5, seed, False, piece)
    whole = packed.groupBy(*keys).agg(F.first("p").alias("p"), F.first("q").alias("q"), F.array_sort(F.collect_list(F.struct("piece", "n", "x", "y", "trials"))).alias("all"))
    kinds = F.array(F.lit(None).cast("string"), *map(F.lit, surrogates))
    lanes = whole.withColumn("surrogate", F.explode(kinds)).withColumn("lane", F.explode(F.when(F.col("surrogate").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(-(-n // DRAWS) - 1)))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x, y = (np.concatenate([np.frombuffer(v[c]).reshape(v["n"], r[k]) for v in r["all"]]) for c, k in (("x", "p"), ("y", "q")))
                trial = np.concatenate([np.frombuffer(v["trials"], np.int32) for v in r["all"]])
                (x,), (y,) = M.standardise(x), M.standardise(y)
                own = {k: r[k] for k in keys} | {"surrogate": r["surrogate"]}
                if r["surrogate"] is None:
                    out = [own | {"draw": None, "value": _null(headline(x, y))}]
                else:
                    out = []
                    for i in range(r["lane"] * DRAWS, min((r["lane"] + 1) * DRAWS, n)):
                        rng = np.random.default_rng(seed_of(seed, r["surrogate"], i, *(r[k] for k in keys)))
                        out.append(own | {"draw": i, "value": _null(headline(x, S.surrogate(y, r["surrogate"], rng, trial)))})
                yield pd.DataFrame(out, columns=[*keys, "surrogate", "draw", "value"])

    return _spread(lanes, [*keys, "surrogate", "lane"]).mapInPandas(run, f"{_keys_ddl(designs, keys)}, surrogate string, draw int, value double")
