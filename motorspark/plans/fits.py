"""Queries that fit models on the driver's tables; most have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.functions import stats as X
from motorspark.operators import aggregates as A
from motorspark.operators import encoding as E
from motorspark.operators import models as M
from motorspark.operators import ordering as K
from motorspark.operators import predicates as P
from motorspark.operators import series as W
from motorspark.plans import views as V
from motorspark.plans.demo import BEFORE, CTE, HALF, SIG, TRIAL_COUNTS, WIDTH, _counts, _events, _rates, r
from motorspark.plans.registry import register
from motorspark.sources import tables as S
from motorspark.sources.results import ResultStore
from motorspark.sources.scratch import scratch, stored


def _activity(spark: SparkSession, d: str) -> DataFrame:
    return M.trial_activity(_counts(spark, d), WIDTH, 2.0).select("session", "unit_id", "trial", "condition", "bin", "value")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """session, trial, bin, x (smoothed rates of the units), y (summed rate, bin phase)."""
    a = _activity(spark, d)
    v = F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "value"))), lambda s: s["value"])
    full = a.groupBy("session", "trial", "bin").agg(v.alias("x"), F.sum("value").alias("_s"), F.count(F.lit(1)).alias("_n"))
    most = F.max("_n").over(Window.partitionBy("session"))
    full = full.withColumn("_most", most).where("_n = _most")
    return full.select("session", F.col("trial").cast("long").alias("trial"), F.col("bin").cast("long").alias("bin"), "x", F.array("_s", F.cos(F.col("bin") / 5.0)).alias("y"))


@register("gram", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(sum(l_quantity * l_quantity), 2) AS qq, round(sum(l_quantity * l_extendedprice), 0) AS qp FROM lineitem GROUP BY 1""")
def gram(spark, d):
    g = M.gram(V.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return g.select("l_returnflag", "n", F.round(g.sums[0], 2).alias("s"), F.round(g.products[0], 2).alias("qq"), F.round(g.products[1], 0).alias("qp"))


@register("pca")
def pca(spark, d):
    return M.pca(V.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3, ["l_returnflag"])


@register("pca_scores")
def pca_scores(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return M.pca_scores(li, columns, M.pca(li, columns, 2, ["l_returnflag"]), ["l_returnflag"])


@register("demixed_pca")
def demixed_pca(spark, d):
    peth = A.mean_and_sem(_rates(spark, d), ["session", "unit_id", "condition", "bin"])
    kept, _ = A.common_conditions(peth)
    return M.demixed_pca(A.marginal_means(peth.join(kept, ["session", "condition"], "left_semi")), 2)


@register("demixed_traces")
def demixed_traces(spark, d):
    peth = A.mean_and_sem(_rates(spark, d), ["session", "unit_id", "condition", "bin"])
    kept, _ = A.common_conditions(peth)
    peth = stored(peth.join(kept, ["session", "condition"], "left_semi"), "demixed-peth")
    return M.demixed_traces(peth, M.demixed_pca(A.marginal_means(peth), 2))


@register("trial_activity", CTE + f""", half(i, k) AS (VALUES {HALF})
SELECT a.session, a.unit_id, a.trial, a.condition, a.bin::INTEGER AS bin, round(sqrt(greatest(sum(b.n * k) / 60, 0)), 9) AS value FROM filled a, half
JOIN filled b ON b.session = a.session AND b.unit_id = a.unit_id AND b.trial = a.trial AND b.bin = a.bin - half.i GROUP BY ALL""")
def trial_activity(spark, d):
    return _activity(spark, d).withColumns(r("value", places=9))


@register("lda_through_time")
def lda_through_time(spark, d):
    return M.lda_through_time(_activity(spark, d))


def _design(spark: SparkSession, d: str) -> DataFrame:
    """All event types as channels of a day, at the bins of every trial in the range that the channels share."""
    rates = _rates(spark, d).select("session", "unit_id", (F.col("trial") * 3600.0 + 1500.0 + F.col("bin") * WIDTH - BEFORE).alias("t"), F.col("rate"))
    signal = V.spikes(spark, d).groupBy("session", F.col("unit_id").alias("channel"), "t").agg((F.max(F.col("t") % 100) / 100).alias("value")).withColumn("signal", F.lit("joint_angles"))
    design = M.design_matrix(rates, signal, "joint_angles", ("session",))
    return design.withColumn("trial", F.floor(F.col("t") / 3600).cast("int"))


@register("design_matrix", CTE + """, s AS (SELECT session, unit_id AS channel, t, max(t % 100) / 100 AS value FROM spikes GROUP BY ALL),
r AS (SELECT max(a) AS a, min(b) AS b, session FROM (SELECT session, channel, min(t) AS a, max(t) AS b FROM s GROUP BY ALL) GROUP BY session),
g AS (SELECT session, trial, trial * 3600.0 + 1500.0 + bin * 60.0 - 900.0 AS t, count(DISTINCT unit_id) AS units FROM rates GROUP BY ALL),
k AS (SELECT g.session, g.trial, g.t, units, channel FROM g JOIN r ON r.session = g.session AND g.t BETWEEN a AND b JOIN (SELECT DISTINCT session, channel FROM s) c ON c.session = g.session),
p AS (SELECT k.*, s.t AS x0, s.value AS y0 FROM k ASOF LEFT JOIN s ON s.session = k.session AND s.channel = k.channel AND s.t <= k.t),
q AS (SELECT p.*, s.t AS x1, s.value AS y1 FROM p ASOF LEFT JOIN s ON s.session = p.session AND s.channel = p.channel AND s.t >= p.t),
v AS (SELECT session, trial, t, units, channel, CASE WHEN x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END AS value FROM q)
SELECT session, trial::INTEGER AS trial, t::DOUBLE AS t, count(*)::INTEGER AS channels, round(arg_min(value, channel), 6) AS first, round(arg_max(value, channel), 6) AS last, round(sum(value), 6) AS total, units::INTEGER AS units FROM v GROUP BY ALL""")
def design_matrix(spark, d):
    x = F.col("x")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return _design(spark, d).select(
        "session", "trial", "t", F.size(x).alias("channels"), F.round(x[0], 6).alias("first"), F.round(F.element_at(x, -1), 6).alias("last"), F.round(total, 6).alias("total"), F.size("y").alias("units")
    )


@register("poisson_glm_cv")
def poisson_glm_cv(spark, d):
    return M.poisson_glm_cv(_design(spark, d))


@register("encode_at_mode_lag")
def encode_at_mode_lag(spark, d):
    design = _design(spark, d)
    modes = design.select("session").distinct().withColumn("mode_lag", F.day("session") % 3 - 1)
    return E.encode_at_lag(design, modes)


@register("lag_surrogate")
def lag_surrogate(spark, d):
    return E.lag_surrogate(_design(spark, d), range(-5, 6)).withColumns(r("r2"))


@register("optimal_lags")
def optimal_lags(spark, d):
    """Rates are a few events an hour here, so that no unit is too silent to be searched."""
    return E.optimal_lags(_design(spark, d), range(-5, 6), min_rate=0.0)


@register("run_encoding")
def run_encoding(spark, d):
    """Half of the sessions first, then all: what the first run stored is passed over."""
    design = _design(spark, d)
    stores = [ResultStore(spark, scratch(spark, name), schema) for name, schema in (("lags", E.LAGS), ("encodings", E.ENCODINGS))]
    E.run_encoding(design.where(F.day("session") % 2 == 0), range(-2, 3), *stores, min_rate=0.0)
    return E.run_encoding(design, range(-2, 3), *stores, min_rate=0.0)[1].drop("folds")


@register("classify_pooled")
def classify_pooled(spark, d):
    a = _activity(spark, d)
    units = a.select("session", "unit_id").distinct().withColumn("depth", F.length("unit_id").cast("double"))
    return M.classify_pooled(a, M.depth_groups(units, 0.4, 0.4))


@register("lag_sweep", SIG + """, s AS (SELECT session, channel AS unit_id, row_number() OVER w AS bin, value AS y, lag(value, 2) OVER w AS x FROM sig WINDOW w AS (PARTITION BY session, channel ORDER BY t)),
f AS (SELECT * FROM s WHERE x IS NOT NULL), j AS (SELECT a.session, a.unit_id, k AS lag, sqrt(a.y) AS y, b.x FROM f a, (SELECT unnest(range(-4, 5)) AS k) o JOIN f b ON b.session = a.session AND b.unit_id = a.unit_id AND b.bin = a.bin + o.k),
q AS (SELECT session, unit_id, lag, regr_r2(y, x) AS r2 FROM j GROUP BY ALL)
SELECT session, unit_id, lag::INTEGER AS best_lag, round(r2, 6) AS best_r2 FROM q WHERE r2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, unit_id ORDER BY r2 DESC, lag) = 1""")
def lag_sweep(spark, d):
    s = V.signals(spark, d)
    w = Window.partitionBy("session", "channel").orderBy("t")
    s = s.select("session", F.lit(0).alias("trial"), F.col("channel").alias("unit_id"), F.row_number().over(w).alias("bin"), F.col("value").alias("y"), F.lag("value", 2).over(w).alias("x")).where("x IS NOT NULL")
    return M.optimal_lag(M.lag_sweep(s, range(-5, 6), ["x"])).withColumns(r("best_r2"))


@register("kalman_decode_cv")
def kalman_decode_cv(spark, d):
    return M.kalman_decode_cv(_vectors(spark, d))


@register("wiener_decode_cv")
def wiener_decode_cv(spark, d):
    return M.wiener_decode_cv(_vectors(spark, d), lags=3)


@register("shuffle_alignment")
def shuffle_alignment(spark, d):
    return M.shuffle_alignment(_vectors(spark, d).drop("y"), "x")


@register("standardize_blocks", """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w / sqrt(2), 6) + 0 AS l_quantity,
round((l_discount - avg(l_discount) OVER w) / stddev_pop(l_discount) OVER w / sqrt(2), 6) + 0 AS l_discount FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)""")
def standardize_blocks(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount")
    return M.standardize_blocks(li, {"a": ["l_quantity", "l_discount"]}, ["l_suppkey"]).drop("l_suppkey").withColumns(r("l_quantity", "l_discount"))


@register("spike_point_features", CTE + """, c AS (SELECT e.session, u.unit_id, e.trial, count(s.t) AS n FROM events_at e JOIN (SELECT DISTINCT session, unit_id FROM spikes) u USING (session)
LEFT JOIN spikes s ON s.session = e.session AND s.unit_id = u.unit_id AND s.t >= tp - 300 AND s.t < tp + 300 GROUP BY ALL)
SELECT session, unit_id, trial, n, round(coalesce((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 0), 6) + 0 AS z FROM c WINDOW w AS (PARTITION BY session, unit_id)""")
def spike_point_features(spark, d):
    return M.spike_point_features(V.spikes(spark, d), _events(spark, d).select("session", "trial", F.col("tp").alias("t")), 600.0).select("session", "unit_id", "trial", "n", F.round("z", 6).alias("z"))


@register("point_features", SIG + """, s AS (SELECT *, floor(t / 86400) AS trial FROM sig), g AS (SELECT DISTINCT session, trial, channel, trial * 86400 + 43200 AS t FROM s),
a AS (SELECT g.*, s.t AS x0, s.value AS y0 FROM g ASOF LEFT JOIN s ON s.session = g.session AND s.trial = g.trial AND s.channel = g.channel AND s.t <= g.t),
b AS (SELECT a.*, s.t AS x1, s.value AS y1 FROM a ASOF LEFT JOIN s ON s.session = a.session AND s.trial = a.trial AND s.channel = a.channel AND s.t >= a.t),
v AS (SELECT session, trial::BIGINT AS trial, channel, t, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END AS value FROM b)
SELECT session, trial, channel, t, round(value, 6) AS value, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 5) + 0 AS z FROM v WINDOW w AS (PARTITION BY session, channel)""")
def point_features(spark, d):
    s = V.signals(spark, d).withColumn("trial", F.floor(F.col("t") / 86400.0))
    events = s.select("session", "trial").distinct().withColumn("t", F.col("trial") * 86400.0 + 43200.0)
    return M.point_features(s, events).select("session", "trial", "channel", "t", F.round("value", 6).alias("value"), (F.round("z", 5) + 0.0).alias("z"))


@register("depth_activity", CTE + """, a AS (SELECT session, unit_id, bin, avg(rate) AS rate FROM rates GROUP BY ALL),
p AS (SELECT *, length(unit_id) AS depth, min(length(unit_id)) OVER (PARTITION BY session) AS lo, max(length(unit_id)) OVER (PARTITION BY session) AS hi FROM a),
m AS (SELECT session, CASE WHEN lo = hi THEN 0 ELSE least(floor((depth - lo) * 5 / (hi - lo)), 4) END::INTEGER AS depth_bin, bin, avg(rate) AS rate FROM p GROUP BY ALL)
SELECT session, depth_bin, bin::INTEGER AS bin, round(rate, 9) AS rate, round(CASE WHEN max(rate) OVER w = 0 THEN 0 ELSE rate / max(rate) OVER w END, 6) AS normalised FROM m WINDOW w AS (PARTITION BY session, depth_bin)""")
def depth_activity(spark, d):
    rates = _rates(spark, d).groupBy("session", "unit_id", "bin").agg(F.avg("rate").alias("rate"))
    units = rates.select("session", "unit_id").distinct().withColumn("depth", F.length("unit_id").cast("double"))
    return M.depth_activity(rates, units, 5).withColumns(r("rate", places=9) | r("normalised"))


@register("modulated_units", TRIAL_COUNTS + """, v AS (SELECT session, unit_id, condition, n AS x FROM tc),
k AS (SELECT *, count(*) OVER (PARTITION BY session, unit_id, x) AS t, rank() OVER (PARTITION BY session, unit_id ORDER BY x) + (count(*) OVER (PARTITION BY session, unit_id, x) - 1) / 2.0 AS rk FROM v),
s AS (SELECT session, unit_id, condition, sum(rk) AS r, count(*) AS c, sum(t * t - 1.0) AS ties FROM k GROUP BY ALL), a AS (SELECT session, unit_id, sum(r * r / c) AS q, sum(c)::DOUBLE AS n, sum(ties) AS ties, count(*) AS groups FROM s GROUP BY ALL),
h AS (SELECT session, unit_id, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0) AS h, groups, n::BIGINT AS n FROM a), p AS (SELECT *, exp(-h / 2) AS p FROM h)
SELECT session, unit_id, round(h, 6) AS h, round(p, 6) AS p, groups, n, (row_number() OVER (PARTITION BY session ORDER BY round(p, 9), unit_id) - 1)::INTEGER AS position FROM p WHERE p < 0.2""")
def modulated_units(spark, d):
    rates = A.trial_counts(V.spikes(spark, d), V.trials(spark, d)).select("session", "unit_id", "trial", "condition", "rate")
    return K.modulated_units(rates, 0.2).withColumns(r("h", "p"))


@register("encoding_pair_tests")
def encoding_pair_tests(spark, d):
    rates = A.trial_counts(V.spikes(spark, d), V.trials(spark, d))
    scores = rates.groupBy("session", "unit_id", F.concat(F.lit("c"), F.col("condition")).alias("predictor")).agg(F.avg("rate").alias("adj_pr2"))
    return X.encoding_pair_tests(scores)


@register("pseudopopulation")
def pseudopopulation(spark, d):
    return K.pseudopopulation(V.trials(spark, d))


@register("explode_ragged_units", """WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT o_custkey AS session, o_orderkey AS unit_idx, o_totalprice AS t FROM s""")
def explode_ragged_units(spark, d):
    o = V.table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    flat = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")).over(Window.partitionBy("o_custkey"))), lambda s: s["o_totalprice"])
    units = o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("unit_idx"), F.row_number().over(w).alias("stop"), flat.alias("flat"))
    return S.explode_ragged_units(units)


@register("parse_contacts", """SELECT l_orderkey AS frame, l_linenumber::INTEGER AS "row", (l_linenumber + 1)::INTEGER AS col, 'seg' || l_returnflag AS segment, round(l_discount, 2) AS dist FROM lineitem""")
def parse_contacts(spark, d):
    cell = F.format_string("%d.%d:seg%s:%.2f", "l_linenumber", F.col("l_linenumber") + 1, "l_returnflag", "l_discount")
    lines = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.array_join(F.collect_list(cell), ",").alias("value"))
    return S.parse_contacts(lines, ("frame",))


@register("crop_to_period", TRIAL_COUNTS + "SELECT session, unit_id, trial, n FROM tc WHERE start BETWEEN trial * 3000.0 AND 60000.0 AND trial * 3000.0 < 60000.0")
def crop_to_period(spark, d):
    tc = A.trial_counts(V.spikes(spark, d), V.trials(spark, d))
    tp = V.trials(spark, d).select("session", "trial", (F.col("trial") * 3000.0).alias("first_grasp_start"), F.lit(60000.0).alias("release"))
    return P.crop_to_period(tc, tp, "active_grasp", time="start").select("session", "unit_id", "trial", "n")


@register("enforce_rom", """SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, CASE l_returnflag WHEN 'A' THEN 11 WHEN 'N' THEN 6 ELSE l_quantity END), CASE l_returnflag WHEN 'A' THEN 29 WHEN 'N' THEN 39 ELSE l_quantity END)::DOUBLE AS value FROM lineitem""")
def enforce_rom(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("value"))
    dofs = spark.createDataFrame([("A", 10.0, 30.0), ("N", 5.0, 40.0)], "dof_name string, range_min double, range_max double")
    return P.enforce_rom(li, dofs, 1.0).select("l_orderkey", "l_linenumber", "value")


@register("to_radians", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN l_quantity / 180 * pi() ELSE l_quantity END, 9) AS value FROM lineitem")
def to_radians(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("value"))
    dofs = spark.createDataFrame([("A", 1), ("N", 0)], "dof_name string, rotation int")
    return P.to_radians(li, dofs).select("l_orderkey", "l_linenumber", F.round("value", 9).alias("value"))


@register("drop_far_markers", """WITH m AS (SELECT l_suppkey, median(l_quantity) AS a, median(l_discount) AS b, median(l_tax) AS c FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN sqrt((l_quantity - a) ** 2 + (l_discount - b) ** 2 + (l_tax - c) ** 2) <= 10 THEN l_quantity END AS x FROM lineitem JOIN m USING (l_suppkey)""")
def drop_far_markers(spark, d):
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("frame"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))
    return W.drop_far_markers(li, far=10.0).select("l_orderkey", "l_linenumber", "x")


@register("marker_completeness", "SELECT l_suppkey AS marker, round(avg((l_quantity > 10)::INTEGER), 9) AS completeness FROM lineitem GROUP BY 1")
def marker_completeness(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("marker"), F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("x"))
    return A.marker_completeness(li).withColumns(r("completeness", places=9))


@register("validate_design", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity <= 10) AS not_finite FROM lineitem GROUP BY 1")
def validate_design(spark, d):
    li = V.table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("q"), F.lit(1.0).alias("one"))
    return A.validate_design(li, ["q", "one"], ["l_returnflag"]).drop("constant")


@register("ttl_channel_choice", """WITH c AS (SELECT user_id AS session, CASE event_type WHEN 'signup' THEN 'TTL_in' WHEN 'click' THEN 'sync' ELSE event_type END AS stream_name FROM events),
p AS (SELECT session, stream_name, count(*) AS n, CASE WHEN stream_name = 'TTL_in' THEN 3 WHEN stream_name = 'sync' THEN 2 ELSE 0 END AS points FROM c GROUP BY ALL)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY session ORDER BY points DESC, n DESC, stream_name) = 1""")
def ttl_channel_choice(spark, d):
    kind = F.col("event_type")
    e = V.table(spark, d, "events").select(F.col("user_id").alias("session"), F.when(kind == "signup", "TTL_in").when(kind == "click", "sync").otherwise(kind).alias("stream_name"))
    return A.ttl_channel_choice(e)


@register("encoding_summary", """SELECT a.predictor, median_lag, n_lags, median_adj_pr2, n_units FROM (SELECT l_returnflag AS predictor, median(l_discount * 20 - 1) AS median_lag, count(*) AS n_lags FROM lineitem WHERE abs(l_discount * 20 - 1) < 1 - 1e-9 GROUP BY 1) a
JOIN (SELECT l_returnflag AS predictor, median(l_tax) AS median_adj_pr2, count(*) AS n_units FROM lineitem GROUP BY 1) b USING (predictor)""")
def encoding_summary(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("predictor"), (F.col("l_discount") * 20 - 1).alias("lag"), F.col("l_tax").alias("adj_pr2"))
    return A.encoding_summary(li, li)


@register("optimal_frame", """WITH v AS (SELECT o_custkey AS session, o_orderkey AS t, o_totalprice AS force, o_orderkey % 1000 AS speed FROM orders),
s AS (SELECT *, force / max(force) OVER w + 1 - coalesce((speed - min(speed) OVER w) / nullif(max(speed) OVER w - min(speed) OVER w, 0), 0) AS score FROM v WINDOW w AS (PARTITION BY session))
SELECT session, t AS optimal_t, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, t) = 1""")
def optimal_frame(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("force"), (F.col("o_orderkey") % 1000).cast("double").alias("speed"))
    return W.optimal_frame(o.select("session", "t", "force"), o.select("session", "t", "speed"), ("session",)).withColumns(r("score", places=9))


@register("session_timeline", f"""WITH s AS ({V.SPIKES}) SELECT session, 'spike' AS kind, unit_id AS name, t, 1::DOUBLE AS value, floor(t / 600)::BIGINT AS page FROM s
UNION ALL SELECT session, 'pulse', h::VARCHAR, h * 3600::DOUBLE, 0::DOUBLE, (h * 6)::BIGINT FROM (SELECT DISTINCT session FROM s), (SELECT unnest(range(24)) AS h)""")
def session_timeline(spark, d):
    s = V.spikes(spark, d).select("session", F.col("unit_id").alias("name"), "t", F.lit(1.0).alias("value"))
    p = V.trials(spark, d).select("session", F.col("trial").alias("name"), F.col("start").alias("t"), F.lit(0.0).alias("value"))
    return W.session_timeline({"spike": s, "pulse": p}, 600.0)


def _reaches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every session's signals as two trials of half a month each, two days of which stand for a second: force, angles, trials."""
    s = V.signals(spark, d).withColumns({"trial": F.floor(F.col("t") / 1_296_000).cast("int"), "t": F.col("t") / 172_800})
    force = s.groupBy("session", "trial", "t").agg(F.sum("value").alias("force"))
    trials = s.groupBy("session", "trial").agg(F.percentile("t", F.lit(0.5)).alias("ttl_to_success_grasp"))
    return force, s.select("session", "trial", "channel", "t", "value"), trials


JOINTS = {"shoulder": ["click"], "elbow": ["view"], "wrist": ["error", "signup"], "finger": ["signup", "purchase"], "pose": ["click", "view"]}


def _timepoints(spark: SparkSession, d: str) -> DataFrame:
    return W.trial_timepoints(*_reaches(spark, d), joints=JOINTS, aperture=("click", "click"), levels=(0.3, 0.1))


@register("trial_timepoints")
def trial_timepoints(spark, d):
    return _timepoints(spark, d)


@register("crop_to_active_movement")
def crop_to_active_movement(spark, d):
    return P.crop_to_period(_reaches(spark, d)[1], _timepoints(spark, d), "active_movement")
