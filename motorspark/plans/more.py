"""More queries: settings, selections, alignments and marker tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from motorspark.functions import scalars as C
from motorspark.operators import aggregates as A
from motorspark.operators import ordering as K
from motorspark.operators import pairing as J
from motorspark.operators import predicates as P
from motorspark.operators import series as W
from motorspark.plans import views as V
from motorspark.plans.demo import BY, INTERP, SIG, r
from motorspark.plans.registry import register


@register("sessions_by_date", "SELECT o_orderdate::DATE AS date, count(DISTINCT o_orderkey % 3) AS sessions FROM orders GROUP BY 1")
def sessions_by_date(spark, d):
    o = V.table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit("_Set"), (F.col("o_orderkey") % 3 + 1)).alias("session"))
    return P.sessions_by_date(o).select("date", F.size("sessions").cast("long").alias("sessions"))


@register("split_codes", """SELECT o_orderkey, unnest(list_filter(list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)), lambda x: x <> '')) AS code FROM orders""")
def split_codes(spark, d):
    o = V.table(spark, d, "orders").withColumn("c", F.regexp_replace("o_orderpriority", "-", ","))
    return o.select("o_orderkey", F.explode(P.split_codes("c")).alias("code"))


@register("filter_dofs", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') AND NOT ends_with(p_type, 'L')")
def filter_dofs(spark, d):
    return P.filter_dofs(V.table(spark, d, "part"), column="p_type", prefix="S", suffix="L").select("p_partkey")


@register("curate_units", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 AND l_discount < 0.05 AND l_tax < 0.04")
def curate_units(spark, d):
    return P.curate_units(V.table(spark, d, "lineitem"), "l_quantity > 20 AND l_discount < 0.05 AND l_tax < 0.04").select("l_orderkey", "l_linenumber")


@register("resolve_unit_selection", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (3, 7, 9)")
def resolve_unit_selection(spark, d):
    found, _ = P.resolve_unit_selection(V.table(spark, d, "lineitem"), [3, "7", 9, "no such"], "l_suppkey")
    return found.select("l_orderkey", "l_linenumber")


@register("resolve_setting", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END, 'none') AS setting FROM orders")
def resolve_setting(spark, d):
    o = V.table(spark, d, "orders").withColumns({"a": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")), "b": F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise("")})
    return o.select("o_orderkey", P.resolve_setting("a", "b", "none").alias("setting"))


@register("resolve_sessions", "SELECT c_custkey::VARCHAR AS session, CASE WHEN c_custkey = 5 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS position FROM customer WHERE c_custkey IN (5, 8) OR c_mktsegment = 'BUILDING'")
def resolve_sessions(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session"), F.col("c_mktsegment").alias("region"), F.lit("").alias("burr_hole"))
    return P.resolve_sessions(c, ["5", "region:building", "sel:mine"], {"mine": ["8"]})


@register("reflect_and_rotate", "SELECT vec_id, round(embedding[3]::DOUBLE * 0.001 - 1, 9) AS x, round(-embedding[2]::DOUBLE * 0.001, 9) + 0 AS y, round(-embedding[1]::DOUBLE * 0.001, 9) + 0 AS z FROM embeddings")
def reflect_and_rotate(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return P.reflect_and_rotate(e, reflect=True, shift=(1.0, 0.0, 0.0)).withColumns(r("x", "y", "z", places=9))


@register("attach_timepoints", """SELECT o_orderkey, c_acctbal, c_custkey IS NOT NULL AS has_timepoints, false AS duplicate_timepoints FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey""")
def attach_timepoints(spark, d):
    t = V.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return J.attach_timepoints(V.table(spark, d, "orders"), t, ("o_custkey",)).select("o_orderkey", "c_acctbal", "has_timepoints", "duplicate_timepoints")


@register("get_timepoint", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value WHEN event_id % 3 = 0 THEN 1::DOUBLE END AS tp FROM events")
def get_timepoint(spark, d):
    e = V.table(spark, d, "events").withColumns({"a": F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(float("nan")), "b": F.when(F.col("event_id") % 3 == 0, F.lit(1.0)).otherwise(float("inf"))})
    return e.select("event_id", J.get_timepoint("a", "b").alias("tp"))


@register("best_source", """SELECT c_nationkey AS session, c_name AS name FROM customer WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_name) = 1""")
def best_source(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_name").alias("name"), "c_mktsegment", (F.col("c_acctbal") > 0).alias("readable"))
    return J.best_source(c, F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1)).select("session", "name")


PAIRS = "WITH v AS (SELECT l_suppkey AS unit_id, l_returnflag AS predictor, avg(l_tax) AS v FROM lineitem GROUP BY ALL)"


@register("paired_units", PAIRS + " SELECT a.unit_id, a.predictor AS predictor_a, b.predictor AS predictor_b, round(a.v, 9) AS value_a, round(b.v, 9) AS value_b FROM v a JOIN v b ON a.unit_id = b.unit_id AND a.predictor < b.predictor")
def paired_units(spark, d):
    v = V.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id"), F.col("l_returnflag").alias("predictor")).agg(F.avg("l_tax").alias("v"))
    return J.paired_units(v, "v", keys=("unit_id",)).withColumns(r("value_a", "value_b", places=9))


@register("rename_markers", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'a2' ELSE 'n' END AS marker FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def rename_markers(spark, d):
    names = spark.createDataFrame([("A", "a1", 0), ("A", "a2", 1), ("N", "n", 2)], "old string, new string, seq int")
    return J.rename_markers(V.table(spark, d, "lineitem").withColumn("marker", F.col("l_returnflag")), names).select("l_orderkey", "l_linenumber", "marker")


@register("adjustment_trial", "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjustment_pos FROM orders")
def adjustment_trial(spark, d):
    o = V.table(spark, d, "orders").withColumn("adjustment", F.col("o_orderstatus") == "P")
    return J.adjustment_trial(o, ("o_custkey",), "o_orderkey").select("o_orderkey", "adjustment_pos")


@register("trial_log_lookup", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def trial_log_lookup(spark, d):
    log = V.table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return J.trial_log_lookup(V.table(spark, d, "lineitem"), log, ["o_totalprice"], ("l_orderkey",)).select("l_orderkey", "l_linenumber", "o_totalprice")


@register("sensor_time_align", SIG + """, s AS (SELECT session, channel, t, value FROM sig),
m AS (SELECT session, max(a) AS a, min(b) AS b FROM (SELECT session, channel, min(t) AS a, max(t) AS b FROM s GROUP BY ALL) GROUP BY 1),
g AS (SELECT DISTINCT c.session, c.channel, u.t FROM (SELECT DISTINCT session, t FROM s) u JOIN m ON u.session = m.session AND u.t BETWEEN a AND b JOIN (SELECT DISTINCT session, channel FROM s) c ON c.session = u.session),
x0 AS (SELECT g.*, p.t AS x0, p.value AS y0 FROM g ASOF JOIN s p ON p.session = g.session AND p.channel = g.channel AND p.t <= g.t),
x1 AS (SELECT x0.*, q.t AS x1, q.value AS y1 FROM x0 ASOF JOIN s q ON q.session = x0.session AND q.channel = x0.channel AND q.t >= x0.t)
SELECT session, t, round(sum(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END), 5) AS force FROM x1 GROUP BY ALL""")
def sensor_time_align(spark, d):
    s = V.signals(spark, d).select("session", F.col("channel").alias("sensor"), "t", F.col("value").alias("force"))
    return J.sensor_time_align(s, ("session",)).withColumns(r("force", places=5))


@register("pool_behavior", INTERP.replace("k * 86400::DOUBLE AS t FROM", "k * 86400::DOUBLE AS t FROM") + """, v AS (SELECT session, channel, t, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END AS value FROM a JOIN b USING (session, channel, t))
SELECT session, channel, 0 AS condition, (t / 86400)::INTEGER AS bin, round(avg(value), 6) AS rate_avg, 0::DOUBLE AS rate_sem, count(*) AS n FROM v GROUP BY ALL""")
def pool_behavior(spark, d):
    s = V.signals(spark, d).withColumn("trial", F.lit(0))
    events = s.select("session", "trial").distinct().withColumns({"condition": F.lit(0), "tp": F.lit(15 * 86400.0)})
    return W.pool_behavior(s, events, 15 * 86400.0, 15 * 86400.0, 86400.0).withColumns(r("rate_avg"))


@register("force_traces_by_target", SIG + f""", e AS (SELECT session, channel, quantile_cont(t, 0.5) AS tp, session % 3 AS target FROM sig GROUP BY ALL),
g AS (SELECT session, channel, target, k AS bin, tp + (k * 8640.0::DOUBLE - 86400) AS t FROM e, (SELECT unnest(range(21)) AS k)),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session, channel) AS n FROM sig WINDOW w AS {BY}),
f AS (SELECT session, channel, max(t) FILTER (WHERE i = 1) AS t1, max(value) FILTER (WHERE i = 1) AS v1, max(t) FILTER (WHERE i = 2) AS t2, max(value) FILTER (WHERE i = 2) AS v2,
max(t) FILTER (WHERE i = n - 1) AS t3, max(value) FILTER (WHERE i = n - 1) AS v3, max(t) FILTER (WHERE i = n) AS t4, max(value) FILTER (WHERE i = n) AS v4 FROM n GROUP BY ALL),
a AS (SELECT g.*, s.t AS x0, s.value AS y0 FROM g ASOF LEFT JOIN sig s ON s.session = g.session AND s.channel = g.channel AND s.t <= g.t),
b AS (SELECT a.*, s.t AS x1, s.value AS y1 FROM a ASOF LEFT JOIN sig s ON s.session = a.session AND s.channel = a.channel AND s.t >= a.t),
l AS (SELECT session, target, bin, t, CASE WHEN x0 IS NULL THEN t1 WHEN x1 IS NULL THEN t3 ELSE x0 END AS x0, CASE WHEN x0 IS NULL THEN v1 WHEN x1 IS NULL THEN v3 ELSE y0 END AS y0,
CASE WHEN x0 IS NULL THEN t2 WHEN x1 IS NULL THEN t4 ELSE x1 END AS x1, CASE WHEN x0 IS NULL THEN v2 WHEN x1 IS NULL THEN v4 ELSE y1 END AS y1 FROM b JOIN f USING (session, channel))
SELECT session, target, bin::INTEGER AS bin, round(avg(greatest(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END, 0)), 5) AS force, count(*) AS n FROM l GROUP BY ALL""")
def force_traces_by_target(spark, d):
    s = V.signals(spark, d).select("session", F.col("channel").alias("trial"), "t", F.col("value").alias("force"))
    events = s.groupBy("session", "trial").agg(F.percentile("t", F.lit(0.5)).alias("tp")).withColumn("target", F.col("session") % 3)
    return W.force_traces_by_target(s, events, 86400.0, 8640.0).withColumns(r("force", places=5))


@register("impulse", SIG + """, l AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w, 0) AS dt FROM sig WINDOW w AS (PARTITION BY session, channel ORDER BY t))
SELECT session, channel, round(sum(value * dt), 2) AS impulse, round(sum(value), 6) AS sum FROM l GROUP BY ALL""")
def impulse(spark, d):
    return A.impulse(V.signals(spark, d), ["session", "channel"], "value").withColumns(r("impulse", places=2) | r("sum"))


SPEED = SIG + f""", v AS (SELECT session, channel, t, abs(value - lag(value) OVER w) AS s FROM sig WINDOW w AS {BY}), u AS (SELECT * FROM v WHERE s IS NOT NULL),
z AS (SELECT session, t, coalesce((s - min(s) OVER c) / nullif(max(s) OVER c - min(s) OVER c, 0), 0) AS s FROM u WINDOW c AS (PARTITION BY session, channel)),
q AS (SELECT session, t, sum(s) AS s FROM z GROUP BY ALL), sp AS (SELECT session, t, s / max(s) OVER (PARTITION BY session) AS y FROM q)"""


@register("movement_onset", SPEED + """, l AS (SELECT *, lag(y) OVER w AS y0, lag(t) OVER w AS x0, lead(y) OVER w AS y1 FROM sp WINDOW w AS (PARTITION BY session ORDER BY t)),
m AS (SELECT session, max(t) AS since FROM l WHERE y < y0 AND y < y1 AND y < 0.2 GROUP BY 1), c AS (SELECT session, x0 + (0.2 - y0) / (y - y0) * (t - x0) AS c FROM l WHERE y > 0.2 AND y0 <= 0.2)
SELECT session, round(min(c), 4) AS onset FROM c LEFT JOIN m USING (session) WHERE since IS NULL OR c >= since GROUP BY 1""")
def movement_onset(spark, d):
    return W.movement_onset(W.normalised_velocity(V.signals(spark, d))).withColumns(r("onset", places=4))


@register("max_aperture_time", SIG + """, g AS (SELECT session, channel, quantile_cont(t, 0.5) AS m FROM sig GROUP BY ALL),
n AS (SELECT sig.session, sig.channel, t, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig JOIN g USING (session, channel) WHERE t BETWEEN m - 200000 AND m WINDOW w AS (PARTITION BY sig.session, sig.channel ORDER BY t))
SELECT session, channel, arg_max(t, (value, -t)) AS mga_time FROM n WHERE value > a AND value > b GROUP BY ALL""")
def max_aperture_time(spark, d):
    s = V.signals(spark, d)
    grasp = s.groupBy("session", "channel").agg(F.percentile("t", F.lit(0.5)).alias("start"))
    return W.max_aperture_time(s, grasp, ("session", "channel"), before=200_000.0)


@register("hand_retreat", SIG + """, g AS (SELECT session, channel, quantile_cont(t, 0.5) AS m FROM sig GROUP BY ALL),
n AS (SELECT sig.session, sig.channel, t, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig JOIN g USING (session, channel) WHERE t BETWEEN m AND m + 200000 WINDOW w AS (PARTITION BY sig.session, sig.channel ORDER BY t))
SELECT session, channel, arg_min(t, (value, t)) AS hand_retreat_time FROM n WHERE value < a AND value < b GROUP BY ALL""")
def hand_retreat(spark, d):
    s = V.signals(spark, d)
    grasp = s.groupBy("session", "channel").agg(F.percentile("t", F.lit(0.5)).alias("stop"))
    return W.hand_retreat(s, grasp, ("session", "channel"), within=200_000.0)


@register("stable_period", """WITH e AS (SELECT label AS session, vec_id / 50 AS t, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
s AS (SELECT session, t, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) / (t - lag(t) OVER w) AS s FROM e WINDOW w AS (PARTITION BY session ORDER BY t)),
m AS (SELECT session, t, least(coalesce(s / nullif(quantile_cont(s, 0.95) OVER (PARTITION BY session), 0), 0), 1) AS v FROM s WHERE s IS NOT NULL),
f AS (SELECT session, t, list_sort([coalesce(lag(v) OVER w, 0), v, coalesce(lead(v) OVER w, 0)])[2] AS v FROM m WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, round(arg_min(t, (v, t)) - 0.15, 6) AS start, round(arg_min(t, (v, t)) + 0.15, 6) AS stop FROM f GROUP BY 1""")
def stable_period(spark, d):
    e = V.table(spark, d, "embeddings").select(F.col("label").alias("session"), F.lit("m").alias("marker"), (F.col("vec_id") / 50).alias("t"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return W.stable_period(e).withColumns(r("start", "stop"))


@register("edge_times_on_spike_clock", """WITH e AS (SELECT user_id AS session, event_id, CASE WHEN event_id % 4 > 0 THEN (event_id * 30 - 100) / 30000 END AS s, event_id / 1000 AS timestamp FROM events)
SELECT session, event_id, round(coalesce(s, timestamp - median(timestamp - s) OVER (PARTITION BY session)), 9) AS spike_time FROM e""")
def edge_times_on_spike_clock(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") * 30).alias("sample_number"), F.lit(100).alias("first_sample"), F.lit(30000.0).alias("fs"), (F.col("event_id") / 1000.0).alias("timestamp"))
    return W.edge_times_on_spike_clock(e).select("session", "event_id", F.round("spike_time", 9).alias("spike_time"))


@register("close_gaps", SIG + """, b AS (SELECT session, k * 500000::DOUBLE AS boundary, 100::DOUBLE * k AS gap FROM (SELECT DISTINCT session FROM sig), (SELECT unnest([1, 2, 3]) AS k)),
c AS (SELECT session, boundary, sum(greatest(gap - 150, 0)) OVER (PARTITION BY session ORDER BY boundary) AS removed FROM b)
SELECT session, channel, round(t - coalesce((SELECT max(removed) FROM c WHERE c.session = sig.session AND boundary <= sig.t), 0), 6) AS t FROM sig""")
def close_gaps(spark, d):
    s = V.signals(spark, d).select("session", "channel", "t")
    b = s.select("session").distinct().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("session", (F.col("k") * 500_000.0).alias("boundary"), (F.col("k") * 100.0).alias("gap"))
    return W.close_gaps(s, b, 150.0).select("session", "channel", F.round("t", 6).alias("t"))


@register("resync_frames", "WITH f AS (SELECT label AS trial_num, vec_id, vec_id / 50 AS t FROM embeddings) SELECT trial_num, vec_id, round(t - trial_num * 0.25, 9) AS t FROM f")
def resync_frames(spark, d):
    f = V.frames(spark, d).withColumnsRenamed({"sensor": "trial_num", "frame": "vec_id"})
    log = f.select("trial_num").distinct().withColumns({"started_ms": F.lit(1000.0), "sync_start_ms": 1000.0 + F.col("trial_num") * 250.0})
    return W.resync_frames(f, log, ("trial_num",)).select("trial_num", "vec_id", F.round("t", 9).alias("t"))


ROWS = SIG + f""", n AS (SELECT session, channel, t, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY session, channel) AS n FROM sig WINDOW w AS {BY})"""


@register("decimate", ROWS + """, p AS (SELECT session, channel, i, value FROM n UNION ALL SELECT session, channel, n, value FROM n WHERE i = n - 1 AND n % 5 > 0),
h AS (SELECT j, CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / 5) / (pi() * j / 5) END * (0.54 + 0.46 * cos(pi() * j / 50)) AS h FROM (SELECT unnest(range(-50, 51)) AS j))
SELECT n.session, n.channel, n.t, round(sum(p.value * h) / (SELECT sum(h) FROM h), 6) AS value FROM n, h JOIN p ON p.session = n.session AND p.channel = n.channel AND p.i = n.i - h.j WHERE n.i % 5 = 0 GROUP BY ALL""")
def decimate(spark, d):
    return W.decimate(V.signals(spark, d), 5).withColumns(r("value"))


@register("lowpass_butter")
def lowpass_butter(spark, d):
    return W.lowpass_butter(V.signals(spark, d), 2, 5.0, 50.0)


@register("filter_by_channel", SIG + f""" SELECT session, channel, t, round(CASE channel WHEN 'click' THEN value - min(value) OVER (PARTITION BY session, channel) WHEN 'view' THEN sum(value) OVER w ELSE value END, 5) AS smoothed FROM sig WINDOW w AS {BY}""")
def filter_by_channel(spark, d):
    filters = {"click": lambda _, v: v - v.min(), "view": lambda _, v: v.cumsum()}
    return W.filter_by_channel(V.signals(spark, d), filters).select("session", "channel", "t", F.round("smoothed", 5).alias("smoothed"))


@register("trial_event_time", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN least(a, b, c) WHEN 1 THEN a ELSE (a + b) / 2 END AS event_time FROM (
SELECT o_orderkey, o_totalprice AS a, (o_orderkey % 1000 * 100)::DOUBLE AS b, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey * 10)::DOUBLE END AS c FROM orders)""")
def trial_event_time(spark, d):
    a, b, c = F.col("o_totalprice"), (F.col("o_orderkey") % 1000 * 100).cast("double"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") * 10).cast("double"))
    o = V.table(spark, d, "orders").withColumns({"shoulder_onset": a, "elbow_onset": b, "wrist_onset": c, "finger_onset": b, "first_grasp_start": a, "release": b})
    kind = F.col("o_orderkey") % 3
    return o.select("o_orderkey", F.when(kind == 0, C.trial_event_time("movement_onset")).when(kind == 1, C.trial_event_time("initial_grasp")).otherwise(C.trial_event_time("mid_grasp")).alias("event_time"))


@register("nan_median_filter", ROWS + """ SELECT session, channel, t, value, CASE WHEN i < 2 OR i >= n - 2 THEN value ELSE median(value) OVER (PARTITION BY session, channel ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS smoothed FROM n""")
def nan_median_filter(spark, d):
    return W.nan_median_filter(V.signals(spark, d), ["session", "channel"], 5)


@register("marker_cleanup", ROWS + """, v AS (SELECT session, channel, i, n, CASE WHEN value / 500 >= 0.2 THEN value END AS x FROM n),
m AS (SELECT session, channel, i, n, CASE WHEN i < 2 OR i >= n - 2 THEN x WHEN count(x) OVER w >= 3 THEN median(x) OVER w END AS y FROM v WINDOW w AS (PARTITION BY session, channel ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
g AS (SELECT a.session, a.channel, a.i, sum(b.y * exp(-j * j / 8.0)) AS total, sum(CASE WHEN b.y IS NOT NULL THEN exp(-j * j / 8.0) END) AS weight FROM m a, (SELECT unnest(range(-8, 9)) AS j) o JOIN m b ON b.session = a.session AND b.channel = a.channel AND b.i = least(greatest(a.i + o.j, 0), a.n - 1) GROUP BY ALL)
SELECT session, channel, (i + 1)::INTEGER AS frame, round(total / weight, 6) AS cleaned FROM g""")
def marker_cleanup(spark, d):
    s = V.signals(spark, d).withColumns({"confidence": F.col("value") / 500, "frame": F.row_number().over(Window.partitionBy("session", "channel").orderBy("t"))})
    return W.marker_cleanup(s, ["session", "channel"], 0.2, 5, 2.0).select("session", "channel", "frame", F.round("cleaned", 6).alias("cleaned"))


@register("cumulative_unit_positions", "SELECT s_suppkey, (s_suppkey % 2) * 16::DOUBLE AS x, (s_suppkey // 2) * 20::DOUBLE AS y FROM supplier")
def cumulative_unit_positions(spark, d):
    x, y = C.probe_position("s_suppkey", staggered=True)
    return V.table(spark, d, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"))


@register("digit_of", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'thumb' WHEN 'N' THEN 'middle' END AS digit FROM lineitem")
def digit_of(spark, d):
    seg = F.when(F.col("l_returnflag") == "A", "1MC").when(F.col("l_returnflag") == "N", "3PD_r").otherwise("palm")
    return V.table(spark, d, "lineitem").withColumn("segment", seg).select("l_orderkey", "l_linenumber", C.digit_of("segment").alias("digit"))


@register("experiment_type", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'force' WHEN o_orderkey % 3 = 1 THEN 'passive' ELSE 'unknown' END AS kind FROM orders")
def experiment_type(spark, d):
    name = F.when(F.col("o_orderkey") % 3 == 0, "log_Force.csv").when(F.col("o_orderkey") % 3 == 1, "passive_log.csv").otherwise("log.csv")
    return V.table(spark, d, "orders").withColumn("name", name).select("o_orderkey", C.experiment_type("name").alias("kind"))


@register("sample_trials")
def sample_trials(spark, d):
    return K.sample_trials(V.trials(spark, d), 5, seed=1).select("session", "trial")


@register("theoretical_chance", "SELECT l_returnflag, 1.0::DOUBLE / count(DISTINCT l_linestatus) AS chance FROM lineitem GROUP BY 1")
def theoretical_chance(spark, d):
    from motorspark.functions.stats import theoretical_chance as chance

    return chance(V.table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus")


@register("evaluate_status", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'BIG' WHEN o_orderstatus = 'F' THEN 'DONE' ELSE 'NEG' END AS status FROM orders")
def evaluate_status(spark, d):
    return A.evaluate_status(V.table(spark, d, "orders"), [("BIG", F.col("o_totalprice") > 200_000), ("DONE", F.col("o_orderstatus") == "F")]).select("o_orderkey", "status")


@register("cumulative_success_matrix", """WITH b AS (SELECT o_orderpriority, year(o_orderdate) AS session, sum((o_orderstatus <> 'F')::INTEGER) AS s, count(*) AS k FROM orders GROUP BY ALL)
SELECT o_orderpriority, session, round(sum(s) OVER w / sum(k) OVER w, 9) AS success_rate, (sum(k) OVER w)::BIGINT AS n FROM b WINDOW w AS (PARTITION BY o_orderpriority ORDER BY session)""")
def cumulative_success_matrix(spark, d):
    o = V.table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").cast("long").alias("session"), (F.col("o_orderstatus") != "F").cast("int").alias("success"))
    return A.cumulative_success_matrix(o, ["o_orderpriority"]).withColumns(r("success_rate", places=9))


@register("align_trial", SIG + """, j AS (SELECT session, floor(t / 500000)::BIGINT AS trial, channel, t, value FROM sig), f AS (SELECT session, trial, t, sum(value) * 2 AS force FROM j GROUP BY ALL),
d AS (SELECT session, trial, median(dt) AS dt, min(t) AS a, max(t) AS b FROM (SELECT *, t - lag(t) OVER (PARTITION BY session, trial, channel ORDER BY t) AS dt FROM j) GROUP BY ALL),
g AS (SELECT session, trial, dt, a + k * dt AS t, k, floor((b - a) / dt)::INTEGER AS last FROM (SELECT *, unnest(range(floor((b - a) / dt)::INTEGER + 1)) AS k FROM d WHERE dt > 0)),
e AS (SELECT *, CASE WHEN k = 0 AND last = 0 THEN t WHEN k = 0 THEN t - (lead(t) OVER w - t) / 2 ELSE (t + lag(t) OVER w) / 2 END AS lo, CASE WHEN last = 0 THEN t WHEN k = last THEN t + (t - lag(t) OVER w) / 2 ELSE (t + lead(t) OVER w) / 2 END AS hi FROM g WINDOW w AS (PARTITION BY session, trial ORDER BY k)),
m AS (SELECT e.session, e.trial, e.t, median(f.force) AS force FROM e JOIN f ON f.session = e.session AND f.trial = e.trial AND f.t >= e.lo AND f.t < e.hi GROUP BY ALL),
c AS (SELECT g.session, g.trial, g.t, channel FROM g JOIN (SELECT DISTINCT session, trial, channel FROM j) USING (session, trial)),
p AS (SELECT c.*, j.t AS x0, j.value AS y0 FROM c ASOF LEFT JOIN j ON j.session = c.session AND j.trial = c.trial AND j.channel = c.channel AND j.t <= c.t),
q AS (SELECT p.*, j.t AS x1, j.value AS y1 FROM p ASOF LEFT JOIN j ON j.session = p.session AND j.trial = p.trial AND j.channel = p.channel AND j.t >= p.t)
SELECT session, trial, round(t, 4) AS t, channel, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END, 4) AS value, round(coalesce(force, 0), 4) AS force FROM q LEFT JOIN m USING (session, trial, t)""")
def align_trial(spark, d):
    joints = V.signals(spark, d).select("session", F.floor(F.col("t") / 500_000).alias("trial"), "channel", "t", "value")
    frames = joints.groupBy("session", "trial", "t").agg(F.sum("value").alias("v")).select("session", "trial", "t", F.array("v", "v").alias("sensels"))
    return W.align_trial(joints, frames).withColumns(r("t", "value", "force", places=4))


@register("fingers_static", SPEED + """, g AS (SELECT session, quantile_cont(t, 0.2) AS a, quantile_cont(t, 0.8) AS b FROM sp GROUP BY 1),
l AS (SELECT session, t, y, lag(y) OVER w AS y0, lag(t) OVER w AS x0 FROM sp JOIN g USING (session) WHERE t BETWEEN a AND a + 200000 WINDOW w AS (PARTITION BY session ORDER BY t)),
m AS (SELECT session, t, y, lag(y) OVER w AS y0, lag(t) OVER w AS x0 FROM sp JOIN g USING (session) WHERE t BETWEEN b - 200000 AND b WINDOW w AS (PARTITION BY session ORDER BY t)),
still AS (SELECT session, min(CASE WHEN y = 0.4 THEN x0 ELSE t END) AS fingers_static FROM l WHERE y0 > 0.4 AND y <= 0.4 GROUP BY 1),
move AS (SELECT session, max(x0 + (0.4 - y0) / (y - y0) * (t - x0)) AS release_start FROM m WHERE y0 <= 0.4 AND y > 0.4 GROUP BY 1)
SELECT session, round(fingers_static, 4) AS fingers_static, round(release_start, 4) AS release_start FROM still FULL JOIN move USING (session)""")
def fingers_static(spark, d):
    speed = W.normalised_velocity(V.signals(spark, d))
    grasp = speed.groupBy("session").agg(F.percentile("t", F.lit(0.2)).alias("start"), F.percentile("t", F.lit(0.8)).alias("stop"))
    return W.fingers_static(speed, grasp, within=200_000.0).withColumns(r("fingers_static", "release_start", places=4))


@register("causal_histories", SIG + """, l AS (SELECT session, channel, t, value, lag(value, 1, 0) OVER w AS a, lag(value, 2, 0) OVER w AS b, lag(value, 3, 0) OVER w AS c, lag(value, 4, 0) OVER w AS d FROM sig WINDOW w AS (PARTITION BY session, channel ORDER BY t))
SELECT session, channel, t, round((value + a * exp(-0.5) + b * exp(-2.0) + c * exp(-4.5) + d * exp(-8.0)) / (1 + exp(-0.5) + exp(-2.0) + exp(-4.5) + exp(-8.0)), 6) AS rate FROM l""")
def causal_histories(spark, d):
    return W.causal_smooth(V.signals(spark, d), 1.0, ["session", "channel"], "t", "value").select("session", "channel", "t", F.round("rate", 6).alias("rate"))


@register("unit_depths", "SELECT s_suppkey AS unit_id, s_nationkey AS session, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS depth FROM supplier")
def unit_depths(spark, d):
    units = V.units(spark, d)
    depths = units.where("unit_id % 2 = 0").select("session", "unit_id", "depth")
    return J.order_by_depth(units, depths).select("unit_id", "session", "depth")


@register("natural_order", "SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^[^0-9]*'), regexp_extract(p_brand, '[0-9]+')::INTEGER) AS position FROM (SELECT DISTINCT p_brand FROM part)")
def natural_order(spark, d):
    b = V.table(spark, d, "part").select("p_brand").distinct()
    return K.positions(b.withColumn("_key", K.natural_key("p_brand")), "_key").drop("_key")
