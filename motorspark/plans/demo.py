"""Queries on the driver's tables, with DuckDB SQL for the same rows.

The views that stand for tables of the domain are in ``views``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.functions import scalars as C
from motorspark.functions import stats as X
from motorspark.operators import aggregates as A
from motorspark.operators import ordering as K
from motorspark.operators import pairing as J
from motorspark.operators import predicates as P
from motorspark.operators import series as W
from motorspark.plans import views as V
from motorspark.plans.registry import register

BEFORE, AFTER, WIDTH, SIGMA = 900.0, 900.0, 60.0, 150.0
BINS = len(W.edges(BEFORE, AFTER, WIDTH)) - 1
LEFT = float(W.edges(BEFORE, AFTER, WIDTH)[0])
RADIUS = int(4 * SIGMA / WIDTH + 0.5)
_K = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / (SIGMA / WIDTH)) ** 2)
KERNEL = ", ".join(f"({j - RADIUS}, {float(k)!r}::DOUBLE)" for j, k in enumerate(_K / _K.sum()))

CTE = f"""WITH spikes AS ({V.SPIKES}), trials AS ({V.TRIALS}), events_at AS (SELECT session, trial, condition, start + 1500.0 AS tp FROM trials),
spine AS (SELECT e.*, u.unit_id, b.bin FROM events_at e JOIN (SELECT DISTINCT session, unit_id FROM spikes) u USING (session), (SELECT unnest(range({BINS})) AS bin) b),
counts AS (SELECT s.session, s.unit_id, e.trial, least(floor((t - tp - ({LEFT})) / {WIDTH}), {BINS - 1})::BIGINT AS bin, count(*) AS n
  FROM spikes s JOIN events_at e ON s.session = e.session AND t - tp >= {LEFT} AND t - tp <= {LEFT + BINS * WIDTH} GROUP BY ALL),
filled AS (SELECT p.session, p.unit_id, p.trial, p.condition, p.bin, coalesce(n, 0) AS n FROM spine p LEFT JOIN counts USING (session, unit_id, trial, bin)),
kernel(j, k) AS (VALUES {KERNEL}),
folded AS (SELECT bin, j, k, CASE WHEN m < {BINS} THEN m ELSE {2 * BINS - 1} - m END AS src FROM
  (SELECT bin, j, k, ((bin + j) % {2 * BINS} + {2 * BINS}) % {2 * BINS} AS m FROM (SELECT unnest(range({BINS})) AS bin), kernel)),
rates AS (SELECT f.session, f.unit_id, f.trial, f.condition, d.bin, sum(f.n * d.k / {WIDTH}) AS rate FROM filled f JOIN folded d ON f.bin = d.src GROUP BY ALL)
"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return V.trials(spark, d).select("session", "trial", "condition", (F.col("start") + 1500.0).alias("tp"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return W.aligned_counts(V.spikes(spark, d), _events(spark, d), BEFORE, AFTER, WIDTH)


def _rates(spark: SparkSession, d: str) -> DataFrame:
    return W.gaussian_smooth(_counts(spark, d), SIGMA / WIDTH, BINS, ["session", "unit_id", "trial", "condition"], scale=1 / WIDTH)


def r(*columns: str, places: int = 6):
    """Rounded columns: sums of doubles differ in their last digits by the order of adding."""
    return {c: F.round(c, places) for c in columns}


# Peri-event activity

PETH = CTE + """SELECT session, unit_id, condition, bin::INTEGER AS bin, round(avg(rate), 9) AS rate_avg,
round(stddev_pop(rate) / sqrt(count(rate)), 9) AS rate_sem, count(rate) AS n FROM rates GROUP BY ALL"""


@register("peth", PETH)
def peth(spark: SparkSession, d: str) -> DataFrame:
    found = A.mean_and_sem(_rates(spark, d), ["session", "unit_id", "condition", "bin"])
    return found.withColumns(r("rate_avg", "rate_sem", places=9))


@register("aligned_counts", CTE + "SELECT session, unit_id, trial, condition, bin::INTEGER AS bin, n FROM filled")
def aligned_counts(spark, d):
    return _counts(spark, d)


@register("unit_rates", CTE + "SELECT session, unit_id, bin::INTEGER AS bin, round(avg(rate), 9) AS rate FROM rates GROUP BY ALL")
def unit_rates(spark, d):
    return _rates(spark, d).groupBy("session", "unit_id", "bin").agg(F.round(F.avg("rate"), 9).alias("rate"))


@register("spikes_in_windows", f"""WITH spikes AS ({V.SPIKES}), trials AS ({V.TRIALS})
SELECT s.session, unit_id, trial, round(t - start, 6) AS t FROM spikes s JOIN trials w ON s.session = w.session AND t > start AND t < stop""")
def spikes_in_windows(spark, d):
    return J.spikes_in_windows(V.spikes(spark, d), V.trials(spark, d)).select("session", "unit_id", "trial", F.round("t", 6).alias("t"))


TRIAL_COUNTS = f"""WITH spikes AS ({V.SPIKES}), trials AS ({V.TRIALS}),
c AS (SELECT s.session, unit_id, trial, count(*) AS n FROM spikes s JOIN trials w ON s.session = w.session AND t > start AND t < stop GROUP BY ALL),
tc AS (SELECT w.session, u.unit_id, w.trial, w.start, w.condition, coalesce(n, 0) AS n, coalesce(n, 0) / (w.stop - w.start) AS rate
  FROM trials w JOIN (SELECT DISTINCT session, unit_id FROM spikes) u USING (session) LEFT JOIN c USING (session, unit_id, trial))
"""


@register("trial_counts", TRIAL_COUNTS + "SELECT session, unit_id, trial, n, round(rate, 9) AS rate FROM tc")
def trial_counts(spark, d):
    return A.trial_counts(V.spikes(spark, d), V.trials(spark, d)).select("session", "unit_id", "trial", "n", F.round("rate", 9).alias("rate"))


@register("session_drift", TRIAL_COUNTS + "SELECT session, unit_id, round(coalesce(regr_slope(rate, start), 0), 12) + 0 AS slope, avg(start) AS t_ref FROM tc GROUP BY ALL")
def session_drift(spark, d):
    return A.session_drift(A.trial_counts(V.spikes(spark, d), V.trials(spark, d))).withColumns(r("slope", places=12))


@register("drift_corrected", TRIAL_COUNTS + """, f AS (SELECT session, unit_id, regr_slope(rate, start) AS slope, avg(start) AS t_ref FROM tc GROUP BY ALL)
SELECT session, unit_id, trial, round(rate - slope * (start - t_ref), 9) + 0 AS corrected FROM tc JOIN f USING (session, unit_id)""")
def drift_corrected(spark, d):
    rates = A.trial_counts(V.spikes(spark, d), V.trials(spark, d))
    return A.drift_corrected(rates, A.session_drift(rates)).select("session", "unit_id", "trial", F.round("corrected", 9).alias("corrected"))


@register("filter_active_units", TRIAL_COUNTS + "SELECT session, unit_id, trial, n FROM tc QUALIFY avg(rate) OVER (PARTITION BY session, unit_id) > 0.00028")
def filter_active_units(spark, d):
    return P.filter_active_units(A.trial_counts(V.spikes(spark, d), V.trials(spark, d)), 0.00028).select("session", "unit_id", "trial", "n")


@register("population_rate", f"""WITH spikes AS ({V.SPIKES}), u AS (SELECT session, count(DISTINCT unit_id) AS k FROM spikes GROUP BY ALL)
SELECT session, floor(t / 600.0)::BIGINT AS bin, round(count(*) / (any_value(k) * 600.0), 9) AS rate FROM spikes JOIN u USING (session) GROUP BY ALL""")
def population_rate(spark, d):
    return A.population_rate(V.spikes(spark, d), 600.0).withColumns(r("rate", places=9))


@register("common_conditions", CTE + """, p AS (SELECT DISTINCT session, unit_id, condition FROM filled WHERE n > 0),
u AS (SELECT session, count(DISTINCT unit_id) AS k FROM p GROUP BY ALL)
SELECT session, condition FROM p JOIN u USING (session) GROUP BY session, condition HAVING count(DISTINCT unit_id) = any_value(k)""")
def common_conditions(spark, d):
    return A.common_conditions(_counts(spark, d).where("n > 0"))[0]


@register("condition_matrix", CTE + """, p AS (SELECT session, unit_id, condition, bin, sum(n) AS v FROM filled GROUP BY ALL)
SELECT session, condition, bin::INTEGER AS bin, string_agg(unit_id || '=' || v::BIGINT, ',' ORDER BY unit_id) AS rates FROM p GROUP BY ALL""")
def condition_matrix(spark, d):
    sums = _counts(spark, d).groupBy("session", "unit_id", "condition", "bin").agg(F.sum("n").alias("rate_avg"))
    pairs = F.transform(F.array_sort(F.map_entries("rates")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return A.condition_matrix(sums).select("session", "condition", "bin", F.array_join(pairs, ",").alias("rates"))


@register("marginal_means", CTE + """, p AS (SELECT session, unit_id, condition, bin, sum(n)::DOUBLE AS v FROM filled GROUP BY ALL),
g AS (SELECT *, avg(v) OVER (PARTITION BY session, unit_id) AS grand, avg(v) OVER (PARTITION BY session, unit_id, bin) AS mt, avg(v) OVER (PARTITION BY session, unit_id, condition) AS mc FROM p)
SELECT session, unit_id, condition, bin::INTEGER AS bin, round(grand, 6) AS grand, round(mt - grand, 6) + 0 AS m_time, round(mc - grand + v - mt - mc + grand, 6) + 0 AS m_condition FROM g""")
def marginal_means(spark, d):
    sums = _counts(spark, d).groupBy("session", "unit_id", "condition", "bin").agg(F.sum("n").cast("double").alias("rate_avg"))
    return A.marginal_means(sums).select("session", "unit_id", "condition", "bin", *[F.round(c, 6).alias(c) for c in ("grand", "m_time", "m_condition")])


# Logs and trials

LOGS = f"""WITH p0 AS ({V.PROTOCOL}), s0 AS ({V.SENSOR}),
p AS (SELECT *, row_number() OVER (PARTITION BY session, trial_num ORDER BY seq) - 1 AS dup_index FROM p0),
s AS (SELECT *, row_number() OVER (PARTITION BY session, trial_num ORDER BY seq) - 1 AS dup_index FROM s0)
"""


@register("common_trials", LOGS + """SELECT session, seq, trial_num, dup_index::INTEGER AS dup_index, (row_number() OVER (PARTITION BY session ORDER BY seq) - 1)::INTEGER AS trial_pos
FROM p SEMI JOIN s USING (session, trial_num, dup_index)""")
def common_trials(spark, d):
    return J.common_trials(V.protocol_log(spark, d), V.sensor_log(spark, d)).select("session", "seq", "trial_num", "dup_index", "trial_pos")


@register("absent_trials", LOGS + """SELECT session, trial_num, dup_index::INTEGER AS dup_index, 'b' AS missing_in FROM p ANTI JOIN s USING (session, trial_num, dup_index)
UNION ALL SELECT session, trial_num, dup_index::INTEGER, 'a' FROM s ANTI JOIN p USING (session, trial_num, dup_index)""")
def absent_trials(spark, d):
    return J.absent_trials(V.protocol_log(spark, d), V.sensor_log(spark, d)).select("session", "trial_num", "dup_index", "missing_in")


@register("find_duplicate_trials", f"""WITH p AS ({V.PROTOCOL}) SELECT session, trial_num, count(*) AS n, sum(count(*)) OVER (PARTITION BY session)::BIGINT AS total
FROM p GROUP BY session, trial_num QUALIFY count(*) > 1""")
def find_duplicate_trials(spark, d):
    return A.find_duplicate_trials(V.protocol_log(spark, d))


@register("trial_offsets", f"""WITH p AS ({V.PROTOCOL}) SELECT session, seq, (reward > 0)::INTEGER AS success,
CASE WHEN reward > 0 AND reach_ms <> 0 THEN (reach_ms - sync_ms) / 1000 END AS ttl_to_reach, CASE WHEN reward > 0 AND touch_ms <> 0 THEN (touch_ms - sync_ms) / 1000 END AS ttl_to_touch FROM p""")
def trial_offsets(spark, d):
    return A.trial_offsets(V.protocol_log(spark, d), ["reach_ms", "touch_ms"], "sync_ms").select("session", "seq", "success", "ttl_to_reach", "ttl_to_touch")


@register("pair_pulses_to_trials", f"""WITH t AS ({V.PROTOCOL}),
a AS (SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) - 1 AS position FROM t),
b AS (SELECT session, trial_num, seq AS order_, row_number() OVER (PARTITION BY session ORDER BY seq) - 2 AS position, count(*) OVER (PARTITION BY session) AS n FROM t)
SELECT session, position::INTEGER AS position, a.seq AS seq, b.trial_num AS trial_num FROM a JOIN b USING (session, position) WHERE position >= 0""")
def pair_pulses_to_trials(spark, d):
    log = V.protocol_log(spark, d)
    paired, _ = J.pair_pulses_to_trials(log.select("session", F.col("seq").alias("pulse_idx")), log.select("session", F.col("seq").alias("trial_pos"), "trial_num"), skip=-1)
    return paired.select("session", "position", F.col("pulse_idx").alias("seq"), "trial_num")


@register("object_sets", "SELECT p_size, p_brand, (dense_rank() OVER (ORDER BY p_size, p_brand) - 1)::INTEGER AS object_id FROM (SELECT DISTINCT p_size, p_brand FROM part)")
def object_sets(spark, d):
    return A.object_sets(V.table(spark, d, "part"), ["p_size", "p_brand"])


@register("with_object_id", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_size, p_brand) - 1)::INTEGER AS object_id FROM part")
def with_object_id(spark, d):
    return A.with_object_id(V.table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), ["p_size", "p_brand"]).select("p_partkey", "object_id")


@register("filter_trials", f"WITH p AS ({V.PROTOCOL}) SELECT session, seq FROM p WHERE reward > 0 AND seq % 7 NOT IN (0, 2, 3, 4, 5)")
def filter_trials(spark, d):
    log = V.protocol_log(spark, d).withColumn("success", (F.col("reward") > 0).cast("int"))
    manual = log.select("session", "seq", F.array((F.col("seq") % 7).cast("string")).alias("codes"))
    return P.filter_trials(log, True, manual, ("session", "seq")).select("session", "seq")


@register("concat_logs", f"WITH p AS ({V.PROTOCOL}), s AS ({V.SENSOR}) SELECT session, seq, trial_num, 0 AS part FROM p UNION ALL SELECT session, seq, trial_num, 1 FROM s")
def concat_logs(spark, d):
    return K.concat_logs(V.protocol_log(spark, d).select("session", "seq", "trial_num"), V.sensor_log(spark, d).select("session", "seq", "trial_num"))


# Joins in time

ASOF = """SELECT o.o_orderkey, e.ts AS calibration FROM (SELECT o_orderkey, o_orderdate + INTERVAL 8400 DAY AS t FROM orders) o
ASOF LEFT JOIN (SELECT ts FROM events WHERE event_type = 'signup') e ON o.t >= e.ts"""


@register("asof_calibration", ASOF)
def asof_calibration(spark, d):
    return _calibrated(spark, d, V.table(spark, d, "orders"))


def _calibrated(spark, d, orders):
    o = orders.select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 8400 DAY")).alias("at"))
    c = V.table(spark, d, "events").where("event_type = 'signup'").select(F.col("ts").alias("date"), F.col("ts").alias("calibration"))
    return J.asof_last(o, c, "calibration", "at", "date", bucket=F.to_date).select("o_orderkey", "calibration")


@register("asof_calibration_every", ASOF)
def asof_calibration_every(spark, d):
    return _calibrated(spark, d, V.table(spark, d, "orders"))


NEAREST = f"""WITH sp AS ({V.SPIKES}), a AS (SELECT session, t FROM sp WHERE unit_id = 'click'), b AS (SELECT DISTINCT session, t FROM sp WHERE unit_id = 'view'),
n AS (SELECT a.session, a.t, b.t AS near, row_number() OVER (PARTITION BY a.session, a.t ORDER BY abs(a.t - b.t), b.t) AS k FROM a JOIN b USING (session))
"""


@register("nearest_time_join", NEAREST + "SELECT session, t, near AS nearest_t, round(abs(t - near), 6) AS distance FROM n WHERE k = 1")
def nearest_time_join(spark, d):
    s = V.spikes(spark, d)
    pick = lambda u: s.where(F.col("unit_id") == u).select("session", "t").distinct()
    return J.nearest_time_join(pick("click"), pick("view"), keys=["session"]).withColumns(r("distance"))


@register("unmatched_events", NEAREST + "SELECT session, t FROM n WHERE k = 1 AND abs(t - near) > 600.0")
def unmatched_events(spark, d):
    s = V.spikes(spark, d)
    pick = lambda u: s.where(F.col("unit_id") == u).select("session", "t").distinct()
    return J.unmatched_events(pick("click"), pick("view"), 600.0, keys=["session"])


@register("nearest_sample", "SELECT event_id, round_even(value * 50, 0)::BIGINT AS sample FROM events")
def nearest_sample(spark, d):
    return V.table(spark, d, "events").select("event_id", J.nearest_sample(F.col("value"), 50.0).alias("sample"))


# Units and depth

@register("order_by_depth", f"WITH u AS ({V.UNITS}) SELECT session, unit_id, (row_number() OVER (PARTITION BY session ORDER BY trunc(depth), unit_id) - 1)::INTEGER AS depth_order FROM u")
def order_by_depth(spark, d):
    return J.order_by_depth(V.units(spark, d)).select("session", "unit_id", "depth_order")


@register("select_units", f"WITH u AS ({V.UNITS}) SELECT session, unit_id FROM u WHERE lower(trim(label)) IN ('good', 'mua')")
def select_units(spark, d):
    return P.select_units(V.units(spark, d), ["good", "MUA "]).select("session", "unit_id")


@register("rank_fraction", f"""WITH u AS ({V.UNITS}), n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY depth, unit_id) AS k, count(*) OVER (PARTITION BY session) AS n FROM u)
SELECT session, unit_id, CASE WHEN k > n - greatest(round_even(n * 0.25, 0), 1) THEN 'top' ELSE 'bottom' END AS part FROM n
WHERE k > n - greatest(round_even(n * 0.25, 0), 1) OR k <= greatest(round_even(n * 0.25, 0), 1)""")
def rank_fraction(spark, d):
    return K.rank_fraction(V.units(spark, d), "depth", 0.25, 0.25).select("session", "unit_id", "part")


@register("choose_units", f"WITH u AS ({V.UNITS}) SELECT session, unit_id FROM u QUALIFY lower(trim(label)) = 'good' OR count(*) FILTER (WHERE lower(trim(label)) = 'good') OVER (PARTITION BY session) = 0")
def choose_units(spark, d):
    label = P.normalise_label("label")
    return J.choose_units(V.units(spark, d), "curated", label == "good", label == "noise").select("session", "unit_id")


@register("drop_noise_clusters", f"""WITH u AS ({V.UNITS}) SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT unit_id FROM u WHERE lower(trim(label)) = 'noise') n ON l_suppkey = n.unit_id""")
def drop_noise_clusters(spark, d):
    clusters = V.units(spark, d).select("unit_id", F.lit("").alias("manual"), F.trim("label").alias("auto"))
    spikes = V.table(spark, d, "lineitem").withColumn("unit_id", F.col("l_suppkey"))
    return P.drop_noise_clusters(spikes, clusters, ("unit_id",)).select("l_orderkey", "l_linenumber")


@register("binned_mean_rows", f"""WITH u AS ({V.UNITS}), e AS (SELECT min(depth) AS lo, max(depth) AS hi FROM u),
b AS (SELECT least(floor((depth - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, unit_id FROM u, e)
SELECT r.bin, round(avg(unit_id), 6) AS mean, count(unit_id) AS n FROM (SELECT unnest(range(10))::INTEGER AS bin) r LEFT JOIN b USING (bin) GROUP BY ALL""")
def binned_mean_rows(spark, d):
    return A.binned_mean_rows(V.units(spark, d), "depth", "unit_id", 10).withColumns(r("mean"))


@register("unique_unit_ids", """SELECT s_suppkey AS seq, s_nationkey AS session, 'ch' || (s_suppkey % 3) || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS unit_id
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) AS k FROM supplier)""")
def unique_unit_ids(spark, d):
    u = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("ch"), F.col("s_suppkey") % 3).alias("unit_label"))
    return K.unique_unit_ids(u).select("seq", "session", "unit_id")


@register("electrode_table", """SELECT s_nationkey AS session, s_suppkey % 2 AS channel_id, min(s_suppkey) AS unit_id, (min(s_suppkey) % 10) * 400::DOUBLE AS x_um, (min(s_suppkey) // 10) * 400::DOUBLE AS y_um
FROM supplier GROUP BY 1, 2""")
def electrode_table(spark, d):
    k = F.col("s_suppkey")
    u = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("session"), (k % 2).alias("channel_id"), k.alias("unit_id"), F.floor(k / 10).alias("channel_row"), (k % 10).alias("channel_col"))
    return A.electrode_table(u).select("session", "channel_id", "unit_id", "x_um", "y_um")


# Frames (A4-A6, W11, W6)

@register("sum_sensels", f"WITH f AS ({V.FRAMES}) SELECT sensor, frame, round(list_sum(sensels), 9) AS force FROM f")
def sum_sensels(spark, d):
    return A.sum_sensels(V.frames(spark, d)).select("sensor", "frame", F.round("force", 9).alias("force"))


@register("active_period", f"""WITH f AS ({V.FRAMES}), s AS (SELECT sensor, frame, list_sum(sensels) AS force, row_number() OVER (PARTITION BY sensor ORDER BY t) - 1 AS i, max(list_sum(sensels)) OVER (PARTITION BY sensor) AS top FROM f)
SELECT sensor, min(i)::INTEGER AS first, max(i)::INTEGER + 1 AS stop FROM s WHERE force >= 0.9 * top GROUP BY sensor""")
def active_period(spark, d):
    return A.active_period(A.sum_sensels(V.frames(spark, d)), 0.9)


@register("session_sensor_mask", f"WITH f AS ({V.FRAMES}), c AS (SELECT sensor, unnest(sensels) AS x, generate_subscripts(sensels, 1) - 1 AS sensel FROM f) SELECT sensor, sensel::INTEGER AS sensel, max(abs(x)) > 0 AS active FROM c GROUP BY ALL")
def session_sensor_mask(spark, d):
    return A.session_sensor_mask(V.frames(spark, d))


CELLS = f"""WITH f AS ({V.FRAMES}), c AS (SELECT sensor, frame, t, unnest(sensels) AS x, (generate_subscripts(sensels, 1) - 1)::INTEGER AS sensel FROM f),
s AS (SELECT sensor, t, list_sum(sensels) AS force, max(list_sum(sensels)) OVER (PARTITION BY sensor) AS top FROM f)
"""


@register("denoise_frames", CELLS + """, q AS (SELECT c.sensor, sensel, quantile_cont(x, 0.9) AS noise FROM c JOIN s USING (sensor, t) WHERE force <= 0.75 * top GROUP BY ALL),
z AS (SELECT c.sensor, c.t, c.sensel, CASE WHEN x <= coalesce(noise, -1e300) THEN 0 ELSE x END AS x FROM c LEFT JOIN q USING (sensor, sensel)),
l AS (SELECT *, coalesce(lag(x) OVER w, 0) AS a, coalesce(lead(x) OVER w, 0) AS b FROM z WINDOW w AS (PARTITION BY sensor, sensel ORDER BY t))
SELECT sensor, t, sensel, round(list_sort([a, x, b])[2], 9) AS x FROM l""")
def denoise_frames(spark, d):
    return W.denoise_frames(V.frames(spark, d), share=0.75).select("sensor", "t", "sensel", F.round("x", 9).alias("x"))


@register("segment_summary", CELLS + """SELECT sensor, frame, CASE WHEN sensel % 5 = 0 THEN 'None' ELSE 'seg' || (sensel % 5) END AS segment, round(sum(x), 6) AS force,
count(CASE WHEN sensel % 5 > 0 THEN 1 END) AS contacts, avg(CASE WHEN sensel % 5 > 0 THEN sensel / 10 END) AS mean_dist FROM c GROUP BY ALL""")
def segment_summary(spark, d):
    f = V.frames(spark, d)
    contacts = f.select("sensor", "frame", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sensel")).where("sensel % 5 > 0")
    contacts = contacts.withColumns({"segment": F.concat(F.lit("seg"), F.col("sensel") % 5), "dist": F.col("sensel") / 10})
    return A.segment_summary(f, contacts).withColumns(r("force"))


@register("force_by_group", CELLS + "SELECT sensor, frame, CASE WHEN sensel % 5 IN (1, 2) THEN 'low' ELSE 'high' END AS group_name, round(sum(x), 6) AS force FROM c WHERE sensel % 5 > 0 GROUP BY ALL")
def force_by_group(spark, d):
    f = V.frames(spark, d)
    contacts = f.select("sensor", "frame", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sensel")).withColumn("segment", F.concat(F.lit("seg"), F.col("sensel") % 5))
    groups = spark.createDataFrame([("low", "^seg[12]$"), ("high", "^seg[34]$")], "group_name string, pattern string")
    return A.force_by_group(f, contacts, groups).withColumns(r("force"))


@register("misattributed_force", CELLS + """SELECT sensor, frame, round(sum(CASE WHEN sensel % 3 <> sensel % 4 THEN x ELSE 0 END), 6) AS wrong, 0::DOUBLE AS unlabelled, round(sum(x), 6) AS total FROM c GROUP BY ALL""")
def misattributed_force(spark, d):
    f = V.frames(spark, d)
    cells = f.select("sensor", "frame", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("sensel"))
    label = lambda k: cells.withColumn("label", F.col("sensel") % k)
    return A.misattributed_force(f, label(3), label(4)).withColumns(r("wrong", "unlabelled", "total"))


# Series (W2-W9, W13-W16, W21-W25)

SIG = f"WITH sig AS ({V.SIGNALS})"
BY = "(PARTITION BY session, channel ORDER BY t)"


@register("joint_velocity", SIG + f""", l AS (SELECT *, lag(value) OVER w AS y0, lead(value) OVER w AS y2, t - lag(t) OVER w AS h1, lead(t) OVER w - t AS h2 FROM sig WINDOW w AS {BY})
SELECT session, channel, t, round(CASE WHEN h1 IS NULL THEN (y2 - value) / h2 WHEN h2 IS NULL THEN (value - y0) / h1
ELSE (h1 * h1 * (y2 - value) + h2 * h2 * (value - y0)) / (h1 * h2 * (h1 + h2)) END, 6) + 0 AS velocity FROM l""")
def joint_velocity(spark, d):
    return W.joint_velocity(V.signals(spark, d)).select("session", "channel", "t", F.round("velocity", 6).alias("velocity"))


@register("threshold_crossings", SIG + f""", l AS (SELECT *, lag(value) OVER w AS y0, lag(t) OVER w AS x0 FROM sig WINDOW w AS {BY})
SELECT session, channel, CASE WHEN value > 250 THEN 'up' ELSE 'down' END AS direction,
round(CASE WHEN value > 250 THEN x0 + (250 - y0) / (value - y0) * (t - x0) WHEN value = 250 THEN x0 ELSE t END, 6) AS crossing FROM l WHERE (value > 250) <> (y0 > 250)""")
def threshold_crossings(spark, d):
    return W.threshold_crossings(V.signals(spark, d), 250.0).withColumns(r("crossing"))


GRASPS = SIG + f""", l AS (SELECT *, lag(value) OVER w AS y0, lag(t) OVER w AS x0 FROM sig WINDOW w AS {BY}),
x AS (SELECT session, channel, value > 250 AS up, CASE WHEN value > 250 THEN x0 + (250 - y0) / (value - y0) * (t - x0) WHEN value = 250 THEN x0 ELSE t END AS c FROM l WHERE (value > 250) <> (y0 > 250)),
p AS (SELECT session, channel, c AS start, lead(c) OVER v AS stop, up, lead(up) OVER v AS nup FROM x WINDOW v AS (PARTITION BY session, channel ORDER BY c)),
q AS (SELECT *, CASE WHEN start - lag(stop) OVER z <= 3600 THEN 0 ELSE 1 END AS fresh FROM p WHERE up AND nup = false WINDOW z AS (PARTITION BY session, channel ORDER BY start)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY session, channel ORDER BY start) AS k FROM q)
SELECT session, channel, round(min(start), 6) AS start, round(max(stop), 6) AS stop FROM g GROUP BY session, channel, k HAVING max(stop) - min(start) >= 60"""


@register("grasp_events", GRASPS)
def grasp_events(spark, d):
    c = W.threshold_crossings(V.signals(spark, d), 250.0)
    return W.grasp_events(c, merge_gap=3600.0, min_time=60.0).withColumns(r("start", "stop"))


@register("local_extrema", SIG + f""", l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig WINDOW w AS {BY})
SELECT session, channel, t, value, CASE WHEN value < a AND value < b THEN 'min' ELSE 'max' END AS kind FROM l WHERE (value < a AND value < b) OR (value > a AND value > b)""")
def local_extrema(spark, d):
    return W.local_extrema(V.signals(spark, d))


@register("moving_average", SIG + f""", n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY session, channel) AS n FROM sig WINDOW w AS {BY}),
j AS (SELECT a.session, a.channel, a.t, b.value FROM n a, (SELECT unnest(range(-2, 3)) AS k) o JOIN n b ON b.session = a.session AND b.channel = a.channel AND b.i = least(greatest(a.i + o.k, 1), a.n))
SELECT session, channel, t, round(avg(value), 6) AS smoothed FROM j GROUP BY ALL""")
def moving_average(spark, d):
    return W.moving_average(V.signals(spark, d), 5, ["session", "channel"]).select("session", "channel", "t", F.round("smoothed", 6).alias("smoothed"))


@register("median_filter", SIG + f""", l AS (SELECT *, coalesce(lag(value) OVER w, 0) AS a, coalesce(lead(value) OVER w, 0) AS b FROM sig WINDOW w AS {BY})
SELECT session, channel, t, list_sort([a, value, b])[2] AS smoothed FROM l""")
def median_filter(spark, d):
    return W.median_filter(V.signals(spark, d), ["session", "channel"]).select("session", "channel", "t", "smoothed")


@register("fill_gaps", SIG + """, s AS (SELECT session, channel, t, CASE WHEN floor(value) % 3 > 0 THEN value END AS v FROM sig)
SELECT session, channel, t, round(CASE WHEN v IS NOT NULL THEN v WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END, 6) AS filled FROM (
SELECT *, last_value(v IGNORE NULLS) OVER p AS y0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS x0,
first_value(v IGNORE NULLS) OVER q AS y1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER q AS x1 FROM s
WINDOW p AS (PARTITION BY session, channel ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY session, channel ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def fill_gaps(spark, d):
    s = V.signals(spark, d).withColumn("value", F.when(F.floor("value") % 3 > 0, F.col("value")))
    return W.fill_gaps(s, ["session", "channel"]).select("session", "channel", "t", F.round("filled", 6).alias("filled"))


INTERP = SIG + """, g AS (SELECT DISTINCT session, channel, k * 86400::DOUBLE AS t FROM (SELECT DISTINCT session, channel FROM sig), (SELECT unnest(range(31)) AS k)),
a AS (SELECT g.*, max(s.t) AS x0, arg_max(s.value, s.t) AS y0 FROM g LEFT JOIN sig s ON s.session = g.session AND s.channel = g.channel AND s.t <= g.t GROUP BY ALL),
b AS (SELECT g.*, min(s.t) AS x1, arg_min(s.value, s.t) AS y1 FROM g LEFT JOIN sig s ON s.session = g.session AND s.channel = g.channel AND s.t >= g.t GROUP BY ALL)
"""


@register("interpolate", INTERP + """SELECT session, channel, t, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (t - x0) * (y1 - y0) / (x1 - x0) END, 6) AS value FROM a JOIN b USING (session, channel, t)""")
def interpolate(spark, d):
    s = V.signals(spark, d)
    grid = s.select("session", "channel").distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: k * 86400.0)))
    return W.interpolate(grid, s, ["session", "channel"]).select("session", "channel", "t", F.round("value", 6).alias("value"))


@register("downsample_at_times", SIG + """, g AS (SELECT session, channel, k * 86400::DOUBLE AS c FROM (SELECT DISTINCT session, channel FROM sig), (SELECT unnest(range(31)) AS k)),
m AS (SELECT g.session, g.channel, c, median(value) AS v FROM g JOIN sig s ON s.session = g.session AND s.channel = g.channel AND s.t >= c - 43200 AND s.t < c + 43200 GROUP BY ALL)
SELECT session, channel, c AS t, round(coalesce(v, 0), 6) AS value FROM g LEFT JOIN m USING (session, channel, c)""")
def downsample_at_times(spark, d):
    s = V.signals(spark, d)
    grid = s.select("session", "channel").distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: k * 86400.0)))
    return W.downsample_at_times(s, grid, ["session", "channel"]).withColumns(r("value"))


@register("normalised_velocity", SIG + f""", v AS (SELECT session, channel, t, abs(value - lag(value) OVER w) AS s FROM sig WINDOW w AS {BY}), u AS (SELECT * FROM v WHERE s IS NOT NULL),
z AS (SELECT session, t, coalesce((s - min(s) OVER c) / nullif(max(s) OVER c - min(s) OVER c, 0), 0) AS s FROM u WINDOW c AS (PARTITION BY session, channel)),
q AS (SELECT session, t, sum(s) AS s FROM z GROUP BY ALL) SELECT session, t, round(s / max(s) OVER (PARTITION BY session), 6) AS speed FROM q""")
def normalised_velocity(spark, d):
    return W.normalised_velocity(V.signals(spark, d)).withColumns(r("speed"))


@register("lag_pairs", SIG + f", l AS (SELECT session, channel, t, value AS y, lead(value, 3) OVER w AS x_lagged FROM sig WINDOW w AS {BY}) SELECT * FROM l WHERE x_lagged IS NOT NULL")
def lag_pairs(spark, d):
    s = V.signals(spark, d).select("session", "channel", "t", F.col("value").alias("x"), F.col("value").alias("y"))
    return W.lag_pairs(s, 3, ["session", "channel"], order="t").select("session", "channel", "t", "y", "x_lagged")


_H = np.exp(-(np.arange(9) ** 2) / 8.0)
HALF = ", ".join(f"({i}, {float(k)!r}::DOUBLE)" for i, k in enumerate(_H / _H.sum()))


@register("causal_smooth", CTE + f""", half(i, k) AS (VALUES {HALF})
SELECT a.session, a.unit_id, a.trial, a.bin::INTEGER AS bin, round(sum(b.n * k), 9) AS rate FROM filled a, half JOIN filled b ON b.session = a.session AND b.unit_id = a.unit_id AND b.trial = a.trial AND b.bin = a.bin - half.i
GROUP BY ALL""")
def causal_smooth(spark, d):
    return W.causal_smooth(_counts(spark, d), 2.0, ["session", "unit_id", "trial"]).select("session", "unit_id", "trial", "bin", F.round("rate", 9).alias("rate"))


XCORR = CTE + """, fo AS (SELECT session, trial, bin, sum(n)::DOUBLE AS force FROM filled GROUP BY ALL),
lg AS (SELECT unnest(range(-3, 4)) AS lag),
j AS (SELECT f.session, r.unit_id, f.trial, lag, force, r.n::DOUBLE AS rate FROM fo f, lg JOIN filled r ON r.session = f.session AND r.trial = f.trial AND r.bin = f.bin + lg.lag),
xc AS (SELECT session, unit_id, trial, lag, covar_pop(force, rate) / nullif(stddev_pop(force) * stddev_pop(rate), 0) AS r FROM j GROUP BY ALL)
"""


def _xcorr(spark, d):
    c = _counts(spark, d)
    force = c.groupBy("session", "trial", "bin").agg(F.sum("n").cast("double").alias("force"))
    rate = c.select("session", "trial", "unit_id", "bin", F.col("n").cast("double").alias("rate"))
    return W.lagged_crosscorrelation(force, rate, range(-3, 4))


@register("lagged_crosscorrelation", XCORR + "SELECT session, unit_id, trial, lag::INTEGER AS lag, round(r, 6) + 0 AS r FROM xc")
def lagged_crosscorrelation(spark, d):
    return _xcorr(spark, d).withColumns(r("r"))


@register("neuron_force_xcorr", XCORR + "SELECT session, unit_id, lag::INTEGER AS lag, round(avg(r), 6) + 0 AS r, count(r) AS n_trials FROM xc GROUP BY ALL")
def neuron_force_xcorr(spark, d):
    return W.neuron_force_xcorr(_xcorr(spark, d)).withColumns(r("r"))


@register("peak_lag", XCORR + """, m AS (SELECT session, unit_id, lag, avg(r) AS r FROM xc GROUP BY ALL)
SELECT session, unit_id, lag::INTEGER AS peak_lag, round(r * r, 6) AS peak_r2 FROM m WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, unit_id ORDER BY r * r DESC, lag) = 1""")
def peak_lag(spark, d):
    return W.peak_lag(W.neuron_force_xcorr(_xcorr(spark, d))).withColumns(r("peak_r2"))


@register("sustained_above_chance", CTE + """, a AS (SELECT session, bin, sum(n) AS accuracy FROM filled GROUP BY ALL), h AS (SELECT *, (accuracy > 2)::INTEGER AS hit FROM a),
g AS (SELECT *, row_number() OVER w - sum(hit) OVER w AS run FROM h WINDOW w AS (PARTITION BY session ORDER BY bin)), s AS (SELECT session, run, sum(hit) AS k FROM g GROUP BY ALL)
SELECT session, (max(k) * 60)::DOUBLE AS sustained FROM s GROUP BY session""")
def sustained_above_chance(spark, d):
    a = _counts(spark, d).groupBy("session", "bin").agg(F.sum("n").alias("accuracy")).withColumn("chance", F.lit(2))
    return W.sustained_above_chance(a, ["session"], 60.0)


@register("merge_timeline", "SELECT o_orderkey, coalesce(sum(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM orders")
def merge_timeline(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 1000).alias("n_samples"))
    return W.merge_timeline(o).select("o_orderkey", "offset")


@register("ttl_edges", """WITH e AS (SELECT user_id AS session, event_id, event_type FROM events),
a AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY event_id) - 1 AS k FROM e WHERE event_type = 'signup'),
b AS (SELECT session, event_id, row_number() OVER (PARTITION BY session ORDER BY event_id) - 1 AS k FROM e WHERE event_type = 'purchase')
SELECT a.session, a.k::INTEGER AS pulse_idx, a.event_id AS start, b.event_id AS stop FROM a JOIN b USING (session, k) WHERE b.event_id >= a.event_id""")
def ttl_edges(spark, d):
    e = V.table(spark, d, "events").where("event_type IN ('signup', 'purchase')")
    return W.ttl_edges(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("sample_number"), (F.col("event_type") == "signup").cast("int").alias("state")))


@register("reanchor_segments", """WITH p AS (SELECT o_custkey AS session, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
s AS (SELECT *, sum(CASE WHEN i IN (2, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY i)::BIGINT AS segment FROM p)
SELECT session, o_orderkey, segment, (row_number() OVER (PARTITION BY session ORDER BY i) - 1)::INTEGER AS trial_pos FROM s WHERE i <> 3""")
def reanchor_segments(spark, d):
    p = J.numbered(V.table(spark, d, "orders").select(F.col("o_custkey").alias("session"), "o_orderkey"), ["session"], ["o_orderkey"], "pulse_idx")
    return W.reanchor_segments(p, [2], skipped=[3]).select("session", "o_orderkey", "segment", "trial_pos")


# Statistics and summaries

@register("data_stats", """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, median(l_extendedprice) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr, round(quantile_cont(l_extendedprice, 0.025), 4) AS low, round(quantile_cont(l_extendedprice, 0.975), 4) AS high
FROM lineitem GROUP BY 1""")
def data_stats(spark, d):
    return A.data_stats(V.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumns(r("mean", "std", "q1", "q3", "iqr", "low", "high", places=4))


@register("normalize_rows_to_max", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS normalised FROM orders")
def normalize_rows_to_max(spark, d):
    return A.normalize_rows_to_max(V.table(spark, d, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("normalised", 9).alias("normalised"))


@register("condition_success_matrix", "SELECT p_size, p_brand, round(avg((p_retailprice > 1000)::INTEGER), 9) AS success_rate, count(*) AS n FROM part GROUP BY ALL")
def condition_success_matrix(spark, d):
    p = V.table(spark, d, "part").withColumn("success", (F.col("p_retailprice") > 1000).cast("int"))
    return A.condition_success_matrix(p, ["p_size", "p_brand"]).withColumns(r("success_rate", places=9))


PERF = "WITH b AS (SELECT o_orderdate::DATE AS date, count(*) AS total, sum((o_orderstatus <> 'F')::INTEGER)::BIGINT AS correct FROM orders GROUP BY 1)"


def _performance(spark, d):
    o = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_orderstatus") != "F").cast("int").alias("success"))
    return A.performance_by_date(o)


@register("performance_by_date", PERF + "SELECT *, total - correct AS incorrect, round(correct * 100.0 / total, 6) AS percent FROM b")
def performance_by_date(spark, d):
    return _performance(spark, d).withColumns(r("percent"))


@register("cumulative_performance", PERF + """SELECT date, sum(total) OVER w::BIGINT AS total_to_date, sum(correct) OVER w::BIGINT AS correct_to_date FROM b
WINDOW w AS (PARTITION BY year(date) ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def cumulative_performance(spark, d):
    p = _performance(spark, d).withColumn("year", F.year("date"))
    return A.cumulative_performance(p, days=10, keys=["year"]).select("date", "total_to_date", "correct_to_date")


@register("timepoint_coverage", f"""WITH p AS ({V.PROTOCOL}) SELECT session, round(avg((reward > 0 AND reach_ms > 5000)::INTEGER), 9) AS has_reach, count(*) AS n FROM p GROUP BY 1""")
def timepoint_coverage(spark, d):
    p = V.protocol_log(spark, d).withColumn("reach", F.when((F.col("reward") > 0) & (F.col("reach_ms") > 5000), F.col("reach_ms")))
    return A.timepoint_coverage(p, ["reach"]).withColumns(r("has_reach", places=9))


@register("processing_status", """WITH m AS (SELECT l_returnflag AS session, l_linestatus AS stage, CASE WHEN l_quantity > 5 THEN l_quantity END AS i, CASE WHEN l_quantity > 15 THEN l_quantity + l_linenumber - 3 END AS o FROM lineitem)
SELECT session, stage, count(*) FILTER (WHERE i IS NULL) AS neg, count(*) FILTER (WHERE i IS NOT NULL AND o IS NULL) AS zer, count(*) FILTER (WHERE o < i) AS pos, count(*) FILTER (WHERE o >= i) AS cor, count(*) AS n FROM m GROUP BY ALL""")
def processing_status(spark, d):
    q = F.col("l_quantity")
    m = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("session"), F.col("l_linestatus").alias("stage"), F.when(q > 5, q).alias("input_time"), F.when(q > 15, q + F.col("l_linenumber") - 3).alias("output_time"))
    return A.processing_status(m)


@register("mode_lag", "SELECT l_suppkey, l_quantity AS mode_lag FROM (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1")
def mode_lag(spark, d):
    return A.mode_lag(V.table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


@register("static_pose", "SELECT l_returnflag AS channel, median(m) AS pose FROM (SELECT l_returnflag, l_suppkey, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL) GROUP BY 1")
def static_pose(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("channel"), F.col("l_suppkey").alias("trial"), F.col("l_extendedprice").alias("value"))
    return A.static_pose(li)


RANKS = """WITH v AS (SELECT l_linestatus AS k, l_returnflag AS g, l_extendedprice AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')),
n AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rk FROM v)
"""


@register("mann_whitney", RANKS + """SELECT k, u, n1, n2, round(1 - 2 * u / (n1 * n2), 9) AS r FROM (SELECT k, sum(CASE WHEN g = 'A' THEN rk ELSE 0 END) - n1 * (n1 + 1) / 2 AS u, any_value(n1) AS n1, count(*) - any_value(n1) AS n2 FROM
(SELECT *, count(*) FILTER (WHERE g = 'A') OVER (PARTITION BY k) AS n1 FROM n) GROUP BY k, n1)""")
def mann_whitney(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("k"), "l_returnflag", "l_extendedprice")
    return X.mann_whitney(li, ["k"], "l_returnflag", "l_extendedprice", "A", "R").select("k", "u", "n1", "n2", F.round("r", 9).alias("r"))


@register("signed_rank", """WITH v AS (SELECT l_returnflag AS k, l_extendedprice - l_quantity * 1500 AS x FROM lineitem), z AS (SELECT * FROM v WHERE x <> 0),
n AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY abs(x)) + (count(*) OVER (PARTITION BY k, abs(x)) - 1) / 2.0 AS rk FROM z)
SELECT k, least(sum(CASE WHEN x > 0 THEN rk ELSE 0 END), sum(CASE WHEN x < 0 THEN rk ELSE 0 END)) AS w, round(sum(CASE WHEN x > 0 THEN rk ELSE -rk END) / sum(rk), 9) AS r, count(*) AS n FROM n GROUP BY k""")
def signed_rank(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1500).alias("b"))
    return X.signed_rank(li, ["k"], "a", "b").select("k", "w", F.round("r", 9).alias("r"), "n")


@register("kruskal", """WITH v AS (SELECT l_linestatus AS k, l_returnflag AS g, l_quantity AS x FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY k, x) AS t, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rk FROM v),
s AS (SELECT k, g, sum(rk) AS r, count(*) AS c, sum(t * t - 1.0) AS ties FROM n GROUP BY ALL), a AS (SELECT k, sum(r * r / c) AS q, sum(c)::DOUBLE AS n, sum(ties) AS ties, count(*) AS groups FROM s GROUP BY k)
SELECT k, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, groups, n::BIGINT AS n FROM a""")
def kruskal(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("k"), "l_returnflag", "l_quantity")
    return X.kruskal(li, ["k"], "l_returnflag", "l_quantity").select("k", F.round("h", 6).alias("h"), "groups", "n")


@register("scores", """SELECT l_returnflag AS k, round(corr(l_extendedprice, l_quantity * 1500), 9) AS r, round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) AS rmse,
round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 9) AS r2, count(*) AS n FROM lineitem GROUP BY 1""")
def scores(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return X.scores(li, ["k"], "l_extendedprice", "p").withColumns(r("r", "r2", places=9) | r("rmse", places=4))


@register("poisson_pr2", """WITH v AS (SELECT l_returnflag AS k, l_quantity AS y, 0.5 * l_quantity + 12 AS mu, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem)
SELECT k, round(pr2, 9) AS pr2, n, round(1 - (1 - pr2) * (n - 1) / (n - 2), 9) AS adj_pr2 FROM (SELECT k, count(*) AS n, 1 - sum(y * ln(y / mu) - (y - mu)) / sum(y * ln(y / m) - (y - m)) AS pr2 FROM v GROUP BY k)""")
def poisson_pr2(spark, d):
    li = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("y"), (F.col("l_quantity") * 0.5 + 12).alias("mu"))
    return X.poisson_pr2(li, ["k"], "y", "mu").withColumns(r("pr2", "adj_pr2", places=9))


@register("effect_size", """WITH nl AS (SELECT l_suppkey AS k, l_extendedprice AS v FROM lineitem), o AS (SELECT s_suppkey AS k, abs(s_acctbal) * 5 AS o FROM supplier),
j AS (SELECT nl.*, o.o, median(v) OVER (PARTITION BY k) AS med FROM nl JOIN o USING (k))
SELECT k, o AS observed, round((o - avg(v)) / stddev_pop(v), 6) AS z, round((o - any_value(med)) / (median(abs(v - med)) * 1.4826), 6) AS robust_z, round(count(*) FILTER (WHERE v < o) * 100.0 / count(*), 6) AS percentile,
round((count(*) FILTER (WHERE v >= o) + 1.0) / (count(*) + 1.0), 9) AS p, count(*) AS n FROM j GROUP BY k, o""")
def effect_size(spark, d):
    null = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("value"))
    seen = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.abs("s_acctbal") * 5).alias("value"))
    return X.effect_size(seen, null, ["k"]).withColumns(r("z", "robust_z", "percentile") | r("p", places=9))


@register("chance_level", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.95), 4) AS chance FROM lineitem GROUP BY 1")
def chance_level(spark, d):
    return X.chance_level(V.table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice").withColumns(r("chance", places=4))


@register("compare_traces", """SELECT l_suppkey, round(avg(abs(a - b)), 4) AS mad, round(avg(abs(a - b)) / max(b), 9) AS mad_of_max, round(sum(abs(a - b)), 2) AS integrated, round(sqrt(sum((a - b) ** 2)), 4) AS rms,
round(sqrt(sum((a - b) ** 2)) / (sum(b) / 5), 9) AS rms_normalised, round(corr(a, b), 6) AS r FROM (SELECT l_suppkey, l_extendedprice AS a, l_quantity * 1500 AS b FROM lineitem) GROUP BY 1""")
def compare_traces(spark, d):
    li = V.table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("auto"), (F.col("l_quantity") * 1500).alias("manual"))
    return A.compare_traces(li, ["l_suppkey"]).withColumns(r("mad", "rms", places=4) | r("integrated", places=2) | r("mad_of_max", "rms_normalised", places=9) | r("r")).drop("r2")


@register("histogram", "SELECT l_returnflag, least(floor((l_discount - 0.053 + 0.1) / 0.02), 9)::INTEGER AS bin, count(*) AS n FROM lineitem WHERE abs(l_discount - 0.053) <= 0.1 GROUP BY ALL")
def histogram(spark, d):
    li = V.table(spark, d, "lineitem").withColumn("x", F.col("l_discount") - 0.053)
    return X.histogram(li, ["l_returnflag"], "x", 0.1, 10)


@register("natural_sort_key", "SELECT DISTINCT p_brand, lower(regexp_extract(p_brand, '^[^0-9]*')) || lpad(regexp_extract(p_brand, '[0-9]+'), 20, '0') AS key FROM part")
def natural_sort_key(spark, d):
    return V.table(spark, d, "part").select("p_brand").distinct().withColumn("key", K.natural_key("p_brand"))


SETS = """SELECT n_nationkey AS condition, CASE WHEN c AND s THEN 'both' WHEN c THEN 'a' ELSE 'b' END AS "where" FROM (SELECT n_nationkey, n_nationkey IN (SELECT c_nationkey FROM customer) AS c,
n_nationkey IN (SELECT s_nationkey FROM supplier) AS s FROM nation) WHERE c OR s"""


@register("condition_sets", SETS)
def condition_sets(spark, d):
    return condition_sets_every(spark, d)


@register("condition_sets_every", SETS)
def condition_sets_every(spark, d):
    a = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("condition"))
    return K.condition_sets(a, V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("condition")))


@register("union_of_times", f"WITH s AS ({V.SPIKES}) SELECT DISTINCT session, t FROM s WHERE unit_id IN ('click', 'view')")
def union_of_times(spark, d):
    s = V.spikes(spark, d)
    return K.union_of_times(s.where("unit_id = 'click'"), s.where("unit_id = 'view'"))


@register("sample_trials_even", f"WITH t AS ({V.TRIALS}) SELECT session, trial FROM t WHERE trial IN (0, 5, 11, 17, 23)")
def sample_trials_even(spark, d):
    return K.sample_trials(V.trials(spark, d), 5, even=True).select("session", "trial")


# Scalars (C1-C10, F1)

@register("trailing_int", "SELECT DISTINCT source, try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) AS number FROM documents")
def trailing_int(spark, d):
    return V.table(spark, d, "documents").select("source").distinct().withColumn("number", C.trailing_int("source"))


@register("format_p", """SELECT event_id, CASE WHEN p < 0.0001 THEN 'p < 0.0001' WHEN p < 0.001 THEN 'p = ' || printf('%.4f', round(p, 4)) WHEN p < 0.01 THEN 'p = ' || printf('%.3f', round(p, 3)) ELSE 'p = ' || printf('%.2f', round(p, 2)) END AS text
FROM (SELECT event_id, (event_id % 2000) / 65536.0 AS p FROM events)""")
def format_p(spark, d):
    return V.table(spark, d, "events").select("event_id", C.format_p((F.col("event_id") % 2000) / 65536.0).alias("text"))


@register("select_sessions", """SELECT DISTINCT strftime(o_orderdate, '%Y_%m_%d') || '_Set' || (o_orderkey % 3 + 1) AS session, o_orderdate::DATE AS date, (o_orderkey % 3 + 1)::INTEGER AS set_number FROM orders""")
def select_sessions(spark, d):
    o = V.table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy_MM_dd"), F.lit("_Set"), (F.col("o_orderkey") % 3 + 1)).alias("session")).distinct()
    return P.select_sessions(o)


@register("extract_date", "SELECT o_orderkey, o_orderdate::DATE AS date FROM orders")
def extract_date(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "'run_'yyyy.M.d'_calibration'").alias("name"))
    return o.select("o_orderkey", C.extract_date("name").alias("date"))


@register("unit_id_text", "SELECT s_suppkey, s_suppkey::VARCHAR AS text FROM supplier")
def unit_id_text(spark, d):
    return V.table(spark, d, "supplier").select("s_suppkey", C.unit_id_text("s_suppkey").alias("text"))


@register("dup_suffix", "SELECT l_orderkey, l_linenumber, 'trial' || l_orderkey || CASE WHEN l_linenumber > 1 THEN '_' || (l_linenumber - 1) ELSE '' END AS name FROM lineitem")
def dup_suffix(spark, d):
    li = V.table(spark, d, "lineitem").withColumn("dup", F.col("l_linenumber") - 1)
    return li.select("l_orderkey", "l_linenumber", C.dup_suffix("l_orderkey", "dup").alias("name"))


@register("condition_label", "SELECT p_partkey, 'aperture=' || p_size || ', tilt=' || p_brand AS label FROM part")
def condition_label(spark, d):
    m = F.create_map(F.lit("tilt"), "p_brand", F.lit("targetForce"), F.lit("5"), F.lit("aperture"), F.col("p_size").cast("string"))
    return V.table(spark, d, "part").withColumn("m", m).select("p_partkey", C.condition_label("m").alias("label"))


@register("attach_condition", "SELECT l_orderkey, l_linenumber, p_size AS condition FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def attach_condition(spark, d):
    li = V.table(spark, d, "lineitem").withColumn("object_id", F.col("l_partkey"))
    parts = V.table(spark, d, "part").withColumn("object_id", F.col("p_partkey"))
    return J.attach_condition(li, parts, "p_size", ("object_id",)).select("l_orderkey", "l_linenumber", "condition")
