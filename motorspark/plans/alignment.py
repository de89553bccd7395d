"""Queries that compare neural activity with behaviour.

Events play both: rates of event types around each hour are the neural side;
the values of events by type, and by groups of users, are the behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.operators import alignment as L
from motorspark.plans import views as V
from motorspark.plans.demo import BEFORE, CTE, WIDTH, _counts, _rates
from motorspark.plans.registry import register
from motorspark.sources.scratch import stored

DRAWS = 200


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """session, trial (hour), signal, channel, t (of the day), value."""
    e = V.table(spark, d, "events").select("event_type", "user_id", "value", F.to_date("ts").alias("session"), (V.day_us("ts") / 1e6).alias("t"))
    by = F.array(
        F.struct(F.lit("joint_angles").alias("signal"), F.col("event_type").alias("channel")),
        F.struct(F.lit("segment_forces").alias("signal"), F.concat(F.lit("seg"), F.pmod("user_id", F.lit(3))).alias("channel")),
        F.struct(F.lit("torques").alias("signal"), F.concat(F.lit("dof"), F.pmod("user_id", F.lit(2))).alias("channel")),
    )
    rows = e.select("session", F.floor(F.col("t") / V.TRIAL_S).cast("int").alias("trial"), "t", "value", F.explode(by).alias("b"))
    return rows.groupBy("session", "trial", "b.signal", "b.channel", "t").agg(F.max("value").alias("value"))


def _designs(spark: SparkSession, d: str) -> DataFrame:
    """The three comparisons of every day, at every bin of an hour's rates that the hour's signals reach."""
    rates = _rates(spark, d).select("session", "trial", "unit_id", (F.col("trial") * 3600.0 + 1500.0 + F.col("bin") * WIDTH - BEFORE).alias("t"), "rate")
    return L.comparison_designs(rates, _signals(spark, d))


def _moments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    packed = stored(L.pieces(_designs(spark, d)), "alignment-pieces")
    return packed, stored(L.moments(packed), "alignment-moments")


@register("comparison_designs")
def comparison_designs(spark, d):
    return _designs(spark, d)


@register("space_moments", CTE + """, v AS (SELECT session, trial, bin, unit_id AS k, n::DOUBLE AS v FROM filled
UNION ALL SELECT session, trial, bin, '~total', sum(n)::DOUBLE FROM filled GROUP BY ALL UNION ALL SELECT DISTINCT session, trial, bin, '', 1.0::DOUBLE FROM filled),
o AS (SELECT session, k, (row_number() OVER (PARTITION BY session ORDER BY k) - 1)::INTEGER AS i FROM (SELECT DISTINCT session, k FROM v)),
p AS (SELECT a.session, x.i, y.i AS j, sum(a.v * b.v) AS product FROM v a JOIN v b ON a.session = b.session AND a.trial = b.trial AND a.bin = b.bin JOIN o x ON x.session = a.session AND x.k = a.k JOIN o y ON y.session = b.session AND y.k = b.k WHERE x.i <= y.i GROUP BY ALL)
SELECT session, i, j, product FROM p""")
def space_moments(spark, d):
    """Sums of products of one, the counts of each unit in name order, and their total, over all bins."""
    c = _counts(spark, d).groupBy("session", "trial", "bin").agg(F.array_sort(F.collect_list(F.struct("unit_id", F.col("n").cast("double").alias("n")))).alias("u"))
    x = F.transform("u", lambda s: s["n"])
    rows = c.select("session", F.lit("counts").alias("comparison"), "trial", "bin", x.alias("x"), F.array(F.aggregate(x, F.lit(0.0), lambda a, v: a + v)).alias("y"), F.array(F.lit(1)).alias("blocks"))
    sums = L.moments(L.pieces(rows))
    each = sums.select("session", (F.col("p") + F.col("q") + 1).alias("d"), F.posexplode("g").alias("at", "v")).groupBy("session", "d", "at").agg(F.sum("v").alias("product"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.col("d") - 1), lambda i: F.transform(F.sequence(i, F.col("d") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return each.withColumn("_p", pairs[F.col("at")]).select("session", "_p.i", "_p.j", "product")


@register("rrr_curve")
def rrr_curve(spark, d):
    return L.rrr_curve(_moments(spark, d)[1])


@register("rrr_targets")
def rrr_targets(spark, d):
    return L.rrr_targets(_moments(spark, d)[1])


@register("cca_components")
def cca_components(spark, d):
    return L.cca_components(*_moments(spark, d))


@register("cca_loadings")
def cca_loadings(spark, d):
    return L.cca_loadings(_moments(spark, d)[1])


@register("dynamics")
def dynamics(spark, d):
    packed, sums = _moments(spark, d)
    fits = stored(L._preparations(sums, L.KEYS, 1.0), "alignment-preparations")
    return L.operators(L.transitions(packed, fits)).select(*L.KEYS, "rank", "dsa")


@register("compare_spaces")
def compare_spaces(spark, d):
    return L.compare_behaviour(_designs(spark, d), n_null=DRAWS)[0]


@register("surrogate_null")
def surrogate_null(spark, d):
    """All surrogates against all methods, for the widest comparison of each session."""
    return L.compare_behaviour(_designs(spark, d).where("comparison = 'joint_angles_segment_forces'"), null="all", n_null=DRAWS)[1]
