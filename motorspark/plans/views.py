"""The driver's tables seen as tables of the domain.

Events play spikes: a day is a session, an event type a unit, and the time is
in seconds of the day. Hours of a day are its trials. See the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL_S, WINDOW_S = 3600.0, 3000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_us(ts: str) -> Column:
    """Microseconds since midnight, whatever the session's time zone."""
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def month_seconds(ts: str) -> Column:
    """Seconds since the start of 2024, whatever the session's time zone."""
    return (F.date_diff(F.to_date(ts), F.lit("2024-01-01").cast("date")) * F.lit(86_400_000_000) + day_us(ts)) / 1e6


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, unit_id, t."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.to_date("ts").alias("session"), F.col("event_type").alias("unit_id"),
        (day_us("ts") / 1e6).alias("t"),
    )


SPIKES = """SELECT ts::DATE AS session, event_type AS unit_id, (epoch_us(ts) % 86400000000) / 1e6 AS t FROM events"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, trial, start, stop, condition: 24 windows a day, the condition is trial mod 3."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("session")).distinct()
    hours = days.select("session", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("trial"))
    return hours.select(
        "session", "trial", (F.col("trial") * TRIAL_S).alias("start"), (F.col("trial") * TRIAL_S + WINDOW_S).alias("stop"),
        (F.col("trial") % 3).alias("condition"),
    )


TRIALS = """SELECT session, h::INTEGER AS trial, h * 3600.0::DOUBLE AS start, h * 3600.0::DOUBLE + 3000.0 AS stop, (h % 3)::INTEGER AS condition
FROM (SELECT DISTINCT ts::DATE AS session FROM events), (SELECT unnest(range(24)) AS h)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, channel, t, value: event values of a user over the seconds of the month; one value per time."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        F.pmod("user_id", F.lit(20)).alias("session"), F.col("event_type").alias("channel"),
        month_seconds("ts").alias("t"),
    ).agg(F.max("value").alias("value"))


SIGNALS = """SELECT user_id % 20 AS session, event_type AS channel, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, max(value) AS value
FROM events GROUP BY ALL"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, unit_id, depth, label: suppliers of a nation."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("unit_id"), F.col("s_acctbal").alias("depth"),
        F.concat(F.lit(" "), F.when(F.col("s_suppkey") % 3 == 0, "Good").when(F.col("s_suppkey") % 3 == 1, "MUA").otherwise("noise")).alias("label"),
    )


UNITS = """SELECT s_nationkey AS session, s_suppkey AS unit_id, s_acctbal AS depth,
' ' || CASE s_suppkey % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'MUA' ELSE 'noise' END AS label FROM supplier"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor, frame, t, sensels: embeddings as frames of 8 x 8 forces."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").alias("sensor"), F.col("vec_id").alias("frame"), (F.col("vec_id") / 50.0).alias("t"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("sensels"),
    )


FRAMES = """SELECT label AS sensor, vec_id AS frame, vec_id / 50.0 AS t, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS sensels FROM embeddings"""


def protocol_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, trial_num, reward, times in ms: orders of a customer group."""
    o = table(spark, sf_dir, "orders")
    ms = lambda k: (F.col("o_orderkey") * k % 10_000).cast("double")
    return o.select(
        F.pmod("o_custkey", F.lit(50)).alias("session"), F.col("o_orderkey").alias("seq"), F.pmod("o_custkey", F.lit(97)).alias("trial_num"),
        F.when(F.col("o_orderstatus") != "F", 1.0).otherwise(0.0).alias("reward"), ms(1).alias("sync_ms"), ms(7).alias("reach_ms"), ms(13).alias("touch_ms"),
    )


PROTOCOL = """SELECT o_custkey % 50 AS session, o_orderkey AS seq, o_custkey % 97 AS trial_num,
CASE WHEN o_orderstatus <> 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS reward, (o_orderkey % 10000)::DOUBLE AS sync_ms,
(o_orderkey * 7 % 10000)::DOUBLE AS reach_ms, (o_orderkey * 13 % 10000)::DOUBLE AS touch_ms FROM orders"""


def sensor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, trial_num: line items; half of their trial numbers are beyond those of the protocol."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.pmod("l_suppkey", F.lit(50)).alias("session"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.pmod("l_partkey", F.lit(197)).alias("trial_num"),
        F.col("l_extendedprice").alias("started_ms"),
    )


SENSOR = """SELECT l_suppkey % 50 AS session, l_orderkey * 8 + l_linenumber AS seq, l_partkey % 197 AS trial_num, l_extendedprice AS started_ms
FROM lineitem"""
