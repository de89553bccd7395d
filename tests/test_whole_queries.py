"""Registered queries that take every row, bin, fold and draw."""

import datetime as dt
import random

from pyspark.sql import functions as F

from motorspark.operators import models as O
from motorspark.operators import pairing as J
from motorspark.plans import registry

D = "/root/testdata/sf0.001"


def test_asof_in_buckets_matches_all_pairs(spark):
    r = random.Random(5)
    left = [(r.choice(["a", "b", None]), i, r.choice([None, *range(200)])) for i in range(150)]
    right = [(r.choice(["a", "b", None]), t, r.choice([None, t * 10])) for t in r.sample(range(200), 60)]
    x = spark.createDataFrame(left, "k string, i int, at int")
    y = spark.createDataFrame(right, "k string, date int, v int")
    want = {i: max((v for q, t, v in right if q == k and at is not None and v is not None and t <= at), default=None) for k, i, at in left}
    for bucket in (None, lambda t: F.floor(t / 7)):
        got = J.asof_last(x, y, "v", "at", "date", ["k"], bucket)
        assert got.columns == ["k", "i", "at", "v"] and {g["i"]: g["v"] for g in got.collect()} == want


def test_every_order_has_its_calibration(spark):
    q = registry.queries()
    orders = spark.read.parquet(f"{D}/orders.parquet").collect()
    times = [e["ts"] for e in spark.read.parquet(f"{D}/events.parquet").where("event_type = 'signup'").collect()]
    want = {o["o_orderkey"]: max((t for t in times if t <= dt.datetime.combine(o["o_orderdate"], dt.time()) + dt.timedelta(8400)), default=None) for o in orders}
    customers = {c[0] for c in spark.read.parquet(f"{D}/customer.parquet").select("c_nationkey").distinct().collect()}
    for end in ("", "_every"):
        assert {g["o_orderkey"]: g["calibration"] for g in q[f"asof_calibration{end}"](spark, D).collect()} == want
        assert {g["condition"] for g in q[f"condition_sets{end}"](spark, D).where("`where` <> 'b'").collect()} == customers


def test_fits_take_every_bin_fold_and_draw(spark, monkeypatch):
    q, given = registry.queries(), {}
    for name in ("lda_through_time", "poisson_glm_cv", "kalman_decode_cv", "wiener_decode_cv"):
        monkeypatch.setattr(O, name, lambda rows, *a, _n=name, **k: given.__setitem__(_n, (rows, a, k)))
        q[name](spark, D)
    bins = {r["bin"] for r in given["lda_through_time"][0].select("bin").distinct().collect()}
    assert bins == set(range(max(bins) + 1)) and len(bins) > 6
    assert all("folds" not in k or k["folds"] == 5 for _, _, k in given.values())



def test_nulls_have_every_draw_of_every_surrogate_and_method(spark):
    n = registry.queries()["surrogate_null"](spark, D)
    counts = {(r["surrogate"], r["method"], r["direction"]): (r["n"], r["draws"]) for r in n.groupBy("surrogate", "method", "direction").agg(F.count_distinct("session").alias("n"), F.count_distinct("draw").alias("draws")).collect()}
    sessions = n.select("session").distinct().count()
    assert len(counts) == 4 * 5 and set(counts.values()) == {(sessions, 200)}
