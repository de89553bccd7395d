"""Vectors with components of 2^20 or more, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.llm import topk


def test_large_vectors_are_queries_and_candidates(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows[50] = (50, [2.0**21, 3.0, -1.0, 0.5])
    rows[7] = (7, [0.5, -(2.0**22), 1.0, 1.0])
    rows[8] = (8, [0.25, 2.0**20, 1.0, -1.0])
    whole = {i: [math.floor(256 * e) for e in x] for i, x in rows}
    want = set()
    for q in whole:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    d = spark.createDataFrame([*rows, (900, [math.inf, 0.0, 0.0, 0.0]), (901, None)], "vec_id long, embedding array<double>")
    got = topk.top_k(d, 5, 10).collect()
    assert len(got) == 60 and {(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got} == want


def test_lengths_without_trees_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "LENGTHS", 2)
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range((4, 3, 5, 2)[i % 7 % 4])], "x") for i in range(200)]
    rows[40] = (40, [2.0**21] * len(rows[40][1]), "x")
    whole = {i: [math.floor(256 * e) for e in x] for i, x, _ in rows}
    want = set()
    for q in whole:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = topk.top_k(d, 5, 10).collect()
    assert {(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got} == want and len(got) == len(want)
    assert topk.top_k(d.where("vec_id = 40"), 5, 10).count() == 0


def test_products_of_limbs_are_exact():
    g = np.random.default_rng(0)
    for top in (1.0, 2.0**20, 2.0**31, 2.0**60, 2.0**200):
        x, y = (np.floor((g.random((5, 7)) - 0.5) * top * 4) for _ in "xy")
        want = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in y] for u in x]
        assert topk.exact_products(x, y).tolist() == want
    assert topk.exact_products(np.full((1, 9000), 2.0**20 - 1), np.full((1, 9000), -(2.0**20) + 1)).tolist() == [[-9000 * (2**20 - 1) ** 2]]


def test_many_large_vectors_are_many_tasks(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([-1, 1]) * 2.0 ** r.randint(18, 22), r.uniform(-5, 5), r.uniform(-1, 1)]) for i in range(2000)]
    whole = {i: [math.floor(256 * e) for e in x] for i, x in rows}
    want = set()
    for q in range(0, 2000, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in topk.top_k(d, 5, 50).collect()} == want
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        # A row of pairs: how the blocks' pairs are dealt, by the partition that each result comes from.
        every = d.select("vec_id", F.col("embedding").alias("x"), F.lit(True).alias("large"))
        found = topk._with_large(every, 1, 1, 1.0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    every_pair = 2000 * 16
    assert sum(f["count"] for f in found) == every_pair and max(f["count"] for f in found) <= every_pair // 10


def test_a_score_beyond_a_long_names_its_vectors(spark):
    d = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e200, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="the score of vectors 0 and 1 is beyond a long"):
        topk.top_k(d, 5, 10).collect()
