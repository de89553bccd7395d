"""Sharding against a plain recursive k-d tree."""

import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from motorspark.llm import sharding
from motorspark.llm._io import with_slots

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("size", IntegerType()), StructField("shard", IntegerType())])


def split(rows, first, shards, used):
    """(row, shard) by plain recursion: the widest dimension, and the boundary of cells nearest to the goal."""
    if shards == 1:
        return [(r, first) for r in rows]
    total, best = sum(r["size"] for r in rows), None
    for i, d in enumerate(sharding.DIMS):
        mean = sum(r[f"x_{d}"] * r["size"] for r in rows) / total
        width = sum(r[f"x_{d}"] ** 2 * r["size"] for r in rows) / total - mean**2
        if best is None or round(width, 9) > best[0]:
            best = (round(width, 9), i)
    d, goal = sharding.DIMS[best[1]], total * (shards // 2) / shards
    used.append(d)
    sums = {}
    for r in rows:
        sums[r[f"c_{d}"]] = sums.get(r[f"c_{d}"], 0) + r["size"]
    run, cut = 0, None
    for c in sorted(sums):
        if run + sums[c] >= goal:
            cut = c if run + sums[c] - goal <= goal - run else c - 1
            break
        run += sums[c]
    a = shards // 2
    return split([r for r in rows if r[f"c_{d}"] <= cut], first, a, used) + split([r for r in rows if r[f"c_{d}"] > cut], first + a, shards - a, used)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    langs = ["en"] * 4 + ["de", "fr", None]
    rows = [(i, "x" * int(2 ** r.uniform(0, 10)) if i % 7 else "same text", r.choice(langs), "hot" if i % 3 else f"s{i % 50}", 1, 2) for i in range(4000)]
    return spark.createDataFrame([*rows, rows[5], (None, None, None, None, 1, 2), (5000, "", "", "", 1, 2)], SCHEMA)


def test_tree_equals_plain_recursion(docs):
    rows = [r.asDict() for r in sharding.points(docs, 24).collect()]
    used = []
    want = sorted((str(r["doc_id"]), r["text_crc32"], s) for r, s in split(rows, 0, 24, used))
    got = sharding.shard_by_bytes(docs, 24)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard"]
    assert sorted((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in got.collect()) == want
    assert len(set(used)) >= 3, used
    sums = {}
    for r in got.collect():
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= max(r["size"] for r in rows)


def test_slots(docs):
    by = {}
    for x in with_slots(sharding.shard_by_bytes(docs, 24), "shard", ["doc_id", "text_crc32", "size"], "slot").collect():
        by.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_cells_follow_the_values(docs):
    rows = sharding.points(docs, 24).collect()
    assert sum(r["doc_id"] is None for r in rows) == 1
    for d in sharding.DIMS:
        assert all(0 <= r[f"x_{d}"] <= 1 for r in rows)
        # Rows of one step are divided by a hash; steps follow each other.
        cells = {}
        for r in rows:
            cells.setdefault(int(r[f"x_{d}"] * (sharding.STEPS - 1)), []).append(r[f"c_{d}"])
        order = sorted(cells)
        assert all(max(cells[a]) <= min(cells[b]) for a, b in zip(order, order[1:]))


def test_odd_tables(spark, docs):
    assert sharding.shard_by_bytes(docs.where("false"), 24).count() == 0
    one = sharding.shard_by_bytes(docs.where("doc_id IS NULL").select("doc_id", "text"), 24).collect()
    assert len(one) == 1 and one[0]["size"] == 8 and 0 <= one[0]["shard"] < 24
    long_text = spark.createDataFrame([(1, "y" * 2_000_000), (2, "z"), (3, None)], "doc_id long, text string")
    assert sharding.shard_by_bytes(long_text, 3).count() == 3
