"""Importance resampling against zlib and a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorspark.llm import resampling as R

SCHEMA = "doc_id long, text string, n_words string, weight string, _rank string"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs(text, low, high):
    w = words(text)
    return [" ".join(w[k : k + n]).encode() for n in range(low, high + 1) for k in range(len(w) - n + 1)]


def plain(rows, target, percent=10, min_words=20, buckets=10_000, low=1, high=1, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in runs(text, low, high):
                counts[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        f = runs(text, low, high)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((k for k in range(len(rows)) if len(words(rows[k][1])) >= min_words), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for place, k in enumerate(able[: percent * len(able) // 100], 1):
        out[k][4] = place
    return sorted(map(tuple, out), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    make = lambda n: " ".join(r.choice(["alpha", "Beta", "gamma2", "éclair", "中文", "x" * 40, "the"]) + r.choice(["", ",", "\n", "."]) for _ in range(n))
    out = [(i, make(r.choice([0, 1, 19, 20, 21, 60, 300]))) for i in range(300)]
    out += [(300, None), (301, ""), (302, " \t.,"), (None, make(30)), (10**17 + 1, make(40)), (303, "w" * 400_000 + " " + make(30)), (304, "é" * 600_000)]
    return out + [(400 + i, out[7][1]) for i in range(20)] + out[5:8] + [out[5]] * 40


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"low": 1, "high": 3, "percent": 37, "buckets": 97, "min_words": 0, "seed": 5}])
def test_every_row_against_a_plain_version(spark, rows, options):
    target = ["alpha beta the the", "Éclair, gamma2", None, ""]
    docs = spark.createDataFrame([(*x, "clash", "clash", "clash") for x in rows], SCHEMA)
    found = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **options)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got, want = collected(found), plain(rows, target, **options)
    # Rows equal in score and id are ranked in any order, so of these only the set of ranks counts.
    key = lambda x: sorted(map(str, ((*r[:4], r[4] is None) for r in x)))
    assert key(got) == key(want)
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    by = lambda x: {r[:4]: sorted(q[4] or 0 for q in x if q[:4] == r[:4]) for r in x}
    assert by(got) == by(want)


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    assert R.resample(none, none).collect() == []
    docs = spark.createDataFrame([(*x, None, None, None) for x in rows[:50]], SCHEMA)
    assert collected(R.resample(docs, none)) == plain(rows[:50], [])


def test_crcs_by_cancellation():
    g = np.random.default_rng(0)
    data = g.integers(0, 256, 5000).astype(np.uint8)
    crc = R.running(data)
    a = g.integers(0, 5000, 3000)
    b = np.minimum(a + g.choice([0, 1, 2, 31, 700, 4999], 3000), 5000)
    got = crc[b] ^ R.shifted(crc[a] ^ R.ALL, b - a) ^ R.ALL
    assert all(int(x) == zlib.crc32(data[i:j].tobytes()) for x, i, j in zip(got, a, b, strict=True))
    assert R.running(np.zeros(0, np.uint8)).tolist() == [0] and len(R.features([], 1, 2)[0]) == 0


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "id % 7 AS v", "CASE WHEN id < 2000 THEN 1 ELSE id END AS same")
    found = R.ranked(rows, [F.col("v").desc(), F.col("same").asc()], "place").collect()
    assert sorted(r["place"] for r in found) == list(range(1, 5001))
    placed = sorted(found, key=lambda r: r["place"])
    assert all((-a["v"], a["same"]) <= (-b["v"], b["same"]) for a, b in zip(placed, placed[1:], strict=False))
