"""Joins of tables that Spark takes to be smaller than they are go by a shuffle."""

import random

import numpy as np

from motorspark.llm import _io, jaccard, simhash, topk


def watch(monkeypatch, *modules) -> list[str]:
    """Gets the plan of every table that the modules write."""
    plans: list[str] = []
    for m in modules:
        if hasattr(m, "join_counted"):  # the few hot keys are broadcast, which the last test looks at
            monkeypatch.setattr(m, "join_counted", lambda rows, right, keys, n: rows.join(_io.shuffled(right.drop(n)), keys))

        def note(df, name, keep=m.written):
            plans.append(f"{name}\n{df._jdf.queryExecution().executedPlan().toString()}")
            return keep(df, name)

        monkeypatch.setattr(m, "written", note)
    return plans


def test_topk_sends_no_queries_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    plans = watch(monkeypatch, topk)
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    rows[50] = (50, [2.0**21, 3.0, -1.0, 0.5])
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 10)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert "SortMergeJoin" in plans[-1] and not [p for p in plans if "Broadcast" in p]
    assert found.count() == 150


def test_queries_together_find_what_each_finds(monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 16)
    g = np.random.default_rng(3)
    x = g.integers(-40, 40, (700, 5)).astype(np.int64)
    x[300:320] = x[0]
    tree = topk.MTree(x, [[i, 1000 + i] for i in range(len(x))], int((x * x).sum(1).max()))
    asked = [*range(0, 700, 50), 1000]
    q = x[[a % 1000 for a in asked]]
    ids = [*range(700), *range(1000, 1700)]
    scores = q @ np.concatenate((x, x)).T
    want = [sorted(((int(s), i) for s, i in zip(row, ids, strict=True) if i != own), key=lambda p: (-p[0], p[1]))[:7] for row, own in zip(scores, asked, strict=True)]
    assert tree.search_all(q, asked, 7, [-np.inf] * len(q)) == want
    beats = [w[2][0] for w in want]
    assert tree.search_all(q, asked, 7, beats) == [[p for p in w if p[0] >= b] for w, b in zip(want, beats, strict=True)]


def broadcast_joins(plans: list[str]) -> list[str]:
    """Joins by broadcast but those of the texts of verified sets."""
    lines = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    return [line for line in lines if not ("LeftSemi" in line and "doc_id" in line)]


def test_cells_and_links_of_fingerprints_go_by_a_shuffle(spark, monkeypatch):
    plans = watch(monkeypatch, simhash)
    docs = spark.createDataFrame([(i, f"word{i % 7} of a text number {i % 40}") for i in range(80)], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any(p.startswith("simhash-cells") and "SortMergeJoin" in p for p in plans) and any(p.startswith("components-") for p in plans)
    assert not broadcast_joins(plans)
    assert found.count() == 80


def test_shingles_and_their_pairs_go_by_a_shuffle(spark, monkeypatch):
    plans = watch(monkeypatch, simhash, jaccard)
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 9)) for _ in range(40)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(t + " end" for t in texts)])], "doc_id long, text string")
    found = jaccard.near_copies(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not broadcast_joins(plans)
    assert {r["doc_id"] % 20 for r in found.where("doc_id = component_id").collect()} == set(range(20)) and found.where("doc_id > 19 AND component_id <> doc_id - 20").count() == 0


def test_keys_that_are_not_hot_are_shuffled(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    right = rows.selectExpr("k", "k + 1 AS v", "1L AS n")
    met = _io.join_counted(rows, right, ["k"], "n")
    assert "SortMergeJoin" in met._jdf.queryExecution().executedPlan().toString() and met.where("v = k + 1").count() == 20_000
