"""Near copies of the pipeline's stage, against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from motorspark.llm import jaccard, simhash


def roots(rows):
    """The smallest id of each group of texts with five-word similarity of 0.8 or SimHash distance within 2."""
    def grams(t):
        w = re.split(r"[ \t\n]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    root, made = {i: i for i, _ in rows}, {i: (grams(t), simhash.fingerprint(t)) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = 0
    for i, (a, p) in made.items():
        for j, (b, q) in made.items():
            close = (p ^ q).bit_count() <= 2
            alike = 5 * len(a & b) >= 4 * len(a | b)
            similar += i < j and alike and not close
            if i < j and (close or alike):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}, similar


@pytest.mark.parametrize(("small", "block"), [(64, 256), (2, 4)])
def test_near_copies_match_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    # Many copies of one text with changes of their own, and a passage that unrelated texts share.
    base = [r.choice(words) for _ in range(200)]
    for i in range(40):
        rows.append((len(rows), " ".join([*base[: 3 * i], "changed", *base[3 * i + 1 :]])))
        rows.append((len(rows), " ".join([*base[:30], *(r.choice(words) for _ in range(40))])))
    want, similar = roots(rows)
    assert similar > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in jaccard.near_copies(docs).collect()} == want
    odd = docs.unionByName(spark.createDataFrame([(None, None), (9001, ""), (9002, "a b"), (9003, "A  b")], docs.schema))
    kept = {x["doc_id"] for x in simhash.keep_one(odd, shingle=5).collect()}
    assert kept == {i for i in set(want.values())} | {9001, 9002}


def test_the_pipelines_stage_drops_a_copy_beyond_two_bits(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    other = [*base[:40], "x", *base[41:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "quite another text with more than five words")], "doc_id long, text string")
    assert (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(" ".join(other))).bit_count() > 2
    assert {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_parities_bound_the_difference():
    g = np.random.default_rng(2)
    for n in (1, 100, 127, 128, 129, 300, 5000):
        a = np.unique(g.integers(-(2**63), 2**63 - 1, n))
        for m in (1, n // 10 + 1, n):
            b = np.unique(np.concatenate((a[m:], g.integers(-(2**63), 2**63 - 1, m + n // 8))))
            if not len(b):
                continue
            x, y = (np.array([jaccard.parities(v)], np.int64).view(np.uint64) for v in (a, b))
            apart, true = int(jaccard._apart(x, y)[0, 0]), len(np.setxor1d(a, b))
            assert apart <= true and (apart - true) % 2 == 0
            if true * 4 < n:
                assert apart > 0.8 * true - 4
