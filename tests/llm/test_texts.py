"""License scans, media columns, BPE, line dedup, SimHash: against brute force on small tables."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql.types import LongType, StringType, StructField, StructType

from motorspark.llm import bpe, licenses, line_dedup, simhash

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("kept", StringType()), StructField("fp", StringType()), StructField("ids", StringType())])
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \t\n", "a", "MIT License", "x" * 30_000, "é中😀 <|endoftext|> b", "same line here\nSAME LINE HERE \nshort\n", "same line here\nother words", "\n\n"]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta", "MIT", "license", "apache", "general", "public", "éclair"]
    texts = [" ".join(r.choice(words) + r.choice(["", ",", ".\n"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(ODD + texts + texts[:8])]
    rows += [rows[12], (None, "same line here\nnull id", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def as_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_license_scan(docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    want = []
    for i, t in as_rows(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = sorted((k, v) for p, v in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
        want.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({v for _, v in at}))))
    found = licenses.license_scan(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found))) == sorted(map(str, want))
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in found)
    assert len(licenses.rules()) > 200


def test_license_suppression():
    spans = licenses.scan("Licensed under the Apache License, Version 2.0.")[7]
    assert [s["label"] for s in spans] == ["apache-2.0"]
    r = random.Random(0)
    for _ in range(200):
        found = [(s := r.randint(0, 30), s + r.randint(1, 15), r.choice("ab"), r.randint(0, 3)) for _ in range(12)]
        kept = []
        for d in sorted(found, key=lambda d: (d[3], d[0] - d[1], d[0], d[2])):
            if not any(a <= d[0] and d[1] <= b for a, b, _, _ in kept):
                kept.append(d)
        assert licenses.resolve(found) == sorted(kept)


def test_bpe(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    t = tokenizers.Tokenizer.from_file(path)
    code = bpe.Encoder(path)
    r = random.Random(5)
    texts = [x or "" for _, x in as_rows(docs)] + ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 9000)])) for _ in range(80)) for _ in range(300)]
    for text, ids in zip(texts, code.encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and code.decode(ids) == t.decode(want, skip_special_tokens=False)
    assert {r["doc_id"]: len(r["ids"]) for r in bpe.bpe_tokens(docs).collect()}[1] == 0
    # The pair test says the same as merging both tokens together.
    g = np.random.default_rng(0)
    pairs = g.integers(0, 50_000, (2000, 2))
    ok = code._compatible(pairs[:, 0], pairs[:, 1])
    for (a, b), yes in zip(pairs, ok, strict=True):
        assert yes == (code.merge(code.bytes[a] + code.bytes[b]) == [a, b])


def test_line_dedup(docs):
    rows = as_rows(docs)
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    big = 2**63 - 1
    holders: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(big if i is None else i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == (big if i is None else i)]
        want.append((str(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    got = line_dedup.dedup_lines(docs)
    assert got.columns.count("kept") == 1
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == sorted(want)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in ids:
        for b in ids:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    rows = [(i, t) for i, t in dict(as_rows(docs)).items() if i is not None]
    want = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    comp = brute_components(want)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()}
    assert all(got[i]["fp"] % 2**64 == want[i] and got[i]["component_id"] == comp[i] for i in want)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = {r["doc_id"] for r in simhash.keep_one(docs.where("doc_id is not null")).collect()}
    assert kept == set(comp.values())


def test_crowded_cells(spark, monkeypatch):
    """A ball of near fingerprints gives the same components by both embeddings."""
    monkeypatch.setattr(simhash, "CROWDED", 8)
    g = np.random.default_rng(4)
    base = g.integers(0, 2**63, 4, dtype=np.uint64)
    fps = set(int(b) for b in base)
    for b in base:
        for _ in range(60):
            x = int(b)
            for k in g.choice(64, int(g.integers(1, 5)), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    comp = brute_components({f: f for f in fps})
    df = spark.createDataFrame([(int(np.int64(np.uint64(f))),) for f in fps], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    sign = lambda f: int(np.int64(np.uint64(f)))
    groups: dict = {}
    for f in fps:
        groups.setdefault(found.get(sign(f), sign(f)), set()).add(f)
    brute: dict = {}
    for f in fps:
        brute.setdefault(comp[f], set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))
