"""Toxicity: scores against a network written out in plain Python, and the query's folds."""

import math
import random
import zlib

import numpy as np
import pytest

from motorspark.llm import toxicity as T


def gram_buckets(word):
    raw = f"<{word}>".encode()
    out = []
    for n in (3, 5, 7):
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * 1_099_511_628_211 + b) % 2**64
            h = (h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2**64
            out.append(h >> (64 - 14))
    return out


def plain_score(net, text):
    """The score of a text, word by word and state by state."""
    words = T.words_of(text)
    if not words:
        return 0.0
    d, n = net.dense, T.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))

    def gates(word):
        x = np.concatenate((net.words[zlib.crc32(word.encode()) % T.BUCKETS], net.chars[gram_buckets(word)].mean(0)))
        return x @ d["wx"] + d["bx"]

    def run(seq, way):
        part = lambda v, gate: v[(2 * gate + way) * n : (2 * gate + way + 1) * n]
        u = lambda gate: d["u"][way * n : (way + 1) * n, (2 * gate + way) * n : (2 * gate + way + 1) * n]
        h, out = np.zeros(n), []
        for w in seq:
            x = gates(w)
            z = np.array([sig(v) for v in part(x, 0) + h @ u(0)])
            r = np.array([sig(v) for v in part(x, 1) + h @ u(1)])
            c = np.tanh(part(x, 2) + r * (h @ u(2)))
            h = c + z * (h - c)
            out.append(h)
        return out

    logits = []
    for a, b in T.windows(len(words)):
        part = words[a:b]
        both = np.array([np.concatenate(p) for p in zip(run(part, 0), run(part[::-1], 1)[::-1])])
        e = np.exp(both @ d["v"] - (both @ d["v"]).max())
        logits.append(float((e / e.sum()) @ both @ d["w"] + d["b"][0]))
    x = np.array([max(logits), np.mean(logits), math.log(len(logits)), 1.0])
    return sig(float(np.clip(x @ net.calibration, -30, 30)))


def test_scores_equal_the_plain_network():
    net, r = T.Network(5), random.Random(2)
    net.calibration = np.array([0.7, 0.4, -0.2, 0.1])
    words = ["alpha", "b", "Gamma", "é中", "x" * 450, "d_1"]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 2, 11, 24, 25, 36, 37, 100)] + ["", "!!", "one"]
    assert np.allclose(T.Scorer(net).scores(texts), [plain_score(net, t) for t in texts], atol=2e-5)


def test_query(spark, tmp_path):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    rows, labels = [], []
    for i in range(320):
        w = [r.choice(words) for _ in range(r.randint(3, 60))]
        if i % 2:
            w[r.randrange(len(w))] = r.choice(["vilexx", "nastyy"])
        # The last label is no help: it follows the language and the source.
        rows.append((i, " ".join(w), "xx" if i % 2 else "yy", "bad" if i % 2 else "good", "clash", "clash"))
        labels.append((i, 1, i % 2))
    rows += [(900, None, "xx", "bad", "c", "c"), (901, "", "xx", "bad", "c", "c"), (902, "alpha beta", "xx", "bad", "c", "c"), (903, "alpha beta", "yy", "good", "c", "c"), (None, "vilexx", "xx", "bad", "c", "c"), rows[7], (904, "vilexx " + "alpha " * 300_000, "yy", "good", "c", "c")]
    labels += [(0, 1, None), (5000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, predicted string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = {g["doc_id"]: g for g in got}
    assert all(g["held_out"] == (g["doc_id"] is not None and zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got)
    assert all(g["predicted"] == int(g["score"] >= 0.3) and 0 <= g["score"] <= 1 for g in got)
    held = [g for g in got if g["held_out"] and g["doc_id"] < 320]
    assert len(held) > 40 and np.mean([g["predicted"] == g["doc_id"] % 2 for g in held]) > 0.95
    assert by[900]["score"] == by[901]["score"] == 0 and by[902]["score"] == by[903]["score"]
    net = T.train(df.where(T.fold(4) != 2), known.where(T.fold(4) != 2))
    for i in (3, 4, 10, 902):
        assert by[i]["score"] == pytest.approx(plain_score(net, next(x[1] for x in rows if x[0] == i)), abs=1e-4)
    df.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    known.where("false").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert T.op5_toxicity(spark, f"{tmp_path}/none").count() == 0
