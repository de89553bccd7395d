"""Top-k, toxicity, packing and language ID on small tables."""

import random
import zlib

import numpy as np
import pytest

from motorspark.llm import langid, packing, topk, toxicity


def brute_top(vectors, k, every):
    out = []
    for q, v in vectors:
        if q % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    for name, value in (("PIVOTS", 3), ("BLOCK", 40), ("PAGE", 8), ("FAN", 3), ("GROUP", 4)):
        monkeypatch.setattr(topk, name, value)
    g = np.random.default_rng(0)
    rows = [(i, [float(x) for x in g.normal(size=6)]) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a hot vector
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([*rows, rows[0], *bad], "vec_id long, embedding array<double>")
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(ints, 5, 10)
    assert topk.top_k(df.where("vec_id < 3"), 5, 10).count() == 2
    assert topk.top_k(df.where("false")).count() == 0


def test_mtree_saves_distances(monkeypatch):
    monkeypatch.setattr(topk, "PAGE", 48)
    g = np.random.default_rng(1)
    centers = g.integers(-200, 200, (20, 8))
    x = np.concatenate([c + g.integers(-4, 5, (100, 8)) for c in centers]).astype(np.int64)
    tree = topk.MTree(x, [[i] for i in range(len(x))], int((x * x).sum(1).max()))
    assert tree.leaf.sum() > 20 and not tree.leaf[tree.first[0] : tree.last[0]].all()  # more than two levels
    asked = x[::97]
    for q in asked:
        got = tree.search(q, None, 5)
        s = x @ q
        assert got == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(len(s)), -s))[:5]]
    assert tree.computed < 0.5 * len(x) * len(asked)


def test_packing_plan():
    r = random.Random(2)
    for case in range(30):
        counts = {n: r.randint(1, 40) for n in r.sample(range(1, 64), r.randint(1, 20))}
        rows, sequences = packing.plan(counts, 64)
        fill: dict[int, list] = {}
        cover: dict[tuple, list] = {}
        for origin, lo, hi, start, length, base, phase, copies, at in rows:
            for k in range(lo, hi):
                i = phase + k - lo
                fill.setdefault(base + i // copies, []).append((at + i % copies * length, length))
                cover.setdefault((origin, k), []).append((start, length))
        assert set(fill) == set(range(sequences))
        for parts in fill.values():
            end = 0
            for at, n in sorted(parts):
                assert at == end
                end += n
            assert end <= 64
        for (origin, _), parts in cover.items():
            end = 0
            for at, n in sorted(parts):
                assert at == end
                end += n
            assert end == origin
        assert len(cover) == sum(counts.values())
        total = sum(n * c for n, c in counts.items())
        assert sequences == -(-total // 64), case


def test_fill_is_closest():
    r = random.Random(4)
    for _ in range(60):
        counts = {n: r.randint(1, 3) for n in r.sample(range(1, 30), 5)}
        first = max(counts)
        got = packing.fill(counts, first, 40)
        assert all(c <= counts[n] for n, c in got.items()) and got[first] >= 1
        sums = {first}
        for n, c in counts.items():
            for _ in range(c - (n == first)):
                sums |= {s + n for s in sums if s + n <= 40}
        assert sum(n * c for n, c in got.items()) == max(sums)


def test_long_white_space():
    got = packing.ids_of(" " * 600_000 + "\n" * 600_000, packing.default_ranks())
    assert len(got) and packing.ids_of("a  b", packing.default_ranks()).tolist() == packing.bpe.encoder(packing.bpe.default_vocabulary()).encode_batch(["a  b"])[0].tolist()


def test_pack_covers_every_id(spark):
    texts = [None, "", "word " * 3000, *(f"text number {i} " * (i % 30) for i in range(80)), *["copy of a text"] * 30]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (5, texts[5], 1)], "doc_id long, text string, tail int")
    got = packing.pack(df).collect()
    enc = packing.tokenizer(packing.default_ranks(), "<|endoftext|>", 50256)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 1024 and sorted(v)[0][0] == 0 for v in by.values())
    for i, t in enumerate(texts):
        if i == 5:
            continue
        ids = np.append(enc.encode_to_numpy(t or "", allowed_special="all"), 0).astype("<u4")
        end = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(ids) and zlib.crc32(ids[end : end + r["length"]].tobytes()) == r["ids_crc32"]
            end += r["length"]
        assert end == len(ids)
    assert sum(r["length"] for r in got if r["doc_id"] == 5) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 5)
    assert packing.pack(df.where("false")).count() == 0


def test_langid(spark):
    r = random.Random(0)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(40))
    kinds = {"aa": ["ba", "ko", "ti"], "bb": ["sch", "ung", "ei"]}
    train = {k: [make(p) for _ in range(60)] for k, p in kinds.items()}
    model = langid.fit(train)
    rows = [(i, make(p), "x", k) for k, p in kinds.items() for i in range(20)]
    junk = "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(300))
    df = spark.createDataFrame([*rows, (100, None, "x", None), (101, "12 ..", "x", None), (102, junk, "x", None)], "doc_id long, text string, score string, k string")
    got = langid.detect(df, model).collect()
    assert all(x["lang_pred"] == x["k"] and not x["rejected"] for x in got if x["k"])
    odd = {x["doc_id"]: x for x in got if not x["k"]}
    assert odd[100]["lang_pred"] == odd[101]["lang_pred"] == "und" and odd[100]["rejected"] and odd[102]["rejected"] and odd[102]["lang_pred"] != "und"
    assert langid.train(df.where("false").withColumnRenamed("k", "lang")) is None
    # Probabilities of what may follow a context sum to 1 at most.
    words = sorted({w for t in train["aa"] for w in t.split()})[:50]
    assert (np.exp(-model.word_scores(words)).sum(0) <= 1 + 1e-6).all()


def test_toxicity_gradients():
    net = toxicity.Network(1)
    feats = toxicity.Features(["some", "words", "to", "read"])
    index, lengths = np.zeros((3, toxicity.WINDOW), np.int64), np.array([4, 2, toxicity.WINDOW])
    index[0, :4], index[1, :2], index[2] = [0, 1, 2, 3], [3, 1], np.arange(toxicity.WINDOW) % 4
    net.dense = {k: v.astype(np.float64) for k, v in net.dense.items()}
    _, projected = net.inputs(feats)
    projected = projected.astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(projected, index, lengths).astype(np.float64)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    logits, cache = net.forward(projected, index, lengths, keep=True)
    grad, by_x = net.backward(cache, (1 / (1 + np.exp(-logits)) - y).astype(np.float64))
    for name, at in (("u", (1, 2)), ("v", (3,)), ("w", (5,)), ("b", (0,))):
        old, step = net.dense[name][at], 1e-2
        net.dense[name][at] = old + step
        up = loss()
        net.dense[name][at] = old - step
        down = loss()
        net.dense[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3)


def test_toxicity_learns(spark):
    r = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    texts, labels = [], []
    for i in range(200):
        w = [r.choice(words) for _ in range(r.randint(3, 90))]
        if i % 2:
            w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
        texts.append(" ".join(w))
        labels.append(i % 2)
    net = toxicity.fit(texts, labels)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "vile " + "alpha " * 30_000, "x")], "doc_id long, text string, score string")
    got = {x["doc_id"]: x for x in toxicity.toxicity(df, net).collect()}
    assert np.mean([got[i]["predicted"] == labels[i] for i in range(200)]) > 0.95
    assert got[900]["score"] == got[901]["score"] == 0.0 and 0 <= got[902]["score"] <= 1
    assert toxicity.windows(100)[-1][1] == 100 and toxicity.windows(0) == []


def test_toxicity_reads_long_runs_whole():
    net = toxicity.Network(3)
    net.words[:] = 0  # only n-grams are left to tell words apart
    a, b = toxicity.Scorer(net).scores(["x" * 300 + "vile", "x" * 300 + "good"])
    assert a != b
    for n in (1, 199, 200, 201, 393, 394, 400, 1000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        pieces = toxicity.words_of(run)
        assert max(map(len, pieces)) <= 200 and all(any(run[i : i + 7] in p for p in pieces) for i in range(n))
    assert toxicity.words_of("A b_c, d") == ["a", "b_c", "d"]
