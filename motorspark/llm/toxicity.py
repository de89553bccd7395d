"""Toxicity: a bidirectional gated recurrent network over overlapping windows.

Every word is read twice: by an embedding of the word and by the mean of the
embeddings of its character n-grams (both hashed). A bidirectional GRU runs
over windows of WINDOW words that overlap by half; attention pools its states
to one logit per window. A document is judged by all of its windows: its
score is a logistic function of their largest logit, their mean and the
logarithm of their number, calibrated on documents the network hasn't seen.

Everything is trained in numpy, on a bounded sample of labelled rows
(``MOST_DOCS`` of each class, none longer than ``MOST_CHARS``). Weights take about 2 MB and are broadcast.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm._io import documents, kept, with_columns
from motorspark.llm.langid import fold

WORD = re.compile(r"\w+")
WINDOW, STRIDE = 24, 12
HIDDEN, WIDTH, BUCKETS = 8, 8, 1 << 14
PRIME, MIX = np.uint64(1_099_511_628_211), np.uint64(0x9E3779B97F4A7C15)
#: Labelled documents of each class that the network is fitted on, at most.
MOST_DOCS = 1000
#: Longest text in characters that the training sample takes; those it takes are read whole.
MOST_CHARS = 40_000
THRESHOLD = 0.3
#: Words whose inputs a worker remembers.
REMEMBERED = 120_000
#: Longest piece of a run of word characters that is one word, and the characters that two successive pieces share (as many as the longest n-gram has bytes).
PIECE, SHARED = 200, 7
BATCH = 2048
#: Windows, and words, that are scored at once; always so many, so that a text's score doesn't depend on its neighbours.
FIXED = 1024


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; a run longer than PIECE is cut into overlapping pieces, each a word of its own."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= PIECE:
        return found
    step = PIECE - SHARED
    return [w[i : i + PIECE] for w in found for i in range(0, max(len(w) - SHARED, 1), step)]


class Features:
    """What is read of each word: its bucket, and the buckets of its character n-grams in one flat array."""

    def __init__(self, words: list[str]):
        self.words = np.fromiter((zlib.crc32(w.encode()) % BUCKETS for w in words), np.int64, len(words))
        raw = [f"<{w}>".encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, raw), np.int64, len(raw)))
        owners, grams = [], []
        for n in (3, 5, 7):
            h = np.zeros(max(len(data) - n + 1, 0), np.uint64)
            for k in range(n):
                h = h * PRIME + data[k : k + len(h)]
            h = (h ^ (h >> np.uint64(29))) * MIX >> np.uint64(64 - 14)
            inside = owner[: len(h)] == owner[n - 1 :] if len(h) else np.zeros(0, bool)
            owners.append(owner[: len(h)][inside])
            grams.append(h[inside].astype(np.uint16))
        every = np.concatenate(owners)
        self.grams = np.concatenate(grams)[np.argsort(every, kind="stable")]
        self.counts = np.bincount(every, minlength=len(words))
        self.starts = np.cumsum(self.counts) - self.counts

    def take(self, chosen: np.ndarray) -> Features:
        part = Features.__new__(Features)
        part.words, part.counts = self.words[chosen], self.counts[chosen]
        part.starts = np.cumsum(part.counts) - part.counts
        part.grams = self.grams[np.arange(part.counts.sum()) + np.repeat(self.starts[chosen] - part.starts, part.counts)]
        return part


def windows(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows over ``n`` words; none for none."""
    if n <= 0:
        return []
    return [(0, min(n, WINDOW))] + [(s, min(n, s + WINDOW)) for s in range(STRIDE, n - WINDOW + STRIDE, STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """The weights, and one pass forth and back. Gates are z, r, n; each for both directions."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *shape, s: r.normal(0, s, shape).astype(np.float32)
        self.words, self.chars = normal(BUCKETS, WIDTH, s=0.1), normal(BUCKETS, WIDTH, s=0.1)
        u = np.zeros((2 * HIDDEN, 6 * HIDDEN), np.float32)
        self.block = np.zeros_like(u)
        for gate in range(3):
            for way in range(2):
                at = slice(way * HIDDEN, (way + 1) * HIDDEN), slice((2 * gate + way) * HIDDEN, (2 * gate + way + 1) * HIDDEN)
                u[at], self.block[at] = r.normal(0, 0.3, (HIDDEN, HIDDEN)), 1
        self.dense = {
            "wx": normal(2 * WIDTH, 6 * HIDDEN, s=0.3), "bx": np.zeros(6 * HIDDEN, np.float32), "u": u,
            "v": normal(2 * HIDDEN, s=0.3), "w": normal(2 * HIDDEN, s=0.3), "b": np.zeros(1, np.float32),
        }
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0])

    def read(self, f: Features) -> np.ndarray:
        """What the network reads for each word."""
        means = np.add.reduceat(self.chars[f.grams], f.starts) / f.counts[:, None].astype(np.float32)
        return np.concatenate((self.words[f.words], means), 1)

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """What the network reads for each word, and the projection to the gates."""
        x = self.read(f)
        return x, x @ self.dense["wx"] + self.dense["bx"]

    def forward(self, projected: np.ndarray, index: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """The logits of windows: ``index`` (windows, WINDOW) points into ``projected``."""
        d, h2 = self.dense, 2 * HIDDEN
        b, t = index.shape
        x = projected[index.T].reshape(t, b, 6, HIDDEN)
        x[:, :, 1::2] = x[::-1, :, 1::2].copy()
        x = x.reshape(t, b, 6 * HIDDEN)
        place = np.arange(t)[:, None]
        live = np.concatenate([np.repeat((place < lengths)[..., None], HIDDEN, 2), np.repeat((t - 1 - place < lengths)[..., None], HIDDEN, 2)], 2).astype(np.float32)
        full = lengths.min() == t
        states = np.zeros((t + 1, b, h2), np.float32)
        saved = []
        for k in range(t):
            h = states[k]
            g = h @ d["u"]
            zr = _sigmoid(x[k, :, : 2 * h2] + g[:, : 2 * h2])
            z, r = zr[:, :h2], zr[:, h2:]
            n = np.tanh(x[k, :, 2 * h2 :] + r * g[:, 2 * h2 :])
            new = n + z * (h - n)
            states[k + 1] = new if full else np.where(live[k] > 0, new, h)
            if keep:
                saved.append((z, r, n, g[:, 2 * h2 :]))
        both = np.concatenate((states[1:, :, :HIDDEN], states[:0:-1, :, HIDDEN:]), 2)
        e = both @ d["v"]
        e[np.arange(t)[:, None] >= lengths] = -1e9
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, both)
        logits = pooled @ d["w"] + d["b"][0]
        return (logits, (states, saved, live, both, a, pooled)) if keep else logits

    def backward(self, cache: tuple, by_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense weights, and of the projected inputs (WINDOW, windows, gates)."""
        states, saved, live, both, a, pooled = cache
        d, h2 = self.dense, 2 * HIDDEN
        t, b = a.shape
        grad = {"w": pooled.T @ by_logit, "b": np.array([by_logit.sum()], np.float32), "u": np.zeros_like(d["u"])}
        by_pooled = by_logit[:, None] * d["w"]
        by_a = np.einsum("bh,tbh->tb", by_pooled, both)
        by_e = a * (by_a - (a * by_a).sum(0))
        by_both = a[..., None] * by_pooled + by_e[..., None] * d["v"]
        grad["v"] = np.einsum("tb,tbh->h", by_e, both)
        by_states = np.concatenate((by_both[..., :HIDDEN], by_both[::-1, :, HIDDEN:]), 2)
        by_x = np.zeros((t, b, 3 * h2), np.float32)
        by_h = np.zeros((b, h2), np.float32)
        for k in range(t - 1, -1, -1):
            z, r, n, gn = saved[k]
            h = states[k]
            by_h = by_h + by_states[k]
            new = by_h * live[k]
            by_n = new * (1 - z) * (1 - n * n)
            by_z = new * (h - n) * z * (1 - z)
            by_r = by_n * gn * r * (1 - r)
            by_g = np.concatenate((by_z, by_r, by_n * r), 1)
            by_x[k] = np.concatenate((by_z, by_r, by_n), 1)
            grad["u"] += h.T @ by_g
            by_h = by_h * (1 - live[k]) + new * z + by_g @ d["u"].T
        grad["u"] *= self.block
        by_x = by_x.reshape(t, b, 6, HIDDEN)
        by_x[:, :, 1::2] = by_x[::-1, :, 1::2].copy()
        return grad, by_x.reshape(t, b, 6 * HIDDEN)


class Trainer:
    """Adam for the dense weights, Adagrad for the rows of the embeddings."""

    def __init__(self, net: Network, features: Features, rate: float = 0.01):
        self.net, self.features, self.rate, self.step = net, features, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.rows = {"words": np.full(BUCKETS, 1e-6, np.float32), "chars": np.full(BUCKETS, 1e-6, np.float32)}

    def _row_update(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        kinds, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(kinds), WIDTH), np.float32)
        np.add.at(total, at, grad)
        self.rows[name][kinds] += (total * total).sum(1)
        getattr(self.net, name)[kinds] -= 0.1 * total / np.sqrt(self.rows[name][kinds])[:, None]

    def learn(self, index: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        net, used = self.net, np.unique(index[np.arange(WINDOW) < lengths[:, None]])
        chosen = self.features.take(used)
        x, projected = net.inputs(chosen)
        place = np.minimum(np.searchsorted(used, index), len(used) - 1)
        logits, cache = net.forward(projected, place, lengths, keep=True)
        by_logit = ((_sigmoid(logits) - labels) * weights / weights.sum()).astype(np.float32)
        grad, by_x = net.backward(cache, by_logit)
        by_p = np.zeros_like(projected)
        np.add.at(by_p, place.T.ravel(), by_x.reshape(-1, by_x.shape[-1]))
        grad["wx"], grad["bx"] = x.T @ by_p, by_p.sum(0)
        by_words = by_p @ net.dense["wx"].T
        self.step += 1
        for k, g in grad.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            m, s = self.m[k] / (1 - 0.9**self.step), self.s[k] / (1 - 0.99**self.step)
            net.dense[k] = (net.dense[k] - self.rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        self._row_update("words", chosen.words, by_words[:, :WIDTH])
        self._row_update("chars", chosen.grams.astype(np.int64), np.repeat(by_words[:, WIDTH:] / chosen.counts[:, None], chosen.counts, 0))


def _index(words: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    ab = np.array(spans, np.int64).reshape(-1, 2)
    lengths = ab[:, 1] - ab[:, 0]
    return words[np.minimum(ab[:, :1] + np.arange(WINDOW), ab[:, 1:] - 1)], lengths


def _logits(net: Network, projected: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([net.forward(projected, index[i : i + BATCH], lengths[i : i + BATCH]) for i in range(0, len(index), BATCH)])


def _fixed(rows: np.ndarray, n: int) -> np.ndarray:
    """``rows`` and copies of the last one, up to a multiple of ``n``."""
    return np.concatenate((rows, np.repeat(rows[-1:], -len(rows) % n, 0)))


def _same_logits(net: Network, projected: np.ndarray, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The logits of windows in blocks of FIXED: sums of products round alike only in matrices of one shape."""
    index, n, lengths = _fixed(index, FIXED), len(index), _fixed(lengths, FIXED)
    return np.concatenate([net.forward(projected, index[i : i + FIXED], lengths[i : i + FIXED]) for i in range(0, len(index), FIXED)])[:n]


def summary(logits: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Largest logit, mean logit and log of the number of windows of each document."""
    counts = np.diff(np.append(starts, len(logits)))
    return np.stack((np.maximum.reduceat(logits, starts), np.add.reduceat(logits, starts) / counts, np.log(counts)), 1).astype(np.float64)


def fit(texts: list[str], labels: list[int], weights: tuple[float, float] = (1.0, 1.0), seed: int = 0, rounds: int = 7) -> Network:
    """Train on documents; ``weights`` of the classes 0 and 1 in the calibration."""
    net, r = Network(seed), np.random.default_rng(seed)
    known: dict[str, int] = {}
    docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
    usable = [i for i, d in enumerate(docs) if len(d)]
    y = np.array(labels, np.float32)
    if not usable or len({labels[i] for i in usable}) < 2:
        net.dense["w"][:] = 0
        net.calibration = np.array([0.0, 0.0, 0.0, 2.0 if usable and labels[usable[0]] else -2.0])
        return net
    features = Features(list(known))
    order = r.permutation(usable)
    held, seen = order[: len(order) // 5], order[len(order) // 5 :]
    cut = {i: _index(docs[i], windows(len(docs[i]))) for i in usable}
    trainer = Trainer(net, features)
    # First every window has its document's label; a few windows of each document are enough.
    for _ in range(2):
        some = [(i, int(k)) for i in r.permutation(seen) for k in r.choice(len(cut[i][0]), min(4, len(cut[i][0])), replace=False)]
        for a in range(0, len(some), 128):
            part = some[a : a + 128]
            trainer.learn(np.stack([cut[i][0][k] for i, k in part]), np.array([cut[i][1][k] for i, k in part]), y[[i for i, _ in part]], np.ones(len(part), np.float32))
    # Then a toxic document answers for its worst window only, a clean one for its worst and another.
    for _ in range(rounds):
        for a in range(0, len(seen), 64):
            part = r.permutation(seen)[:64] if a else seen[:64]
            index, lengths = np.concatenate([cut[i][0] for i in part]), np.concatenate([cut[i][1] for i in part])
            used, place = np.unique(index, return_inverse=True)
            logits = _logits(net, net.inputs(features.take(used))[1], place.reshape(index.shape), lengths)
            starts = np.cumsum([0, *(len(cut[i][0]) for i in part)])
            chosen = [(starts[k] + int(logits[starts[k] : starts[k + 1]].argmax()), y[i]) for k, i in enumerate(part)]
            chosen += [(int(r.integers(starts[k], starts[k + 1])), y[i]) for k, i in enumerate(part) if not y[i]]
            rows = [c for c, _ in chosen]
            trainer.learn(index[rows], lengths[rows], np.array([v for _, v in chosen], np.float32), np.ones(len(rows), np.float32))
    sums = []
    for a in range(0, len(held), 64):
        part = held[a : a + 64]
        index, lengths = np.concatenate([cut[i][0] for i in part]), np.concatenate([cut[i][1] for i in part])
        used, place = np.unique(index, return_inverse=True)
        logits = _logits(net, net.inputs(features.take(used))[1], place.reshape(index.shape), lengths)
        sums.append(summary(logits, np.cumsum([0, *(len(cut[i][0]) for i in part)])[:-1]))
    x, target = np.concatenate(sums), y[held].astype(np.float64)
    net.calibration = _logistic(x, target, np.where(target > 0, weights[1], weights[0]))
    return net


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; weights of x, then the constant."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.1, 0.1, 0.1, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return beta


class Scorer:
    """Scores texts in a worker; remembers the projected inputs of words."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.projected = np.zeros((0, 6 * HIDDEN), np.float32)

    def _projection(self, f: Features) -> np.ndarray:
        x = self.net.read(f)
        blocks = _fixed(x, FIXED)
        return np.concatenate([blocks[i : i + FIXED] @ self.net.dense["wx"] + self.net.dense["bx"] for i in range(0, len(blocks), FIXED)])[: len(x)]

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.known) > REMEMBERED:
            self.known, self.projected = {}, self.projected[:0]
        known, found, seen = self.known, [words_of(t) for t in texts], set()
        for ws in found:
            seen.update(ws)
        if new := list(seen.difference(known)):
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.projected = np.concatenate((self.projected, self._projection(Features(new))))
        docs = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in found]
        cut = [_index(d, windows(len(d))) for d in docs if len(d)]
        if not cut:
            return [0.0] * len(texts)
        index, lengths = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
        # Windows of one length run together, so that the others need no mask.
        order = np.argsort(-lengths, kind="stable")
        logits = np.empty(len(index), np.float32)
        logits[order] = _same_logits(self.net, self.projected, index[order], lengths[order])
        x = summary(logits, np.cumsum([0, *(len(c[0]) for c in cut)])[:-1])
        c = self.net.calibration
        got = iter((1 / (1 + np.exp(-np.clip(x @ c[:3] + c[3], -30, 30)))).tolist())
        return [next(got) if len(d) else 0.0 for d in docs]


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on labelled rows of ``docs`` (doc_id, text): at most MOST_DOCS of each class, by a hash of the text."""
    from pyspark.sql import Window

    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_toxic IN (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A share of the labels first, by a hash of the id that orders only which rows are taken.
    share = F.lit(False)
    for v, n in sizes.items():
        share = share | ((F.col("_toxic") == v) & (F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < min(1_000_000, 2_000_000 * MOST_DOCS // n + 1)))
    some = docs.select("doc_id", "text").join(F.broadcast(known.where(share)), F.col("doc_id") == F.col("_id")).where(F.length("text") <= MOST_CHARS)
    rank = F.row_number().over(Window.partitionBy("_toxic").orderBy(F.xxhash64("text"), "text"))
    rows = some.select("_toxic", "text").withColumn("r", rank).where(F.col("r") <= MOST_DOCS).toLocalIterator()
    got = [(r["text"], int(r["_toxic"])) for r in rows]
    share_of = [max(1, sum(v == k for _, v in got)) for k in (0, 1)]
    weights = tuple(sizes.get(k, 0) / share_of[k] for k in (0, 1))
    scale = sum(w * n for w, n in zip(weights, share_of, strict=True)) / max(1, len(got))
    return fit([t for t, _ in got], [v for _, v in got], tuple(w / max(scale, 1e-9) for w in weights))


def toxicity(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with the columns ``score`` and ``predicted``, which replace columns of these names.

    Null texts and texts without a word have score 0. Equal texts get equal
    scores. Rows are independent: repeated ids and empty tables need no care.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def add(batch):
        scorer, scores, part, size = kept(key, lambda: Scorer(shared.value)), [], [], 0
        for t in batch.column("text").to_pylist():
            part.append(t or "")
            size += len(part[-1])
            if size > 400_000:
                scores += scorer.scores(part)
                part, size = [], 0
        if part:
            scores += scorer.scores(part)
        return [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]

    return with_columns(docs, "score double, predicted int", add)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; learned from labels outside the held-out fold.

    A null doc_id belongs to no fold: it isn't learned from and isn't held
    out. Null and empty texts have score 0; repeated rows stay; an empty table
    gives an empty table. Of several labels of a document the larger counts.
    """
    docs = documents(spark, sf_dir)
    net = train(docs.where(fold(4) != 2), spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(4) != 2))
    return toxicity(docs.select("doc_id", "text"), net).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
