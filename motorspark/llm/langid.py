"""Language ID by interpolated Kneser-Ney character models.

One character n-gram model per language, fitted on a bounded sample of
labelled documents. For every n-gram seen in any language the interpolated
log probabilities in all languages lie side by side, in arrays sorted by the
n-gram's hash, so scoring is a binary search per order. Words are scored with
their borders; a document's cross-entropy is the mean over its characters, and
the language with the lowest one wins. What fits no language (cross-entropy
above the level calibrated on held-back documents) is rejected.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm._io import documents, kept, with_columns, written

ORDER = 4
#: Runs of word characters without digits; a fraction, a Roman numeral or a superscript can still be among them.
LETTERS = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Distinct texts of each language, texts in all (at least one of each language), and characters of each text that the models are fitted on, at most.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_CHARS = 400, 80_000, 2500
#: A longer text gives the sample this many slices of equal length, spread evenly from its start to its end.
SLICES = 5
#: Places that are scored at once. Every place sees the characters before it wherever the cut is.
PLACES = 1 << 18
#: Powers of two up to which a limit is calibrated: for texts of 1, 2, 4, ... letters or more.
LEVELS = 12
#: A language with fewer held-back pieces of a length than CALIBRATED takes the limit of all languages.
CALIBRATED = 5
REJECT_QUANTILE, REJECT_MARGIN = 0.999, 1.2
#: Scores of words that a worker remembers.
REMEMBERED = 200_000


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: its runs of letters."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # Number characters end a word.
    return [w for f in found for w in ("".join(c if c.isalpha() else " " for c in f)).split()]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each word between ORDER - 1 starts and one end; and the word of each."""
    pad, end = "\x02" * (ORDER - 1), "\x03"
    joined = "".join(f"{pad}{w}{end}" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    return codes, np.repeat(np.arange(len(words)), lengths)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram of ``order`` that ends at each place from ORDER - 1 on."""
    h = np.zeros(len(codes) - ORDER + 1, np.uint64)
    for k in range(order):
        first = ORDER - order + k
        h = (h ^ codes[first : first + len(h)]) * MIX
        h ^= h >> np.uint64(29)
    return h


def _contexts(codes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the ``order`` characters before each place from ORDER - 1 on."""
    h = np.zeros(len(codes) - ORDER + 1, np.uint64)
    for k in range(order):
        first = ORDER - 1 - order + k
        h = (h ^ codes[first : first + len(h)]) * MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """Sorted hash arrays: of each order the n-grams' log probabilities and the contexts' log weights."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    limit: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The negative log probability of each word in each language."""
        codes, owner = _flat(words)
        out = np.zeros((len(words), len(self.languages)))
        for a in range(0, len(codes) - ORDER + 1, PLACES):
            part = codes[a : a + PLACES + ORDER - 1]
            score, whose = self._places(part), owner[a + ORDER - 1 : a + ORDER - 1 + len(part) - ORDER + 1]
            # Padding isn't scored: a place counts if it isn't a start.
            real = part[ORDER - 1 :] != 2
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(whose[real], -score[real, j], len(words))
        return out

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """The log probability of the character at each place from ORDER - 1 on, given those before it."""
        score = np.repeat(self.floor[None], len(codes) - ORDER + 1, 0)
        for n in range(1, ORDER + 1):
            if n > 1:
                keys, weights = self.contexts[n - 2]
                h = _contexts(codes, n - 1)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                seen = keys[at] == h
                score[seen] += weights[at[seen]]
            keys, logs = self.grams[n - 1]
            h = _hashes(codes, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            seen = keys[at] == h
            score[seen] = logs[at[seen]]
        return score


def fit(texts: dict[str, list[str]]) -> Model:
    """The models of the languages in ``texts``; every tenth document calibrates the rejection."""
    languages = sorted(texts)
    rows: list[dict[str, tuple]] = []
    back: dict[str, list[str]] = {}
    streams = []
    for lang in languages:
        keep = [t for i, t in enumerate(texts[lang]) if i % 10 or len(texts[lang]) < 20]
        back[lang] = texts[lang][::10]
        words = [w for t in keep for w in words_of(t)]
        codes, _ = _flat(words or ["a"])
        streams.append(codes)
    alphabet = len(np.unique(np.concatenate(streams))) + 1
    floor = np.full(len(languages), -np.log(alphabet), np.float64)
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    weights: list[tuple[np.ndarray, np.ndarray]] = []
    lower = None
    for n in range(1, ORDER + 1):
        # The n-gram ending at each place, with its context and the shorter n-gram, over all languages.
        every: dict[str, list] = {"g": [], "c": [], "s": []}
        counted = []
        for codes in streams:
            real = codes[ORDER - 1 :] != 2
            g = _hashes(codes, n)[real]
            c = _contexts(codes, n - 1)[real] if n > 1 else np.zeros(int(real.sum()), np.uint64)
            s = _hashes(codes, n - 1)[real] if n > 1 else np.zeros(len(g), np.uint64)
            if n < ORDER:
                # Kneser-Ney: a lower order counts the distinct characters before the n-gram.
                longer, first = np.unique(_hashes(codes, n + 1)[real], return_index=True)
                del longer
                g1, c1, s1 = g[first], c[first], s[first]
            else:
                g1, c1, s1 = g, c, s
            kinds, first, count = np.unique(g1, return_index=True, return_counts=True)
            counted.append((kinds, c1[first], s1[first], count.astype(np.float64)))
            every["g"].append(kinds)
            every["c"].append(c1[first])
            every["s"].append(s1[first])
        grams, first = np.unique(np.concatenate(every["g"]), return_index=True)
        gram_context, gram_shorter = np.concatenate(every["c"])[first], np.concatenate(every["s"])[first]
        contexts = np.unique(gram_context)
        logs = np.zeros((len(grams), len(languages)), np.float32)
        context_logs = np.zeros((len(contexts), len(languages)), np.float32)
        for j, (kinds, c, _, count) in enumerate(counted):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
            at = np.searchsorted(contexts, c)
            total = np.bincount(at, count, len(contexts))
            types = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                rest = np.where(total > 0, discount * types / total, 1.0)
            own = np.zeros(len(grams))
            own[np.searchsorted(grams, kinds)] = count - discount
            g_at = np.searchsorted(contexts, gram_context)
            short = np.exp(lower(gram_shorter, j)) if lower else np.full(len(grams), np.exp(floor[j]))
            p = np.where(total[g_at] > 0, own / np.maximum(total[g_at], 1), 0.0) + rest[g_at] * short
            logs[:, j] = np.log(p)
            context_logs[:, j] = np.log(rest)
        tables.append((grams, logs))
        if n > 1:
            weights.append((contexts, context_logs))
            lower = _lookup(grams, logs)
        else:
            # Of order 1 the context is empty: what isn't seen has the empty context's weight.
            floor = floor + context_logs[0]
            lower = _lookup(grams, logs)
    model = Model(languages, tables, weights, floor.astype(np.float64), np.full((len(languages), LEVELS), np.inf))
    # Short texts vary more, so that held-back texts are cut into pieces of every length, and each length has its limit.
    found = [pieces_entropies(model, back[lang], j) for j, lang in enumerate(languages)]
    for level in range(LEVELS):
        pooled = np.concatenate([f[level] for f in found])
        for j, own in enumerate(f[level] for f in found):
            use = own if len(own) >= CALIBRATED else pooled
            if len(use) >= CALIBRATED:
                model.limit[j, level] = np.quantile(use, REJECT_QUANTILE) + REJECT_MARGIN
            elif level:
                model.limit[j, level] = model.limit[j, level - 1]
    # More letters never widen a limit.
    model.limit = np.minimum.accumulate(model.limit, 1)
    return model


def pieces_entropies(model: Model, texts: list[str], language: int) -> list[np.ndarray]:
    """For each level the cross-entropies, in one language, of the texts' runs of words that have just 2^level letters or more."""
    out: list[list[float]] = [[] for _ in range(LEVELS)]
    for text in texts:
        words = words_of(text)
        if not words:
            continue
        letters = np.cumsum([0, *map(len, words)])
        total = np.concatenate(([0.0], np.cumsum(model.word_scores(words)[:, language])))
        for level in range(LEVELS):
            a = 0
            while (b := int(np.searchsorted(letters, letters[a] + (1 << level)))) <= len(words):
                out[level].append((total[b] - total[a]) / (letters[b] - letters[a] + b - a))
                a = b
    return [np.array(x) for x in out]


def _lookup(grams: np.ndarray, logs: np.ndarray):
    def find(h: np.ndarray, j: int) -> np.ndarray:
        return logs[np.minimum(np.searchsorted(grams, h), len(grams) - 1), j].astype(np.float64)

    return find


class Memory:
    """Scores of words met before: a row number for each word, and the rows."""

    def __init__(self, width: int):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, width))

    def learn(self, model: Model, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            scores = model.word_scores(part)
            self.at.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.rows = np.concatenate((self.rows, scores))


def entropies(model: Model, texts: list[str], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character in each language, and the number of letters, of each text."""
    memory = memory or Memory(len(model.languages))
    found = [words_of(t) for t in texts]
    seen: set[str] = set()
    for ws in found:
        seen.update(ws)
    if len(memory.at) > REMEMBERED:
        memory.at, memory.rows = {}, memory.rows[:0]
    memory.learn(model, list(seen.difference(memory.at)))
    h, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for i, ws in enumerate(found):
        if ws:
            letters[i] = len("".join(ws))
            h[i] = memory.rows[np.fromiter(map(memory.at.__getitem__, ws), np.int64, len(ws))].sum(0) / (letters[i] + len(ws))
    return h, letters


def _slices(text: Column) -> Column:
    """The whole text up to SAMPLE_CHARS characters; of a longer one SLICES slices that add up to so many."""
    each = SAMPLE_CHARS // SLICES
    step = (F.length(text) - each) / (SLICES - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(each)))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(cut, "\n"))


def train(docs: DataFrame) -> Model | None:
    """Fit on ``docs`` (doc_id, text, lang): of every language with letters a bounded sample.

    Distinct texts are taken in the order of their hash, up to SAMPLE_DOCS of
    each language (fewer where there are so many languages that the sample
    would hold over SAMPLE_TOTAL texts), and up to SAMPLE_CHARS characters of
    each; so at most SAMPLE_TOTAL x SAMPLE_CHARS characters (200 MB), or one
    text of each language, reach the driver, whatever the texts' lengths. Null
    languages and texts are left out; without any, there is no model (None).
    """
    from pyspark.sql import Window

    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text", F.lit(7)).alias("h")).where(F.length("text") > 0)
    counted = written(usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "langid-languages")
    languages = counted.count()
    if not languages:
        return None
    most = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // languages))
    # A share by hash first, so that no window holds a language's every row; copies are one row from the map side on.
    share = F.pmod("h", F.lit(1_000_000)) < F.lit(4_000_000 * most) / F.col("n") + 1
    some = usable.join(counted, "lang").where(share).select("lang", "h", _slices(F.col("text")).alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    got: dict[str, list[str]] = {}
    for r in some.withColumn("r", rank).where(F.col("r") <= most).select("lang", "text").toLocalIterator():
        got.setdefault(r["lang"], []).append(r["text"])
    return fit({lang: t for lang, t in got.items() if any(words_of(x) for x in t)} or {"und": ["a"]})


def detect(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and ``rejected``, which replace columns of these names.

    Null texts and texts without a letter are ``und``, with score 0, and
    rejected. Texts are read whole, whatever the length of their words. Of
    languages with one cross-entropy the first by name is taken. Equal texts
    get equal values, and rows that repeat an id are scored each. An empty
    table stays empty; with no model every row is ``und``.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def add(batch):
        m, pred, score, rejected = shared.value, [], [], []
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for i in range(0, len(texts), 200):
            part = texts[i : i + 200]
            if m is None:
                h, letters = np.zeros((len(part), 1)), np.zeros(len(part), np.int64)
            else:
                h, letters = entropies(m, part, kept(key, lambda: Memory(len(m.languages))))
            for row, n in zip(h, letters, strict=True):
                if not n:
                    pred.append("und")
                    score.append(0.0)
                    rejected.append(True)
                    continue
                best = int(row.argmin())
                odds = np.exp(-(row - row[best]) * min(float(n), 20.0))
                pred.append(m.languages[best])
                score.append(float(1 / odds.sum()))
                rejected.append(bool(row[best] > m.limit[best, min(int(n).bit_length(), LEVELS) - 1]))
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_columns(docs, "lang_pred string, score double, rejected boolean", add)


def fold(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those outside the held-out fold.

    A null doc_id belongs to no fold: it isn't learned from and isn't held out.
    Null and empty texts are ``und``; repeated rows stay; other columns of
    ``documents`` aren't read; an empty table gives an empty table.
    """
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold(5) != 0))
    return detect(docs.select("doc_id", "text"), model).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
