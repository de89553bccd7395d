"""Byte-level BPE: speculate and verify.

Words are first cut greedily: at each place the longest token of the
vocabulary. That is a guess. It is the encoding if and only if no adjacent
pair of its tokens would have merged across their border, which a vectorised
test decides for all distinct pairs of a batch at once. Only words with a
failing pair are merged exactly, by rank.

The test. Merging token a alone leaves, at its right edge, ever longer pieces:
the right spine of its merge tree. Token b has a left spine. While both merge
on their own, a piece x of a's spine and a piece y of b's spine are neighbours
for some time. The pair fails where x and y have a merge that comes before x
or y is absorbed by the merge of its own side. Merges of one rank go from left
to right, so at equal rank the border wins against the right side only.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import pre_tokenizers

from motorspark.llm._io import documents, small_batches

#: The pattern of byte-level pre-tokenisation.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
NEVER = np.int64(1) << 40
#: Words whose encoding a worker remembers in each of two generations; the older one goes first.
REMEMBERED = 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return [chr(c) for _, c in sorted([(b, b) for b in plain] + [(b, 256 + i) for i, b in enumerate(rest)])]


@lru_cache(1)
def _unsettled() -> re.Pattern:
    """Code points without a category in Python's tables. On these, libraries with newer tables than the tokenizers' may split otherwise."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@lru_cache(1)
def _splitter() -> pre_tokenizers.ByteLevel:
    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def words_of(text: str) -> list[str]:
    """The words that byte-level pre-tokenisation cuts a text into; the tokenizers library itself decides about unsettled code points."""
    # A class of so many ranges is slow to search for, and the distinct characters of a text are few.
    if text.isascii() or not _unsettled().search("".join(set(text))):
        return PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in _splitter().pre_tokenize_str(text)]


class Encoder:
    """Encodes and decodes as the file at ``path`` says (byte-level BPE, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.added.items():
            self.bytes[i] = text.encode()
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # Merge tree: of each token the two that it is merged from, and the rank of that merge.
        self.size, self.left, self.right = size, np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merges[a, b] = (r, c)
            if self.rank[c] < 0:
                self.left[c], self.right[c], self.rank[c] = a, b, r
        pairs = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_ranks = pairs[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # Greedy proposes only tokens that encode to themselves: their own halves must be compatible.
        whole = np.flatnonzero(self.rank >= 0)
        fit = self._compatible(self.left[whole], self.right[whole], self.rank[whole])
        bad = set(whole[~fit].tolist())
        self.greedy = {b: i for b, i in self.ids.items() if i not in bad and i not in set(self.added.values())}
        self._good, self._known = np.zeros(0, bool), np.zeros(0, np.int64)
        self._words: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        # Of each pair of first bytes, the length of the longest token.
        self.reach: dict[bytes, int] = {}
        for b in self.greedy:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 1), len(b))

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a[i] and b[i] stay apart; with ``until``, up to the merge of that rank."""
        x, y = a.copy(), b.copy()
        end_x = np.full(len(a), NEVER) if until is None else until.copy()
        end_y = end_x.copy()
        good = np.ones(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            code = x[todo] * self.size + y[todo]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == code, self.pair_ranks[at], NEVER) if len(self.pairs) else np.full(len(todo), NEVER)
            ex, ey = end_x[todo], end_y[todo]
            top = until[todo] if until is not None else np.full(len(todo), NEVER)
            good[todo] &= ~((rank < ex) & (rank <= ey) & (rank < top))
            rx, ry = self.rank[x[todo]], self.rank[y[todo]]
            go_x = rx > ry
            more = np.maximum(rx, ry) >= 0
            ix, iy = todo[go_x & more], todo[~go_x & more]
            end_x[ix], x[ix] = self.rank[x[ix]], self.right[x[ix]]
            end_y[iy], y[iy] = self.rank[y[iy]], self.left[y[iy]]
            todo = todo[more & good[todo]]
        return good

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Whether each pair, as first * size + second, stays apart; decided once for each pair."""
        at = np.minimum(np.searchsorted(self._known, codes), max(len(self._known) - 1, 0))
        new = np.unique(codes[self._known[at] != codes]) if len(self._known) else np.unique(codes)
        if len(new):
            if len(self._known) > 4_000_000:
                self._known, self._good, new = np.zeros(0, np.int64), np.zeros(0, bool), np.unique(codes)
            known = np.concatenate((self._known, new))
            good = np.concatenate((self._good, self._compatible(new // self.size, new % self.size)))
            order = np.argsort(known)
            self._known, self._good = known[order], good[order]
        return self._good[np.searchsorted(self._known, codes)]

    def merge(self, word: bytes) -> list[int]:
        """The encoding of a word by its merges in order of rank, from left to right within a rank."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > 256:
            return self._merge_long(parts)
        found, none = self.merges.get, (int(NEVER), -1)
        ranks = [found(p, none)[0] for p in zip(parts, parts[1:], strict=False)]
        # A merge changes the ranks of the pairs at its two ends only; the first of equal ranks is the leftmost.
        while ranks and (best := min(ranks)) < none[0]:
            i = ranks.index(best)
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = found((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = found((parts[i], parts[i + 1]), none)[0]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """As merge, with a heap over a linked list, for very long words."""
        import heapq

        n = len(parts)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap = [(m[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := self.merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := self.merges.get((parts[k], parts[after[k]]))):
                    heapq.heappush(heap, (m[0], k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def _guess(self, word: bytes) -> list[int]:
        if (t := self.greedy.get(word)) is not None:
            return [t]
        greedy, reach, out, i, n = self.greedy, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 2], 1))
            while (t := greedy.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def learn(self, words: list[str]) -> None:
        """Encode distinct words and remember them: guess all, test all pairs, merge the failing."""
        raw = [w.encode() for w in words]
        guesses = [self._guess(b) for b in raw]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        codes = (flat[:-1] * self.size + flat[1:])[inside]
        failing = set(owner[:-1][inside][~self.compatible(codes)].tolist()) if len(codes) else set()
        for k, (w, g) in enumerate(zip(words, guesses, strict=True)):
            self._words[w] = tuple(self.merge(raw[k]) if k in failing else g)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with strings of added tokens as these tokens."""
        cut = [[p for p in (self._split.split(t) if self._split else [t]) if p] for t in texts]
        words = [[(p,) if p in self.added else words_of(p) for p in parts] for parts in cut]
        if len(self._words) > REMEMBERED:
            self._words, self._older = {}, self._words
        seen: set[str] = set()
        for parts in words:
            for ws in parts:
                seen.update(ws)
        new = []
        for w in seen.difference(self._words):
            if (t := self._older.get(w)) is not None:
                self._words[w] = t
            elif w in self.added:
                self._words[w] = (self.added[w],)
            else:
                new.append(w)
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        ids_of = self._words.__getitem__
        return [np.fromiter(chain.from_iterable(map(ids_of, chain.from_iterable(parts))), np.int64) for parts in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, added tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunks(texts: list[str], most: int = 2_000_000):
    """Runs of texts of about ``most`` characters, a longer text alone."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def bpe_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every row; a null or empty text has none.

    The vocabulary file is read where the tasks run. Rows are independent:
    repeated ids, extra columns and empty tables need no care.
    """
    small_batches(docs.sparkSession)
    path = path or default_vocabulary()

    def run(batches):
        code = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x for part in chunks(texts) for x in code.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encode and decode every text; ids and texts are digested where they are made."""
    path = path or default_vocabulary()

    def run(batches):
        code = encoder(path)
        names = [str(i) for i in range(code.size)]
        for batch in batches:
            n, digest, decoded = [], [], []
            for part in chunks([t or "" for t in batch.column(1).to_pylist()]):
                for ids in code.encode_batch(part):
                    n.append(len(ids))
                    digest.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                    decoded.append(hashlib.sha256(code.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
