"""Packing: fill fixed windows with documents by minimum bin slack.

A document's ids are cut into whole windows; what remains is a tail shorter
than a window. Tails are packed by their lengths alone: the counts of the
lengths (at most window - 1 numbers, whatever the size of the corpus) go to a
planner, which fills one window after another. Each window takes the longest
tail left, and a bitset subset-sum over the lengths left finds the sum closest
to the free room; backtracking gives the counts of that multiset, and the same
filling is used as often as the counts allow. Where no multiset fills a
window, one more tail is cut to fill it, and its rest goes back to the counts.

The plan is a table of intervals: tails of one length, numbered without gaps,
from ``lo`` to ``hi`` go to sequences in order. Joining it places every tail.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm import bpe
from motorspark.llm._io import documents, small_batches, with_slots, written

WINDOW = 1024
#: Whole windows of one document have ids from its number shifted by this on; 2^21 windows are over 2 GB of text.
SHIFT = 21


@lru_cache(2)
def tokenizer(path: str, special: str, special_id: int) -> tiktoken.Encoding:
    """The encoding of a rank file, with one special token; one for each worker."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id})


def ids_of(text: str, path: str) -> np.ndarray:
    """The ids of a text; very long runs of white space, which the fast encoder gives up on, go to the one of ``bpe``."""
    try:
        return tokenizer(path, "<|endoftext|>", 50256).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return bpe.encoder(bpe.default_vocabulary()).encode_batch([text])[0]


def default_ranks() -> str:
    """The rank file of the vocabulary in byte_bpe_50k.json; both give the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tails(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Of every row: its number of ids, the checksums of its whole windows, and its tail; a null text is its closing id alone."""
    small_batches(docs.sparkSession)
    path = path or default_ranks()

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1):
                ids = np.append(ids_of(text.as_py() or "", path), 0).astype("<u4")
                whole = len(ids) // window
                crcs = [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(whole)]
                tail = ids[whole * window :]
                out.append((len(ids), crcs, len(tail), zlib.crc32(tail.tobytes()), tail.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "doc_tokens", "crcs", "tail_len", "tail_crc", "tail"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, tail_len int, tail_crc long, tail binary")


def fill(counts: dict[int, int], first: int, window: int = WINDOW) -> dict[int, int]:
    """The multiset with ``first`` in it whose sum is closest to ``window``, as length -> count."""
    room = window - first
    reach, states = 1, []
    goal = 1 << room
    mask = (goal << 1) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        most = min(counts[length] - (length == first), room // length)
        if most <= 0:
            continue
        states.append((length, most, reach))
        part = 1
        while most > 0:  # every count up to ``most``, by parts of 1, 2, 4, ...
            step = min(part, most)
            reach |= (reach << (step * length)) & mask
            most -= step
            part *= 2
        if reach & goal:
            break
    left, found = reach.bit_length() - 1, {first: 1}
    for length, most, before in reversed(states):
        used = next(c for c in range(most + 1) if left >= c * length and before >> (left - c * length) & 1)
        if used:
            found[length] = found.get(length, 0) + used
            left -= used * length
    return found


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple], int]:
    """Rows (tail_len, lo, hi, from, length, sequence, phase, copies, offset), and the number of sequences.

    The tail number r of its length, lo <= r < hi, lies with its ids ``from``
    up to ``from + length`` in sequence + (phase + r - lo) // copies, at
    offset + ((phase + r - lo) % copies) * length.
    """
    queues = {n: deque([(n, 0, c, 0)]) for n, c in counts.items() if c > 0 and n > 0}
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    rows: list[tuple] = []
    sequence = 0

    def take(length: int, many: int) -> list[tuple]:
        got, queue = [], queues[length]
        left[length] -= many
        if not left[length]:
            del left[length]
        while many:
            origin, lo, hi, start = queue.popleft()
            n = min(many, hi - lo)
            if n < hi - lo:
                queue.appendleft((origin, lo + n, hi, start))
            got.append((origin, lo, lo + n, start))
            many -= n
        return got

    def put(segments: list[tuple], length: int, copies: int, offset: int) -> None:
        phase = 0
        for origin, lo, hi, start in segments:
            rows.append((origin, lo, hi, start, length, sequence, phase, copies, offset))
            phase += hi - lo

    while left:
        chosen = fill(left, max(left), window)
        times = min(left[n] // c for n, c in chosen.items())
        slack = window - sum(n * c for n, c in chosen.items())
        cut = None
        if slack:
            # Any tail left is longer than the slack, else it would have been chosen.
            spare = {n: c - chosen.get(n, 0) for n, c in left.items() if c > chosen.get(n, 0)}
            if spare:
                cut = max(spare)
                times = min(times, left[cut] // (chosen.get(cut, 0) + 1))
        offset = 0
        for n, c in chosen.items():
            put(take(n, c * times), n, c, offset)
            offset += n * c
        if cut is not None:
            parts = take(cut, times)
            put(parts, slack, 1, offset)
            rest = cut - slack
            queues.setdefault(rest, deque()).extend((o, lo, hi, start + slack) for o, lo, hi, start in parts)
            left[rest] = left.get(rest, 0) + times
        sequence += times
    return rows, sequence


PLAN = "tail_len int, lo long, hi long, start_in long, length long, base long, phase long, copies long, at long"


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one id, the closing 0. Rows that repeat a doc_id
    are documents of their own. Columns other than doc_id and text are not
    read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    table = written(tails(docs, path, window), "packing-tails")
    numbered = with_slots(table.select("doc_id", "doc_tokens", "crcs", "tail_len", "tail_crc"), "tail_len", ["doc_id", "tail_crc", "doc_tokens"], "r")
    counts = {r["tail_len"]: r["n"] for r in table.groupBy("tail_len").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, sequences = plan(counts, window)
    # The plan has a few thousand rows at most: its size hangs on the window, not on the corpus.
    intervals = F.broadcast(spark.createDataFrame(rows, PLAN))
    at = (
        numbered.where("tail_len > 0").join(intervals, "tail_len").where("r >= lo AND r < hi")
        .withColumn("i", F.col("phase") + F.col("r") - F.col("lo"))
        .select(
            "doc_id", "doc_tokens", "tail_len", "tail_crc", "start_in", "length",
            (F.col("doc_tokens") - F.col("tail_len") + F.col("start_in")).alias("start"),
            (F.col("base") + F.expr("i div copies")).alias("sequence_id"),
            (F.col("at") + F.col("i") % F.col("copies") * F.col("length")).alias("offset"),
        )
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    uncut = at.where("length = tail_len").withColumn("ids_crc32", F.col("tail_crc")).select(*out)
    key = ["doc_id", "tail_crc", "doc_tokens"]
    bytes_of = table.where("tail_len > 0").select(*key, "tail").withColumnsRenamed({k: f"_{k}" for k in key})
    cuts = at.where("length < tail_len")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tail_crc") == F.col("_tail_crc")) & (F.col("doc_tokens") == F.col("_doc_tokens"))
    if any(r[4] < r[0] for r in rows):
        wanted = cuts.select(*key).distinct()
        held = bytes_of.join(wanted, same, "left_semi").dropDuplicates([f"_{k}" for k in key])
        piece = F.crc32(F.substring("tail", (F.col("start_in") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
        tails_placed = uncut.unionByName(cuts.join(held, same).withColumn("ids_crc32", piece).select(*out))
    else:
        tails_placed = uncut
    # Documents are numbered over all lengths, so that whole windows get ids of their own.
    before, starts = 0, []
    for n in sorted(counts):
        starts.append((n, before))
        before += counts[n]
    first = F.broadcast(spark.createDataFrame(starts, "tail_len int, first long"))
    whole = (
        numbered.where(F.size("crcs") > 0).join(first, "tail_len")
        .select("doc_id", "doc_tokens", (F.col("first") + F.col("r")).alias("number"), F.posexplode("crcs").alias("i", "ids_crc32"))
        .select(
            "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
            (F.shiftleft(F.col("number"), SHIFT) + F.col("i") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )
    return tails_placed.unionByName(whole)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 ids; odd rows as in ``pack``."""
    return pack(documents(spark, sf_dir))
