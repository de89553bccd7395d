"""Target-distribution importance resampling with prefix CRCs.

Documents are drawn so that their hashed n-gram features look like those of a
target corpus: a bucket's gain is the logarithm of its share in the target
over its share in the documents, a document's weight the mean gain of its
features, and Gumbel noise on top turns the highest scores into a sample.

A batch of texts is brought to its words joined by one space and scanned once:
lanes of LANE bytes advance side by side and store the CRC register after each
byte. The CRC of any n-gram follows from the registers before and after it:
the earlier one, shifted by the n-gram's length (a product in GF(2)), cancels
out of the later one.

Counts of features are summed in each task and then by Spark; gains are one
number a bucket. Ranks come from a range partitioning by score, never from one
sorted partition.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.llm._io import documents, small_batches, with_columns, written

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 2024, 10, 20
#: The reflected polynomial of CRC-32, and its register before the first byte.
POLYNOMIAL, ALL = 0xEDB88320, np.uint32(0xFFFFFFFF)
#: Bytes that a lane scans; bytes of text scanned at once, where one text isn't longer.
LANE, BLOCK = 256, 4 << 20

_BYTE = np.arange(256, dtype=np.uint8)
WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


@cache
def _step() -> np.ndarray:
    """The register after one byte, by the register's low byte xor that byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


@cache
def _shift_table(k: int) -> np.ndarray:
    """What 2^k zero bytes make of each value of each of a register's four bytes."""
    if k == 0:
        x = np.arange(256, dtype=np.uint32)[None] << np.array([0, 8, 16, 24], np.uint32)[:, None]
        return (x >> 8) ^ _step()[x & 255]
    half = _shift_table(k - 1)
    return _apply(half, half)


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers ``x``, each after its number ``n`` of zero bytes: one product a binary digit of n."""
    x, n = x.copy(), n.astype(np.int64)
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> k) & 1)
        x[at] = _apply(_shift_table(k), x[at])
    return x


def running(data: np.ndarray) -> np.ndarray:
    """The register (from 0) before each byte of ``data`` and after the last."""
    lanes = -(-max(len(data), 1) // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[: len(data)] = data
    columns, step = np.ascontiguousarray(padded.reshape(lanes, LANE).T), _step()
    out = np.zeros((LANE + 1, lanes), np.uint32)
    for i in range(LANE):
        out[i + 1] = (out[i] >> 8) ^ step[(out[i] & 255) ^ columns[i]]
    # A lane starts with what all lanes before it leave: sums over twice as many lanes each round.
    total, k = out[LANE].copy(), 0
    while 1 << k < lanes:
        moved = _apply(_shift_table(k + LANE.bit_length() - 1), total[: -(1 << k)])
        total[1 << k :] ^= moved
        k += 1
    start = np.concatenate((np.zeros(1, np.uint32), total[:-1]))
    for i in range(LANE):
        out[i] ^= start
        start = (start >> 8) ^ step[start & 255]
    out[LANE] ^= start
    return np.append(out[:LANE].T.reshape(-1), out[LANE, -1])[: len(data) + 1]


def features(texts: list[bytes], low: int = 1, high: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and CRC-32 of every run of ``low`` to ``high`` words, repeats included, and the number of words of each text."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    word = WORD[data]
    after = np.concatenate(([False], word[:-1]))
    keep = word | after  # a word's bytes and one separator after it
    ends = np.cumsum([len(t) + 1 for t in texts])  # of each text with its separator
    kept = np.where(word, data, 32).astype(np.uint8)[keep]
    inside = word[keep]
    begin = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    end = np.flatnonzero(~inside)
    own = np.searchsorted(ends, np.flatnonzero(keep)[begin], side="right")
    crc = running(kept)
    who, values = [], []
    for n in range(low, high + 1):
        a, b = begin[: max(len(begin) - n + 1, 0)], end[n - 1 :]
        text = own[: len(a)]
        whole = text == own[n - 1 :]
        a, b = a[whole], b[whole]
        who.append(text[whole])
        values.append(crc[b] ^ shifted(crc[a] ^ ALL, b - a) ^ ALL)
    return np.concatenate(who), np.concatenate(values), np.bincount(own, minlength=len(texts))


def _blocks(column: pa.Array):
    """The column's texts as bytes, in blocks of BLOCK bytes; a longer text is a block of its own."""
    block, size = [], 0
    for x in pa.compute.cast(column, pa.large_binary()):
        text = x.as_py() or b""
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, low: int = 1, high: int = 1) -> DataFrame:
    """``bucket`` and ``n``: how many features of all rows of ``texts`` (text) it holds; a task sends one row a bucket at most."""
    small_batches(texts.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in _blocks(batch.column(0)):
                total += np.bincount(features(block, low, high)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw features."""
    k, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(raw, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of a document, in thousandths; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list, rank: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1, as ``rank``; ties of the whole order in any order.

    Rows are dealt by ranges of the order and numbered within their range; a
    range starts where those before it end. Ranges of equal rows are split by
    a random number, so repeated rows don't meet in one task. The ranges are a table,
    so that counts and numbers see the same ones.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.rand(7))
    ranges = salted.repartitionByRange(parts, *order, F.col("_salt")).withColumn("_range", F.spark_partition_id())
    ranges = written(ranges, "resampling-ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: as many as there are partitions.
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_range").orderBy(*order, "_salt")
    return ranges.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(starts), "_range").withColumn(rank, F.col("_start") + F.col("_in")).drop("_range", "_in", "_start", "_salt")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, low: int = 1, high: int = 1, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs`` (doc_id, text).

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: those with the highest scores, ties to the
    smaller doc_id, a null one last. ``target`` has a column text.

    Null and empty texts have no feature and weight 0, and are drawn only
    where ``min_words`` is 0. Rows that repeat an id are judged each; rows
    equal in score and id are ranked in any order. Other columns aren't read.
    An empty table gives an empty table; an empty target has zero counts.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def counted(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, buckets, low, high).collect():  # one row a bucket
            out[r["bucket"]] = r["n"]
        return out

    gain = gains(counted(rows), counted(target))

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        n, words, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block in _blocks(batch.column("text")):
            who, crc, count = features(block, low, high)
            n.append(np.bincount(who, minlength=len(block)))
            words.append(count)
            # Sums of integers in doubles are exact below 2^53.
            total.append(np.bincount(who, gain[crc % buckets], minlength=len(block)).astype(np.int64))
        n, words, total = map(np.concatenate, (n, words, total))
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        plus = np.fromiter((noise(x.as_py(), seed) for x in batch.column("doc_id")), np.int64, batch.num_rows)
        return [pa.array(x.astype(np.int64)) for x in (n, words, weight, weight + plus)]

    scored = with_columns(rows, "n_features long, n_words long, weight long, score long", score).drop("text")
    scored = written(scored, "resampling-scores")
    able = F.col("n_words") >= min_words
    take = percent * scored.where(able).count() // 100
    order = [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = ranked(scored, order, "_rank")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(able & (F.col("_rank") <= take), F.col("_rank")).cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against all benchmark texts; odd rows as in ``resample``."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: A word's CRC goes byte by byte through a table that the SQL makes from the polynomial.
ORACLE = r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
step AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1, NULL, text FROM benchmark),
words AS (
  SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w)), 1), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), step),
counted AS (SELECT bucket, count(*) FILTER (WHERE r > 0) AS s, count(*) FILTER (WHERE r < 0) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
sums AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM texts LEFT JOIN sums USING (r) WHERE texts.r > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS p FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN p END AS rank FROM placed
"""
