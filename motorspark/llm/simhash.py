"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 16 segments of
4 bits. The Manhattan distance of two embeddings is a lower bound of the
Hamming distance of the fingerprints, so all pairs within 2 bits are found by
a grid range-join of radius 2. Both sides of the join go to the cells at
distance 0 and 1 from their own: two points at distance 2 or less share such a
cell. What meets in a cell is then verified exactly.

A cell can be crowded (thousands of near copies). A crowded cell isn't
compared pair by pair: its fingerprints are embedded again in 64 segments of
1 bit, where the same cells hold at most 65 fingerprints, any two of which are
within 2 bits, and where linking all to the smallest is exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm._io import documents, join_counted, shuffled, small_batches, written

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, RADIUS = 3, 42, 2
#: A cell with more fingerprints than this is embedded in finer segments.
CROWDED = 48


def fingerprint(text: str | None) -> int:
    """The SimHash of the text's 3-word shingles, as an unsigned number; 0 without words."""
    words = WORDS.findall((text or "").encode().lower())
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # very long texts in pieces
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of every row; 0 for a null text and one without words."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 16 segments, each in its own 4 bits of a word."""
    x = fps.astype(np.uint64)
    x = (x & np.uint64(0x5555555555555555)) + ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _cells(fps: DataFrame, fine: bool) -> DataFrame:
    """``fp`` with every ``cell`` at Manhattan distance 0 or 1 of its embedding."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 20_000):
                own = fp[i : i + 20_000].view(np.uint64)
                cells, users = [], []
                if fine:
                    cells = [own, *(own ^ np.uint64(1 << b) for b in range(64))]
                    users = [own] * 65
                else:
                    at = segment_counts(own)
                    cells, users = [at], [own]
                    for s in range(0, 64, 4):
                        count = (at >> np.uint64(s)) & np.uint64(15)
                        up, down = count < 4, count > 0
                        cells += [at[up] + np.uint64(1 << s), at[down] - np.uint64(1 << s)]
                        users += [own[up], own[down]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(users).view(np.int64)), pa.array(np.concatenate(cells).view(np.int64))], names=["fp", "cell"]
                )

    return fps.select("fp").mapInArrow(run, "fp long, cell long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct fingerprints that connect all that are within RADIUS bits.

    ``fps`` holds distinct fingerprints as ``fp``. Every pair within RADIUS is
    given, or is connected through pairs that are given and within RADIUS.
    """
    coarse = _cells(fps, fine=False)
    # Cells of one fingerprint only don't matter; most are such.
    met = coarse.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("one")).where("n > 1").select("cell", "n")
    inside = written(coarse.join(shuffled(met), "cell"), "simhash-cells")
    crowd = inside.where(F.col("n") <= CROWDED)
    packed = crowd.groupBy("cell").agg(F.collect_list("fp").alias("fps"))

    def verify(batches):
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fps in batch.column(0):
                x = np.sort(np.array(fps.as_py(), np.int64))
                i, j = np.nonzero(np.triu(np.bitwise_count(x.view(np.uint64)[:, None] ^ x.view(np.uint64)[None]) <= RADIUS, 1))
                left.append(x[i])
                right.append(x[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    near = packed.select("fps").mapInArrow(verify, "a long, b long")
    rest = inside.where(F.col("n") > CROWDED).select("fp").distinct()
    fine = _cells(rest, fine=True).groupBy("cell").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = fine.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates large and small stars (Kiveris et al., 2014) until nothing
    changes; the number of rounds grows with the logarithm of the size. Each
    round's edges are a table in the shared folder. Stars with very many rays
    meet in sums with partial aggregation, and their least node is broadcast,
    never in one group.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components-0")
    step, before = 1, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        # Large star: the larger neighbours of u go to the least of u's surroundings.
        large = join_counted(both.where("v > u"), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of u, and u, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"components-{step}")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        step, before = step + 1, state


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` of every row.

    Null and empty texts, and texts of white space, have fingerprint 0 and are
    linked like any other. A null ``doc_id`` is never a component's id unless
    the component has no other. Repeated rows stay and share a component.
    Columns other than doc_id and text are not read. An empty table gives an
    empty table.
    """
    prints = written(fingerprints(docs), "simhash-fingerprints")
    return named(prints, links(prints.select("fp").distinct()))


def named(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp) with the ``component_id`` that the ``edges`` (a, b) between fingerprints give."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = components(edges)
    rooted = found.join(shuffled(distinct), found["node"] == distinct["fp"]).select("node", "root", "first")
    roots = found.select("root").distinct()
    rooted = rooted.unionByName(roots.join(shuffled(distinct), roots["root"] == distinct["fp"]).select(F.col("root").alias("node"), "root", "first"))
    rooted = written(rooted, "simhash-rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("linked"), F.count(F.lit(1)).alias("n")), "simhash-roots")
    named = join_counted(rooted, least, ["root"], "n").select(F.col("node").alias("fp"), "linked")
    whole = written(distinct.join(shuffled(named), "fp", "left").select("fp", F.coalesce("linked", "first").alias("component_id"), "n"), "simhash-components")
    return join_counted(prints, whole, ["fp"], "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int | None = None, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    With ``shingle``, texts whose sets of so many words have a Jaccard
    similarity of ``percent`` are linked too.

    Rows that repeat an id are one document and share its fate. Of documents
    without an id, those that are linked to one with an id go.
    """
    if shingle is None:
        found = near_duplicates(docs)
    else:
        from motorspark.llm.jaccard import near_copies

        found = near_copies(docs, shingle, percent)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone"), F.lit(True).alias("_near"))
    gone = gone.distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document; odd rows as in ``near_duplicates``."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
