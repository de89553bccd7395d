"""Near-duplicates of the pipeline: exact Jaccard similarity of word shingles, next to the SimHash links.

A text is the set of its shingles of five words. Two sets with a similarity of
0.8 or more share a shingle within the first fifth of each (plus one) in any
order that is the same for all, so candidates meet by one shingle (prefix
filter). The order puts shingles that are frequent in a sample last; the sample
decides how many candidates meet, never which pairs are linked.

Equal sets are one node. In a shingle's group all are first compared with the
group's smallest and largest id only, which connects a group of many near
copies; then all are compared that no link connects so far. Of a large group,
those outside its largest component meet all in blocks, and only pairs that
sizes and parities can't rule out leave a block. Each pair is verified on the
whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorspark.llm import simhash
from motorspark.llm._io import join_counted, shuffled, small_batches, written

#: Words in a shingle; similarity in percent from which two texts are linked.
SHINGLE, PERCENT = 5, 80
#: Distinct texts looked at for frequent shingles; times from which one is frequent; how many are sent to the tasks.
SAMPLE_TEXTS, FREQUENT, MOST_FREQUENT = 5000, 3, 100_000
#: Fewest classes of a set's parities; a larger set has the power of two that is four times its size or the next.
BITS = 512
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A shingle's group of more sets than this is compared in blocks; sets, and bytes of their parities, in a block.
SMALL, BLOCK, BLOCK_BYTES = 64, 256, 1 << 19


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words, sorted; one for a shorter text, none without words.

    A run's hash is mixed from those of its words in order.
    """
    words = simhash.WORDS.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.int64)
    size = min(size, len(words))
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ own[k : k + len(h)]) * MIX
        h ^= h >> np.uint64(31)
    return np.unique(h.view(np.int64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The shingles of which any set similar to this one has one within its own prefix: the first in the common order."""
    if not len(hashes):
        return hashes
    late = np.zeros(len(hashes), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        late = frequent[at] == hashes
    keep = len(hashes) - -(-percent * len(hashes) // 100) + 1
    return np.concatenate((hashes[~late], hashes[late]))[:keep]


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets (sorted, distinct) have this Jaccard similarity; in integers."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def parities(hashes: np.ndarray) -> list[int]:
    """The parity of the number of shingles in each class, as bits.

    Two sets differ in at least as many shingles as their parities do in bits.
    With four classes or more a shingle few differences cancel out, so that
    the bound is close. Halves of a longer row of bits fold by XOR into the
    shorter one of a smaller set.
    """
    classes = max(BITS, 1 << max(4 * len(hashes) - 1, 1).bit_length())
    odd = np.bincount(hashes & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _ids(hashes: np.ndarray) -> tuple[int, int]:
    low, high = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist()
    return low, high


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many texts of a sample hold, sorted."""
    step = max(docs.count() // SAMPLE_TEXTS, 1)
    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct()

    def run(batches):
        for batch in batches:
            found = [shingles(x.as_py(), size) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["token"])

    counted = texts.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").collect()
    return np.sort(np.array([r["token"] for r in top], np.int64))


def _sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, mark (of the text), ``fp``, and of the shingle set ``id``, ``id2``, size ``n``, ``bits`` and ``prefix``, of every row."""
    frequent = frequent_shingles(docs, size)

    def run(batches):
        for batch in batches:
            fps, low, high, sizes, bits, firsts = [], [], [], [], [], []
            for x in batch.column(1):
                text = x.as_py()
                own = shingles(text, size)
                a, b = _ids(own)
                fps.append(simhash.fingerprint(text))
                low.append(a)
                high.append(b)
                sizes.append(len(own))
                bits.append(parities(own))
                firsts.append(prefix(own, frequent, percent))
            ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])))
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["doc_id", "mark", "fp", "id", "id2", "n", "bits", "prefix"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long, id long, id2 long, n long, bits array<long>, prefix array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) of ids whose sets are similar.

    Sets are made again from one text for each set that occurs in a pair, so
    only those are moved. Should two sets have one id, each is compared.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    one = sketches.join(shuffled(ids), "id", "left_semi").groupBy("id", "id2").agg(F.min(F.struct("doc_id", "mark")).alias("one"))
    one = one.select(F.col("one.doc_id").alias("_doc"), F.col("one.mark").alias("_mark"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    texts = rows.join(one, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left_semi")

    def make(batches):
        for batch in batches:
            found = [shingles(x.as_py(), size) for x in batch.column(0)]
            keys = [_ids(x) for x in found]
            made = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["id", "id2", "hashes"])

    sets = written(texts.select("text").mapInArrow(make, "id long, id2 long, hashes binary").dropDuplicates(["id", "id2"]), "jaccard-sets")
    first = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))

    def verify(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            good = [similar(np.frombuffer(p.as_py(), np.int64), np.frombuffer(q.as_py(), np.int64), percent) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(shuffled(first), "a").join(shuffled(second), "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of bits in which rows of x differ from rows of y, each pair of them; the longer rows fold."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
    out = np.empty((len(x), len(y)), np.int64)
    step = max(1, (1 << 22) // max(y.size, 1))
    for i in range(0, len(x), step):
        out[i : i + step] = np.bitwise_count(x[i : i + step, None] ^ y[None]).sum(2, dtype=np.int64)
    return out


def _block(rows: pa.StructArray) -> list[tuple]:
    """ids, sizes, labels, sets of tokens and parities of a block, by the length of the parities."""
    ids, n, label = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "label"))
    tokens = [set(t) for t in rows.field("tokens").to_pylist()]
    bits = rows.field("bits")
    ends = np.cumsum(pyarrow.compute.list_value_length(bits).to_numpy(zero_copy_only=False))
    flat = bits.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = np.diff(np.concatenate(([0], ends)))
    out = []
    for k in np.unique(lengths):
        at = np.flatnonzero(lengths == k)
        out.append((ids[at], n[at], label[at], [tokens[i] for i in at], np.stack([flat[ends[i] - k : ends[i]] for i in at])))
    return out


def _in_blocks(open_: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b) with different labels within the groups of ``open_`` (token, id, n, label, members).

    A group's largest component is one side only: its members needn't meet
    each other. Blocks of the others meet blocks of all, so a group of g sets
    of which s are others makes s * g / BLOCK^2 rows. Sets that share several
    shingles meet in several groups; the least shingle gives the pair, so a
    pair leaves its blocks once (or twice, if both are others).
    """
    sizes = open_.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    major = written(sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("members_")), "jaccard-major")
    rows = join_counted(open_.drop("members"), major.withColumn("total", F.col("members_")), ["token"], "members_")
    shared = open_.groupBy("id").agg(F.collect_set("token").alias("tokens"))
    rows = rows.join(shuffled(known.select("id", "bits")), "id").join(shuffled(shared), "id")
    # A set of very many shingles takes a block with fewer others.
    per = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.size("bits") * 8))))
    rows = rows.select("token", (F.col("label") != F.col("major")).alias("other"), F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / per)).alias("block"), per.alias("per"), F.struct("id", "n", "label", "bits", "tokens").alias("row"))
    rows = written(rows, "jaccard-rows")
    whole = rows.groupBy("token", "per", "block").agg(F.collect_list("row").alias("x")).select("token", "x")
    part = rows.where("other").groupBy("token", "per", "block").agg(F.collect_list("row").alias("y")).select("token", "y")

    def compare(batches):
        for batch in batches:
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for token, p, q in zip(batch.column("token").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                for ia, na, la, ta, xa in _block(p.values):
                    for ib, nb, lb, tb, xb in _block(q.values):
                        fine = (la[:, None] != lb) & (na[:, None] * 100 >= nb * percent) & (nb * 100 >= na[:, None] * percent)
                        if fine.any():
                            i, j = np.nonzero(fine & (_apart(xa, xb) * (100 + percent) <= (na[:, None] + nb) * (100 - percent)))
                            own = np.fromiter((min(ta[k] & tb[m]) == token for k, m in zip(i, j, strict=True)), bool, len(i))
                            left.append(np.minimum(ia[i], ib[j])[own])
                            right.append(np.maximum(ia[i], ib[j])[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return whole.join(shuffled(part), "token").select("token", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` of every row, as ``simhash.near_duplicates`` gives them, with more links.

    Linked are texts within the SimHash radius, and texts whose sets of
    ``size``-word shingles have a Jaccard similarity of ``percent`` or more.
    """
    sketches = written(_sketches(docs, size, percent), "jaccard-sketches")
    prints = sketches.select("doc_id", "fp")
    near = written(simhash.links(prints.select("fp").distinct()), "jaccard-simhash")
    # A node of the graph is a fingerprint; a set's node is its smallest, and its others are linked to that.
    held = sketches.where("n > 0").select("id", "fp").distinct()
    nodes = written(held.groupBy("id").agg(F.min("fp").alias("node")), "jaccard-nodes")
    equal = held.join(shuffled(nodes), "id").where("fp <> node").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    edges = near.unionByName(equal)

    sets = sketches.where("n > 0").dropDuplicates(["id", "id2"])
    rows = sets.select(F.explode("prefix").alias("token"), "id", "n")
    known = written(sketches.where("n > 0").select("id", "id2", "bits").dropDuplicates(["id", "id2"]), "jaccard-known")
    sizes = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, and their sizes na, nb) that sizes and parities don't rule out; both hold for every similar pair."""
        x, y = (known.select(F.col("id").alias(i), F.col("bits").alias(f"x{i}")) for i in "ab")
        half = lambda x: F.expr(f"shiftright(size({x}), 1)")
        fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
        short = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(F.col(x))
        apart = F.aggregate(F.zip_with(short("xa", "xb"), short("xb", "xa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, e: t + e)
        near = apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
        return pairs.where(sizes).distinct().join(shuffled(x), "a").join(shuffled(y), "b").where(near).select("a", "b").distinct()

    group = Window.partitionBy("token")
    own = F.struct("id", "n")
    met = rows.withColumns({"lo": F.min(own).over(group), "hi": F.max(own).over(group)}).where("lo.id < hi.id")
    met = written(met, "jaccard-groups")

    def as_edges(pairs: DataFrame) -> DataFrame:
        a, b = nodes.select(F.col("id").alias("a"), F.col("node").alias("u")), nodes.select(F.col("id").alias("b"), F.col("node").alias("v"))
        return pairs.join(shuffled(a), "a").join(shuffled(b), "b").where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"))

    first = met.select(F.col("lo.id").alias("a"), F.col("id").alias("b"), F.col("lo.n").alias("na"), F.col("n").alias("nb"))
    last = met.select(F.col("id").alias("a"), F.col("hi.id").alias("b"), F.col("n").alias("na"), F.col("hi.n").alias("nb"))
    spokes = written(plausible(first.unionByName(last).where("a < b")), "jaccard-spokes")
    star = as_edges(_verified(spokes, docs, sketches, size, percent))
    edges = written(edges.unionByName(star).distinct(), "jaccard-edges")

    # What is connected already needn't be compared.
    roots = simhash.components(edges)
    label = nodes.join(shuffled(roots), "node", "left").select("id", F.coalesce("root", "node").alias("label"))
    open_ = met.select("token", "id", "n").join(shuffled(label), "id")
    mixed = open_.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi")
    open_ = written(open_.join(shuffled(mixed.select("token", "members")), "token"), "jaccard-open")
    few = open_.where(F.col("members") <= SMALL)
    x = few.select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = few.select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    pairs = x.join(shuffled(y), (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sizes)
    pairs = plausible(pairs.select("a", "b", "na", "nb")).unionByName(_in_blocks(open_.where(F.col("members") > SMALL), known, percent))
    pairs = written(pairs.distinct().join(shuffled(spokes), ["a", "b"], "left_anti"), "jaccard-pairs")
    edges = edges.unionByName(as_edges(_verified(pairs, docs, sketches, size, percent)))
    return simhash.named(prints, edges)
