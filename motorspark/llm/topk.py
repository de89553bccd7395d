"""Exact top-k search by inner product with M-trees.

Vectors are integers. Adding one coordinate, sqrt(M^2 - |x|^2) with M the
largest norm, makes the largest inner product the smallest Euclidean distance
(for a query with 0 there), so a metric tree applies.

Distinct vectors are dealt to cells around pivots, large cells into blocks by
a hash, and every block becomes an M-tree: paged nodes with a routing object,
its covering radius and its distance to its parent. A query is searched best
first. A child or an entry is passed over without computing its distance
where the stored parent distance and the triangle inequality already put it
beyond the k-th best; scores of what remains are exact integers.

Queries go in groups. First each looks into the block of its own vector, which
gives it a k-th score to beat; then the groups go to all cells that the
triangle inequality can't rule out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from motorspark.llm._io import shuffled, small_batches, written

#: Pivots, taken from a sample of this many vectors by hash; vectors in a block; entries in a page; children in a node; queries in a group.
PIVOTS, BLOCK, PAGE, FAN, GROUP = 16, 8192, 128, 8, 256
#: Lengths of vectors that have trees: the most frequent ones. Vectors of other lengths go the way of the large ones.
LENGTHS = 16
#: Norms of this size or more would not keep sums of products within a long; vectors that have one go a way of their own.
LIMIT = float(1 << 20)
#: Room for rounding in a distance, as a share of the norm that all points have.
SLACK = 1e-6
#: Up to this squared norm, inner products are exact in doubles.
EXACT = 1 << 52
#: Bits of a limb, and columns whose products of limbs are summed in doubles: 2^40 times 2^12 is exact.
LIMB_BITS, LIMB_COLUMNS = 20, 4096
#: Queries, and vectors, in a block of the large ones' way.
LARGE_BLOCK = 128


def augment(x: np.ndarray, most: int) -> np.ndarray:
    """Integer vectors with the coordinate that makes all norms sqrt(most)."""
    return np.concatenate((x.astype(np.float64), np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]), 1)


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - q) ** 2).sum(-1))


class MTree:
    """An M-tree in arrays: nodes, and entries in the order of their leaves."""

    def __init__(self, x: np.ndarray, ids: list[list[int]], most: int):
        self.most = most
        points = augment(x, most)
        nodes: list[list] = []  # center (entry), radius, distance to the parent's center, first, last, leaf
        order: list[int] = []
        entry_distance: list[np.ndarray] = []

        def add(members: np.ndarray, center: int, parent: int | None) -> list:
            d = distances(points[members], points[center])
            return [center, float(d.max()), 0.0 if parent is None else float(distances(points[center], points[parent])), members]

        every = np.arange(len(x))
        middle = int(distances(points, points.mean(0)).argmin())
        todo = [add(every, middle, None)]
        nodes.append([*todo[0][:3], 0, 0, False])
        at = 0
        while at < len(todo):
            center, _, _, members = todo[at]
            if len(members) <= PAGE:
                nodes[at][3:] = [len(order), len(order) + len(members), True]
                far = distances(points[members], points[center])
                nearest = np.argsort(far, kind="stable")
                members = members[nearest]
                entry_distance.append(far[nearest])
                order.extend(members.tolist())
            else:
                n = min(FAN, -(-len(members) // PAGE))
                seeds = [int(members[0])]
                far = distances(points[members], points[seeds[0]])
                nearest = np.zeros(len(members), np.int64)
                while len(seeds) < n and far.max() > 0:
                    seeds.append(int(members[far.argmax()]))
                    d = distances(points[members], points[seeds[-1]])
                    nearest[d < far] = len(seeds) - 1
                    far = np.minimum(far, d)
                if len(seeds) == 1 or np.bincount(nearest).max() == len(members):
                    nearest, seeds = np.arange(len(members)) % n, [int(members[i]) for i in range(n)]
                nodes[at][3:] = [len(nodes), len(nodes) + len(seeds), False]
                for k, s in enumerate(seeds):
                    todo.append(add(members[nearest == k], s, center))
                    nodes.append([*todo[-1][:3], 0, 0, False])
            todo[at] = (center, 0.0, 0.0, None)
            at += 1
        self.centers = points[[n[0] for n in nodes]]
        self.radius, self.parent = np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes])
        self.first, self.last, self.leaf = np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes]), np.array([n[5] for n in nodes])
        self.x, self.entry = x[order], np.concatenate(entry_distance)
        if most < EXACT:
            self.x = self.x.astype(np.float64)
        self.ids = [ids[i] for i in order]
        self.computed = 0

    def reach(self, norm: int, score: float) -> float:
        """The distance within which a vector scores at least ``score`` for a query of this squared norm."""
        if score == -np.inf:
            return np.inf
        return float(np.sqrt(max(norm + self.most - 2 * score, 0.0))) * (1 + 1e-9) + SLACK * float(np.sqrt(self.most))

    def search(self, q: np.ndarray, own: int | None, k: int, beat: float = -np.inf) -> list[tuple[int, int]]:
        """The k largest (score, id) with score >= beat, ties to smaller ids, without the id ``own``."""
        return self.search_all(q[None], [own], k, [beat])[0]

    def search_all(self, q: np.ndarray, own: Sequence[int | None], k: int, beat: Sequence[float]) -> list[list[tuple[int, int]]]:
        """``search`` for each row of ``q``. A node is taken once, with those queries whose bound it doesn't lie beyond."""
        norm, points = (q * q).sum(1), np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), 1)
        q = q.astype(self.x.dtype)
        best: list[list[tuple[int, int]]] = [[] for _ in q]  # (-score, id), sorted
        floor = list(beat)
        limit = np.array([self.reach(int(n), b) for n, b in zip(norm, beat, strict=True)])
        start = distances(self.centers[0], points)
        lower = np.maximum(start - self.radius[0], 0.0)
        # The least bound, the node, and of its queries their places, bounds and distances to the node's object.
        heap = [(float(lower.min()), 0, np.arange(len(q)), lower, start)]
        self.computed += len(q)
        while heap:
            _, node, asked, lower, d = heapq.heappop(heap)
            live = lower <= limit[asked]
            if not live.any():
                continue
            asked, d = asked[live], d[live]
            a, b = self.first[node], self.last[node]
            if self.leaf[node]:
                # Entries lie in the order of their distance to the page's object, so those that a bound leaves are one run.
                low = a + np.searchsorted(self.entry[a:b], d - limit[asked])
                high = np.minimum(b, a + np.searchsorted(self.entry[a:b], d + limit[asked]) + 1)
                some = low < high
                if not some.any():
                    continue
                asked, low, high = asked[some], int(low[some].min()), int(high[some].max())
                self.computed += (high - low) * len(asked)
                scores = q[asked] @ self.x[low:high].T
                good = scores >= np.array([floor[i] for i in asked])[:, None]
                for at in np.flatnonzero(good.any(1)):
                    i = int(asked[at])
                    best[i] += [(-int(scores[at, e]), v) for e in np.flatnonzero(good[at]) for v in self.ids[low + e] if v != own[i]]
                    best[i] = sorted(best[i])[:k]
                    if len(best[i]) == k:
                        floor[i] = -best[i][-1][0]
                        limit[i] = min(limit[i], self.reach(int(norm[i]), floor[i]))
            else:
                near = np.abs(self.parent[a:b] - d[:, None]) - self.radius[a:b] <= limit[asked][:, None]
                self.computed += int(near.sum())
                # All points have the same norm, so a product gives the distance.
                there = np.sqrt(np.maximum(self.most + norm[asked][:, None] - 2 * (points[asked] @ self.centers[a:b].T), 0.0))
                lower = np.maximum(there - self.radius[a:b], 0.0)
                near &= lower <= limit[asked][:, None]
                for c in np.flatnonzero(near.any(0)):
                    some = near[:, c]
                    heapq.heappush(heap, (float(lower[some, c].min()), int(a + c), asked[some], lower[some, c], there[some, c]))
        return [[(-s, v) for s, v in x] for x in best]


def _finite(vectors: DataFrame) -> DataFrame:
    """vec_id, ``x`` (array<double>) and whether it is ``large`` of the rows that take part."""
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e)
    return rows.withColumn("large", F.exists("x", lambda e: F.abs(e) >= LIMIT) | (square >= LIMIT * LIMIT))


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers in doubles as sums of limbs times 2^LIMB_BITS^k, the lowest first; each below 2^LIMB_BITS."""
    if not np.isfinite(x).all():
        raise ValueError("a component times the scale is beyond a double")
    top = int(np.frexp(np.abs(x).max(initial=1.0))[1])
    out = []
    for k in reversed(range(-(-top // LIMB_BITS))):
        limb = np.trunc(np.ldexp(x, -LIMB_BITS * k))
        x = x - np.ldexp(limb, LIMB_BITS * k)
        out.append(limb)
    return out[::-1]


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, as Python's integers: products of limbs are exact in doubles."""
    xs, ys = _limbs(x), _limbs(y)
    by_place = [np.zeros((len(x), len(y)), np.int64) for _ in range(len(xs) + len(ys) - 1)]
    for i, a in enumerate(xs):
        for j, b in enumerate(ys):
            for at in range(0, x.shape[1], LIMB_COLUMNS):
                by_place[i + j] += (a[:, at : at + LIMB_COLUMNS] @ b[:, at : at + LIMB_COLUMNS].T).astype(np.int64)
    out = np.zeros((len(x), len(y)), object)
    for k, m in enumerate(by_place):
        out += m.astype(object) * (1 << LIMB_BITS * k)
    return out


def _with_large(rows: DataFrame, k: int, every: int, scale: float) -> DataFrame:
    """query_id, mark, vec_id, score of the pairs that have a large vector: of each query the k best of each block.

    Queries and vectors are in blocks of LARGE_BLOCK, and every pair of blocks is a
    row of its own, dealt by both block numbers.
    """
    distinct = written(rows.dropDuplicates(["x", "vec_id"]).withColumns({"n": F.size("x"), "mark": F.xxhash64("x")}), "topk-large-rows")
    asked = distinct.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "mark", F.col("x").alias("q"), F.col("large").alias("_ql"), "n")
    large, queries = distinct.where("large"), asked.where("_ql")
    # Every query with the large vectors, and every large query with the others.
    sides = ((asked, large), (queries, distinct.where("NOT large")))
    schema = "query_id long, mark long, vec_id long, score long"

    def products(batches):
        for batch in batches:
            out: list[dict] = []
            for qs, vs in zip(batch.column("qs").to_pylist(), batch.column("vs").to_pylist(), strict=True):
                width = len(vs[0]["x"])
                x, y = (np.floor(np.array([r[c] for r in rows_], np.float64).reshape(len(rows_), width) * scale) for rows_, c in ((qs, "q"), (vs, "x")))
                ids = [v["vec_id"] for v in vs]
                for q, scores in zip(qs, exact_products(x, y), strict=True):
                    best = heapq.nsmallest(k, ((-s, i) for s, i in zip(scores, ids, strict=True) if i != q["query_id"]))
                    for s, i in best:
                        if not -(1 << 63) <= -s < 1 << 63:
                            raise ValueError(f"the score of vectors {q['query_id']} and {i} is beyond a long")
                        out.append({"query_id": q["query_id"], "mark": q["mark"], "vec_id": i, "score": -s})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.int64()) for c in ("query_id", "mark", "vec_id", "score")]))

    found = None
    for left, right in sides:
        many, others = (max(1, -(-side.count() // LARGE_BLOCK)) for side in (left, right))
        deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        a = left.groupBy("n", deal(many, "query_id", "mark").alias("_g")).agg(F.collect_list(F.struct("query_id", "mark", "q")).alias("qs")).withColumn("_h", copies(others))
        b = right.groupBy("n", deal(others, "vec_id", "mark").alias("_h")).agg(F.collect_list(F.struct("vec_id", "x")).alias("vs")).withColumn("_g", copies(many))
        part = a.join(shuffled(b), ["n", "_g", "_h"]).select("qs", "vs").mapInArrow(products, schema)
        found = part if found is None else found.unionByName(part)
    return found


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each row whose vec_id divides by ``every``.

    Vectors that are null, or hold a null or a number that isn't finite, take
    no part, nor do rows without vec_id. Those with a norm of 2^20 or more
    are compared in integers of any length; a score that no long holds is an
    error that names the vectors, as a cast in SQL is. Vectors of one length are compared with each
    other only; beyond the LENGTHS most frequent lengths, without trees.
    Repeated rows count once; a vec_id with several vectors is a query for
    each, and all rows of its id are its own. Other columns are not read. An
    empty table gives an empty table.

    Cost: every group of GROUP queries meets every block of its length whose
    cell the triangle inequality leaves, so where vectors have little
    structure it grows with queries times vectors, as brute force does.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    every_row = _finite(vectors)
    counted = every_row.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS)
    lengths = sorted(r["n"] for r in counted.collect())
    every_row = every_row.withColumn("large", F.col("large") | ~F.size("x").isin(lengths))
    rows = every_row.where("NOT large").select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
    if every_row.where("large").limit(1).count():
        # A query is known by its id and vector; ``mark`` of the ordinary ones is that of the rounded vector.
        marks = F.when(F.col("large"), F.xxhash64("x")).otherwise(F.xxhash64(F.transform("x", lambda e: F.floor(e * scale))))
        extra = _with_large(every_row, k, every, scale)
        named = every_row.select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("mark"), marks.alias("_mark")).distinct()
        extra = extra.join(shuffled(named), ["query_id", "mark"]).select("query_id", F.col("_mark").alias("mark"), "vec_id", "score").distinct()
    else:
        extra = None
    parts = [_one_length(rows.where(F.size("v") == n), k, every) for n in lengths]
    parts = [p for p in parts if p is not None]
    if extra is not None:
        parts.append(extra)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def _one_length(rows: DataFrame, k: int, every: int) -> DataFrame | None:
    """The results among vectors of one length; none without vectors."""
    spark = rows.sparkSession
    # Of equal vectors only the k + 1 smallest ids can be among anyone's k best.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.dropDuplicates(["v", "vec_id"]).withColumn("_r", rank).where(F.col("_r") <= k + 1)
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e * e)
    distinct = written(kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("square", squares), "topk-distinct")
    most = distinct.agg(F.max("square")).first()[0]
    if most is None:
        return None
    pivots = np.array([r[0] for r in distinct.orderBy(F.xxhash64("v"), "v").limit(PIVOTS).select("v").collect()], np.int64)
    shared = spark.sparkContext.broadcast((augment(pivots, most), pivots, most))

    def assign(batches):
        points = shared.value[0]
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), np.int64).reshape(batch.num_rows, -1)
            own = augment(x, shared.value[2])
            d = np.stack([distances(own, p) for p in points], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=[*batch.schema.names, "cell", "d"])

    cells = written(distinct.select("v", "ids").mapInArrow(assign, "v array<long>, ids array<long>, cell int, d double"), "topk-cells")
    sizes = {r["cell"]: (r["n"], r["far"]) for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}
    salts = {c: -(-n // BLOCK) for c, (n, _) in sizes.items()}
    salt_of = F.element_at(F.create_map(*[F.lit(i) for cs in salts.items() for i in cs]), F.col("cell"))
    block = F.pmod(F.xxhash64("v", F.lit(1)), salt_of).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1), [list(map(int, i)) for i in pdf["ids"]], shared.value[2])
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "block": [pdf["block"].iloc[0]], "tree": [pickle.dumps(tree, 5)]})

    trees = written(
        cells.withColumn("block", block).select("cell", "block", "v", "ids").groupBy("cell", "block").applyInPandas(build, "cell int, block int, tree binary"),
        "topk-trees",
    )

    # Queries, in groups of one cell, each with the block its own vector lies in.
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["v", "vec_id"])
    asked = asked.select("vec_id", "v", F.array().cast("array<long>").alias("ids")).select("v", F.array("vec_id").alias("ids"))
    placed = asked.mapInArrow(assign, "v array<long>, ids array<long>, cell int, d double").select(
        F.col("ids")[0].alias("query_id"), "v", "cell", F.xxhash64("v").alias("mark")
    ).withColumn("block", block)
    queries = written(placed, "topk-queries")
    # Groups are dealt within their cell, so that none is small for its cell's share: each takes a copy of every tree it meets.
    many = {r["cell"]: -(-r["n"] // GROUP) for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return None
    groups_of = F.element_at(F.create_map(*[F.lit(i) for cn in many.items() for i in cn]), F.col("cell"))
    deal = F.pmod(F.xxhash64("query_id", "mark"), groups_of).cast("int")

    def look(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for blob, asked_now in zip(batch.column("tree"), batch.column("q"), strict=True):
                tree = pickle.loads(blob.as_py())
                asked = asked_now.as_py()
                beats = [-np.inf if q["beat"] is None else q["beat"] for q in asked]
                found = tree.search_all(np.array([q["v"] for q in asked], np.int64).reshape(len(asked), -1), [q["query_id"] for q in asked], k, beats)
                for q, best in zip(asked, found, strict=True):
                    for score, v in best:
                        for column, value in zip(out, (q["query_id"], q["mark"], v, score), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "mark", "vec_id", "score"])

    found = "query_id long, mark long, vec_id long, score long"
    one = F.struct("query_id", "mark", "v", "beat")
    home = (
        queries.withColumn("beat", F.lit(None).cast("long")).groupBy("cell", "block", deal.alias("g")).agg(F.collect_list(one).alias("q"))
        .join(shuffled(trees), ["cell", "block"]).select("q", "tree").mapInArrow(look, found)
    )
    first = written(home.groupBy("query_id", "mark").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")), "topk-first")
    beats = queries.join(shuffled(first), ["query_id", "mark"], "left").withColumn("beat", F.when(F.col("n") >= k, F.col("least")))
    far = {c: f for c, (_, f) in sizes.items()}

    def spread(batches):
        points, _, most = shared.value
        for batch in batches:
            for group in batch.column("q"):
                q = group.as_py()
                x = np.array([a["v"] for a in q], np.int64).reshape(len(q), -1)
                own = np.concatenate((x.astype(np.float64), np.zeros((len(q), 1))), 1)
                beat = np.array([-np.inf if a["beat"] is None else a["beat"] for a in q], np.float64)
                with np.errstate(invalid="ignore"):
                    reach = np.where(np.isinf(beat), np.inf, np.sqrt(np.maximum((x * x).sum(1) + most - 2 * beat, 0)) * (1 + 1e-9) + SLACK * np.sqrt(most))
                live = {c: distances(own, points[c]) - radius <= reach for c, radius in far.items()}
                cells = [c for c, yes in live.items() if yes.any()]
                chosen = [[a for a, yes in zip(q, live[c], strict=True) if yes] for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array(chosen, batch.schema.field("q").type), pa.array(cells, pa.int32())], names=["q", "cell"])

    groups = beats.groupBy("cell", deal.alias("g")).agg(F.collect_list(one).alias("q")).select("q")
    kind = "array<struct<query_id:long,mark:long,v:array<long>,beat:long>>"
    # Copies for the blocks of a cell are made row by row, so that no batch holds a group once a block.
    sent = groups.mapInArrow(spread, f"q {kind}, cell int").withColumn("block", F.explode(F.sequence(F.lit(0), salt_of - 1)))
    return sent.join(shuffled(trees), ["cell", "block"]).select("q", "tree").mapInArrow(look, found)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id divides by 50; odd rows as in ``top_k``."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""
