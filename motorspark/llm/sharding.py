"""Sharding [native]: k-d tree partitioning by bytes.

Documents are points in a space of metadata: id, size, language and source,
each as a number between 0 and 1 (id and the logarithm of the size over their
range, language and source by their rank in bytes). A node of the tree that
stands for several shards takes its widest dimension, the one with the largest
weighted deviation, and is cut at the weighted median of the bytes along it
(or at the share that its shard count asks for), until every leaf is one
shard.

Once, all dimensions are divided into cells of about equal bytes, a small
share of a shard each; values that hold more (a hot source) are divided by a
hash. Then each level of the tree is one pass: the bytes in all cells of all
dimensions and nodes are summed together, running sums give each node's cut in
each dimension, and only these, four a node, reach the driver. DataFrame
functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorspark.llm._io import documents, with_slots, written

DIMS = ("id", "size", "lang", "source")
#: Steps of a dimension's values; cells of equal bytes in each dimension for one shard.
STEPS, CELLS = 4096, 512
#: Languages and sources that have a rank; what is rarer comes after them.
RANKED = 1000
#: Bits of the hash that divides rows of one step.
TIE_BITS = 30


@dataclass
class Node:
    """A part of the space that holds ``shards`` shards, the first of them ``first``."""

    first: int
    shards: int
    dim: str = DIMS[0]
    cut: int = -1  # cells up to this one go left
    left: Node | None = None
    right: Node | None = None


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the raw metadata and the hash that tells equal values apart."""
    text = F.coalesce("text", F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    base = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        name("lang").alias("_lang"), name("source").alias("_source"),
    )
    return base.withColumn("_tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - TIE_BITS))


def _values(base: DataFrame) -> DataFrame:
    """``base`` with its four coordinates between 0 and 1, as columns named x_ and the dimension."""
    # One pass: bytes of each language and each source, and the ranges of id and size.
    counted = base.groupingSets([["_lang"], ["_source"], []], "_lang", "_source").agg(
        F.grouping_id().alias("_set"), F.sum("size").alias("w"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("size").alias("c"), F.max("size").alias("d")
    )
    rank = F.row_number().over(Window.partitionBy("_set").orderBy(F.desc("w"), "_lang", "_source"))
    top = counted.withColumn("r", rank).where(F.col("r") <= RANKED).collect()
    whole = next((r for r in top if r["_set"] == 3), None)
    log = lambda c: F.log2(F.col(c).cast("double"))
    unit = lambda x, a, b: F.coalesce(F.greatest(F.least((x - a) / (b - a), F.lit(1.0)), F.lit(0.0)), F.lit(0.0)) if whole and a is not None and b > a else F.lit(0.0)
    out = base.withColumn("x_id", unit(F.col("doc_id").cast("double"), whole and whole["a"], whole and whole["b"]))
    lo, hi = (math.log2(whole["c"]), math.log2(whole["d"])) if whole and whole["c"] else (None, None)
    out = out.withColumn("x_size", unit(log("size"), lo, hi))
    for column, x, own in (("_lang", "x_lang", 1), ("_source", "x_source", 2)):
        ranks = [(r[column], r["r"] - 1) for r in top if r["_set"] == own]
        # At most RANKED rows.
        known = F.broadcast(base.sparkSession.createDataFrame(ranks, f"{column} string, _r int"))
        out = out.join(known, column, "left").withColumn(x, F.coalesce("_r", F.lit(len(ranks))) / F.lit(float(max(len(ranks) - 1, 1)))).withColumn(x, F.least(x, F.lit(1.0))).drop("_r")
    return out


def points(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, and of each dimension the value (x_) and the cell (c_) of every row."""
    base = written(_values(written(_base(docs), "shard-base")), "shard-values")
    step = lambda d: F.floor(F.col(f"x_{d}") * (STEPS - 1)).cast("int")
    each = base.select("size", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), step(d).alias("step")) for i, d in enumerate(DIMS)])).alias("_p"))
    weights = each.groupBy("_p.dim", "_p.step").agg(F.sum("size").alias("w"))
    # At most STEPS rows a dimension from here on.
    before = Window.partitionBy("dim").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    # In whole numbers, so that a step begins in the cell where the one before it ends, or later.
    n = CELLS * shards
    weights = weights.withColumns({"_run": F.coalesce(F.sum("w").over(before), F.lit(0)), "_all": F.sum("w").over(Window.partitionBy("dim"))})
    cells = weights.select("dim", "step", F.expr(f"cast(_run * {n} div _all as int)").alias("_first"), F.expr(f"cast((w * {n} + _all - 1) div _all as int)").alias("_parts"))
    cells = written(cells, "shard-cells")
    out = base
    for i, d in enumerate(DIMS):
        own = F.broadcast(cells.where(F.col("dim") == i).select(F.col("step").alias("_step"), "_first", "_parts"))
        cell = F.col("_first") + F.floor(F.col("_tie") * F.col("_parts") / float(1 << TIE_BITS)).cast("int")
        out = out.join(own, step(d) == F.col("_step")).withColumn(f"c_{d}", cell).drop("_step", "_first", "_parts")
    return written(out.select("doc_id", "size", "text_crc32", *[f"{k}_{d}" for d in DIMS for k in "xc"]), "shard-points")


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _route(node: Node) -> Column:
    """The number of the leaf that holds a row, as an expression."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(f"c_{node.dim}") <= node.cut, _route(node.left)).otherwise(_route(node.right))


def _cuts(rows: DataFrame, root: Node, nodes: list[Node]) -> None:
    """Give every node of a level its widest dimension and its cut, in one pass over the rows."""
    many = lambda value: F.element_at(F.create_map(*[F.lit(x) for n in nodes for x in (n.first, value(n))]), F.col("_node"))
    dims = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"c_{d}").alias("cell"), F.col(f"x_{d}").alias("x")) for i, d in enumerate(DIMS)])
    each = rows.withColumn("_node", _route(root)).where(F.col("_node").isin([n.first for n in nodes])).select("_node", "size", F.explode(dims).alias("_p"))
    x = F.col("_p.x")
    cells = each.groupBy("_node", "_p.dim", "_p.cell").agg(F.sum("size").alias("w"), F.sum(x * F.col("size")).alias("s"), F.sum(x * x * F.col("size")).alias("q"))
    # At most as many rows as a dimension has cells.
    whole = Window.partitionBy("_node", "dim")
    run = F.coalesce(F.sum("w").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("w").over(whole)
    width = F.sum("q").over(whole) / total - (F.sum("s").over(whole) / total) ** 2
    shards, left = many(lambda n: n.shards), many(lambda n: n.shards // 2)
    at = cells.select("_node", "dim", "cell", "w", run.alias("run"), (total * left).alias("goal"), width.alias("width"), shards.alias("n"))
    after = (F.col("run") + F.col("w")) * F.col("n") - F.col("goal")
    # The cell that crosses the goal goes left as a whole where that is nearer.
    crossing = at.where((F.col("run") * F.col("n") < F.col("goal")) & (after >= 0))
    cut = F.when(after <= F.col("goal") - F.col("run") * F.col("n"), F.col("cell")).otherwise(F.col("cell") - 1)
    found: dict[int, list] = {}
    for r in crossing.select("_node", "dim", cut.alias("cut"), "width").collect():
        found.setdefault(r["_node"], []).append((-round(max(r["width"], 0.0), 9), r["dim"], r["cut"]))
    for n in nodes:
        if n.first in found:
            _, dim, n.cut = min(found[n.first])
            n.dim = DIMS[dim]
        a = n.shards // 2
        n.left, n.right = Node(n.first, a), Node(n.first + a, n.shards - a)


def tree(rows: DataFrame, shards: int) -> Node:
    """The k-d tree over ``points``, cut level by level."""
    root = Node(0, shards)
    while todo := [n for n in _leaves(root) if n.shards > 1]:
        _cuts(rows, root, todo)
    return root


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32 and ``shard`` for every row of ``docs``.

    A null text has size 8 and checksum 0; a null id is the least id, a null
    language or source is the empty one. Repeated rows have equal coordinates
    and share a shard; copies of a text with ids of their own needn't. An
    empty table gives an empty table. Columns of ``docs`` beyond doc_id, text,
    lang and source are not read, and those two may be missing.
    """
    rows = points(docs, shards)
    return rows.select("doc_id", "size", "text_crc32", _route(tree(rows, shards)).cast("int").alias("shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, numbered within each.

    Null and empty texts have size 8; rows with one id, text and size are told
    apart by their slot only; an empty table gives an empty table.
    """
    placed = shard_by_bytes(documents(spark, sf_dir), 24)
    slotted = with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
