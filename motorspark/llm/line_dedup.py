"""Line dedup [native]: drop lines that other documents hold already.

Lines are normalised, exploded and hashed; documents are counted per hash with
partial aggregation; lines over the threshold go from every document but the
first; and each text is reassembled from the positions it keeps. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm._io import documents, join_counted, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(key: Column) -> Column:
    """Two hashes of a key with seeds of their own.

    Spark takes the hash of one column as the seed of the next, so a constant
    after the key would make ``b`` a function of ``a``.
    """
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the columns ``n_lines``, ``n_dropped`` and ``kept`` added.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses all its lines except in the smallest ``doc_id`` holding it.

    Null or empty text: one empty line, kept. A null ``doc_id`` counts as one
    document after all others. Rows that repeat a ``doc_id`` are one document
    when counting, and each of them comes back. Columns of ``docs`` stay as
    they are, except that ``n_lines``, ``n_dropped`` and ``kept`` are replaced.
    An empty table gives an empty table.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    base = docs.select(*own, F.coalesce("doc_id", F.lit(LAST)).alias("_doc"), F.xxhash64("text").alias("_mark"))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines")
    keys = F.transform(
        "_lines",
        lambda x: F.when(F.length(line_key(x)) >= min_chars, line_key(x)),
    )
    hashed = F.transform(keys, lambda k: F.when(k.isNotNull(), line_hashes(k)))
    # A short line has no hash and can't be dropped, so it isn't exploded.
    places = F.filter(
        F.transform(hashed, lambda h, i: F.struct(i.alias("at"), h.alias("h"))),
        lambda p: p["h"].isNotNull(),
    )
    lines = base.select("_doc", "_mark", split).select("_doc", "_mark", F.explode(places).alias("p")).select(
        "_doc", "_mark", F.col("p.at").alias("at"), F.col("p.h.a").alias("a"), F.col("p.h.b").alias("b")
    )
    # Lines are parsed and hashed once. Hash a | b stands for the key: 128 bits, so chance equality is out of reach.
    lines = written(lines, "line-keys")
    if min_docs == 2:
        common = lines.groupBy("a", "b").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_last > _first")
    else:
        common = (
            lines.groupBy("a", "b", "_doc").agg(F.count(F.lit(1)).alias("_m")).groupBy("a", "b")
            .agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_docs"), F.sum("_m").alias("_n")).where(F.col("_docs") >= min_docs)
        )
    common = written(common.select("a", "b", "_first", "_n"), "line-common")
    met = join_counted(lines, common, ["a", "b"], "_n")
    drops = (
        met.where(F.col("_doc") > F.col("_first"))
        .groupBy("_doc", "_mark").agg(F.collect_set("at").alias("_drop"))
    )
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.array_except(every, F.coalesce("_drop", F.array().cast("array<int>")))
    joined = base.join(drops.hint("shuffle_hash"), ["_doc", "_mark"], "left").select(*own, "_drop", split)
    joined = joined.withColumn("_mended", F.when(F.col("_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")))
    return joined.select(
        *own,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_mended").alias("kept"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what is kept of every document; odd rows as in ``dedup_lines``."""
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(d.a) AS line, generate_subscripts(d.a, 1) AS pos) u),
firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.doc_id, l.pos, l.line, (f.k IS NOT NULL AND l.doc_id <> f.first) AS gone
  FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
