"""The corpus pipeline: toxicity, language, repeated lines, near-duplicates, packing.

Each stage takes what its predecessor kept, applies one operator of
``motorspark.llm`` to all of it, and lets its decisions take effect. ``run``
writes every stage but the last as Parquet and reads it again. Columns beyond
doc_id, text, lang and n_chars pass through as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorspark.llm import langid, line_dedup, packing, simhash, toxicity
from motorspark.llm._io import documents, written


#: Columns that the operators read or that a stage changes; all others pass under names that nothing can clash with.
READ = ("doc_id", "text", "lang", "n_chars")


def _carried(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` keeps of ``docs``, with the caller's columns as they were, whatever columns it adds."""
    plain = [c if c in READ else f"_carried_{i}" for i, c in enumerate(docs.columns)]
    kept = operator(docs.toDF(*plain))
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network doesn't call toxic; it is fitted on the labelled ones among them.

    Null and empty texts have score 0 and stay. Rows that repeat an id are
    judged each; equal texts alike. Labels of null ids are not used. Without
    labels of both classes every document stays or goes by the class there is.
    An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.train(docs.where(toxicity.fold(4) != 2), labels.where(toxicity.fold(4) != 2))
    return _carried(docs, lambda d: toxicity.toxicity(d, net).where("predicted = 0"))


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language's model accepts.

    Null and empty texts, and texts without a letter, go; a short text needs
    to be stranger than a long one to go. Repeated rows are judged each; equal
    texts alike. An empty table stays empty.
    """
    model = langid.train(docs.where(langid.fold(5) != 0))
    return _carried(docs, lambda d: langid.detect(d, model).where("NOT rejected"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; none goes, though a text can become empty.

    A null text becomes an empty one; n_chars, where there is such a column,
    is counted anew. Rows that repeat an id are one document and keep their
    lines alike. A null id comes after all others.
    """

    def mend(d: DataFrame) -> DataFrame:
        kept = line_dedup.dedup_lines(d).withColumn("text", F.col("kept"))
        return kept.withColumn("n_chars", F.length("kept").cast("long")) if "n_chars" in d.columns else kept

    return _carried(docs, mend)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash links, and five-word sets with a similarity of 0.8 or more.

    The smallest id of a group stays, with all rows that have it. Texts
    without a word are copies of each other. Of rows without an id, those
    linked to one with an id go, and the others stay.
    """
    return _carried(docs, lambda d: simhash.keep_one(d, shingle=5, percent=80))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences; an empty text is its closing id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_no_language),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Four of the stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents`` to packed pieces."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
