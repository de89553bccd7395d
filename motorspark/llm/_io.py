"""Shared-folder tables and small helpers used by the operators of this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session names one. A session without
    it gets a folder of our own, which its settings don't learn of: with a
    local master (tests) a temporary one that goes at exit, on a cluster one
    under a warehouse that lies in a shared store. A cluster with neither is
    an error: executors would write where nobody else can read. Tables in the
    folder stay until it is cleaned; their names begin with their operator's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        if spark.sparkContext.master.split("[")[0] == "local":
            made = tempfile.mkdtemp(prefix="motorspark-")
            atexit.register(shutil.rmtree, made, True)
            _OWN[application] = f"file://{made}"
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if urlsplit(warehouse).scheme in ("", "file"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            _OWN[application] = f"{warehouse.rstrip('/')}/_motorspark"
    return _OWN[application]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors are answered from the files, and several
    readers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what a task hands to Python at once: 512 rows, and 8 MB where rows are long.

    The session's default (10,000 rows) would hold a gigabyte of very long
    texts, in the executor and in the worker. Smaller settings stay. Spark
    reads these settings from the session when a plan runs, so they stay
    changed after the call; nothing but the size of batches hangs on them.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 512), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is made by a shuffle, whatever its size.

    Spark sizes a stored table by its compressed bytes, an array as one
    element, and leaves out what explode and Python functions multiply. By that
    it may broadcast a table that the driver can't hold.
    """
    return df.hint("merge")


#: A key with more than this part of all rows is hot.
HOT = 1000


def join_counted(rows: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``right``, which has one row a key and in ``n`` the number of ``rows`` with that key.

    A key with over a thousandth of all rows would be one task's: there are
    fewer than HOT such keys, so they are broadcast. The others are shuffled.
    Both sides are read twice.
    """
    added = [c for c in right.columns if c not in (*keys, n)]
    hot = F.broadcast(right.where(F.col(n) * HOT > rows.count()).drop(n).withColumn("_hot", F.lit(True)))
    met = rows.join(hot, keys, "left")
    rest = met.where("_hot IS NULL").drop("_hot", *added).join(shuffled(right.drop(n)), keys)
    return met.where("_hot").drop("_hot").unionByName(rest)


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    """What a worker process keeps between tasks under ``key``; only the last key's stays, so that stages don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def with_columns(df: DataFrame, added: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns of the schema ``added``, made batch by batch from its rows.

    Columns of ``df`` with the same names are replaced.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in StructType.fromDDL(added).fields]
    own = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=[*batch.schema.names, *names])

    return own.mapInArrow(run, StructType([*own.schema.fields, *StructType.fromDDL(added).fields]))


def with_slots(df: DataFrame, group: str, order: list[str], slot: str) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, as column ``slot``.

    A group may hold any share of all rows, so it is never sorted as one: rows
    are dealt into buckets by a hash of ``order``, numbered within their
    bucket, and each bucket starts where the buckets before it end. The
    number of buckets follows the shuffle partitions. ``df`` is read twice.
    """
    from pyspark.sql import Window

    n = max(32, partitions(df.sparkSession))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        dealt.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, [group, "_bucket"])
        .withColumn(slot, F.col("_start") + F.col("_in"))
        .drop("_bucket", "_in", "_start")
    )
