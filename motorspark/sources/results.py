"""Result sets that runs extend: keyed, idempotent, safe against runs that end half way.

A run writes its rows under a folder of its own and then, as the last step,
one row for each key into the manifest. What counts of a key is the run that
the manifest names last, so a run that died leaves nothing that is read, a
repeated run doubles nothing, and keys without any row are known to be done.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ResultStore:
    """Results under ``path``, of the columns ``schema`` (DDL or a struct), each of whose rows belongs to one of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str] = ("session",)):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _part(self, name: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """keys, run: the last run of each key."""
        schema = StructType([*(self.schema[k] for k in self.keys)]).add("run", "string").add("at", "long")
        return self._part("manifest", schema).groupBy(*self.keys).agg(F.max_by("run", F.struct("at", "run")).alias("run"))

    def missing(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` that no run has finished; null keys are keys like any other."""
        done = self.manifest().select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return keys.select(*self.keys).distinct().join(done, same, "left_anti")

    def upsert(self, rows: DataFrame, keys: DataFrame | None = None) -> str:
        """Store ``rows`` in place of what their keys had; ``keys`` are done too where they have no row. Returns the run."""
        run = uuid.uuid4().hex
        data = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if keys is not None and keys.isEmpty():
            return run
        data.write.parquet(f"{self.path}/data/run={run}")
        own = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/run={run}").select(*self.keys)
        if keys is not None:
            own = own.unionByName(keys.select(*self.keys))
        own.distinct().withColumns({"run": F.lit(run), "at": F.lit(time.time_ns())}).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return run

    def read(self) -> DataFrame:
        """What counts: of every key the rows of its last finished run."""
        schema = StructType([*self.schema.fields]).add("run", "string")
        last = self.manifest().select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.col("run").alias("_run"))
        same = F.col("run") == F.col("_run")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return self._part("data", schema).join(last, same, "left_semi").drop("run")
