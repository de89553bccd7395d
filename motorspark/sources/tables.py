"""Readers and writers of the table, frame, motion, marker, contact and meta files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Defaults of the session meta (fixed values); JSON files override them.
SESSION_DEFAULTS = {"fps": 50.0, "hand": "right", "experiment_type": "grasp"}

#: The setting by which tasks move their files to their places themselves.
COMMITTER = "mapreduce.fileoutputcommitter.algorithm.version"

#: The setting for the most tasks that list folders.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _number(c: str) -> Column:
    v = F.trim(F.col(f"`{c}`")).try_cast("double")
    return F.when(~F.isnan(v), v)


def _keep(name: str | None) -> str:
    return (name or "").strip()


def read_table_csv(spark: SparkSession, path: str | list[str], casts: dict[str, str] | None = None, sep: str = ",") -> DataFrame:
    """Header CSV with stripped names and without nameless empty columns.

    A column becomes double where all its cells that aren't empty are numbers
    (one pass over the file decides), else it stays a string; ``casts`` names
    the type of columns instead.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    named = [c for c in raw.columns if _keep(c) and not c.startswith("_c")]
    raw = raw.select(*[F.col(f"`{c}`").alias(_keep(c)) for c in named])
    free = [c for c in raw.columns if c not in (casts or {})]
    bad = raw.agg(*[F.count_if((F.trim(F.col(f"`{c}`")) != "") & F.trim(F.col(f"`{c}`")).try_cast("double").isNull()).alias(c) for c in free]).first() if free else {}
    return raw.select(*[F.col(f"`{c}`").try_cast(casts[c]).alias(c) if c in (casts or {}) else _number(c).alias(c) if not bad[c] else F.col(f"`{c}`") for c in raw.columns])


@contextmanager
def _listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Within it folders are listed by four tasks a core; else each of up to 10,000 folders is a task, which takes longer than to list it."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_timed_csv(spark: SparkSession, path: str | list[str], time: str = "time") -> DataFrame:
    """Long form (file, channel, t, value) of a CSV with a time column."""
    with _listed_by_few(spark):  # once for the header and once for the table
        raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    raw = raw.withColumn("_file", F.input_file_name())
    channels = [c for c in raw.columns if c.strip() not in (time, "_file") and not c.startswith("_c")]
    wide = raw.select("_file", F.trim(F.col(f"`{time}`")).try_cast("double").alias("t"), *[_number(c).alias(c.strip()) for c in channels])
    return wide.unpivot(["_file", "t"], [c.strip() for c in channels], "channel", "value").withColumnRenamed("_file", "file")


def read_matrix_csv(spark: SparkSession, path: str | list[str], rowscols: tuple[int, int] | None = None) -> DataFrame:
    """Frames (file, frame, t, sensels, n_rows, n_cols) of a CSV time, r1c1, r2c1, ...; the last header cell gives the size."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    cells = [c for c in raw.columns[1:] if c.strip() and not c.startswith("_c")]
    if rowscols is None:
        row, _, col = cells[-1].strip().lower().lstrip("r").partition("c")
        rowscols = int(row), int(col)
    if len(cells) != rowscols[0] * rowscols[1]:
        raise ValueError(f"{len(cells)} columns do not make {rowscols[0]} x {rowscols[1]} frames")
    f = raw.withColumn("file", F.input_file_name()).select("file", F.trim(F.col(f"`{raw.columns[0]}`")).try_cast("double").alias("t"), F.array(*[_number(c) for c in cells]).alias("sensels"))
    frame = F.row_number().over(Window.partitionBy("file").orderBy("t")) - 1
    return f.withColumns({"frame": frame, "n_rows": F.lit(rowscols[0]), "n_cols": F.lit(rowscols[1])})


def sensel_position(sensel: Column, n_rows: Column) -> tuple[Column, Column]:
    """Row and column, from 0, of a place in a column-major frame."""
    return sensel % n_rows, F.floor(sensel / n_rows)


def import_matrices(frames: DataFrame, zero_time_start: bool = True, equalize_period: float | None = None, force_positive: bool = True, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Time from 0; each sensel less its maximum up to ``equalize_period``; negatives to 0."""
    f = frames
    if zero_time_start:
        f = f.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy(*keys)))
    if equalize_period is not None:
        early = f.where(F.col("t") <= equalize_period).select(*keys, F.posexplode("sensels").alias("i", "x")).groupBy(*keys, "i").agg(F.max("x").alias("x"))
        base = early.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("_base"))
        f = f.join(base, list(keys), "left").withColumn("sensels", F.transform("sensels", lambda x, i: x - F.coalesce(F.try_element_at("_base", i), F.lit(0.0)))).drop("_base")
    if force_positive:
        f = f.withColumn("sensels", F.transform("sensels", lambda x: F.greatest(x, F.lit(0.0))))
    return f


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()).select("file", "value")


def _parsed(texts: DataFrame, parse, schema: str) -> DataFrame:
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, text in zip(b["file"], b["value"], strict=True):
                yield pd.DataFrame([(file, *row) for row in parse(text)], columns=names)

    return texts.mapInPandas(run, schema)


def _cell(x: str) -> float | None:
    try:
        v = float(x)
    except ValueError:
        return None
    return None if v != v else v


def _motion(text: str) -> Iterator[tuple]:
    lines = iter(text.splitlines())
    for line in lines:
        head = [h.strip() for h in line.split("\t")]
        if head[0].lower() == "time":
            break
    else:
        return
    for line in lines:
        cells = line.split("\t")
        if cells[0].strip():
            for name, x in zip(head[1:], cells[1:], strict=False):
                yield name, _cell(cells[0]), _cell(x)


def read_motion(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Long form of .mot files: tab-separated after the line that begins with ``time``."""
    return _parsed(_whole(spark, path), _motion, "file string, channel string, t double, value double")


def _trc(text: str) -> Iterator[tuple]:
    lines = text.splitlines()
    at = next((i for i, x in enumerate(lines) if x.lower().startswith("frame#")), None)
    if at is None:
        return
    names = [n.strip() for n in lines[at].split("\t")[2:] if n.strip()]
    for line in lines[at + 2 :]:
        c = line.split("\t")
        if not c[0].strip():
            continue
        for k, name in enumerate(names):
            xyz = [_cell(c[2 + 3 * k + j]) if len(c) > 2 + 3 * k + j else None for j in range(3)]
            yield int(float(c[0])), _cell(c[1]), name, *xyz, None


def _two_headers(text: str) -> Iterator[tuple]:
    rows = [line.split(",") for line in text.splitlines() if line.strip()]
    if len(rows) < 2:
        return
    parts, axes = [x.strip() for x in rows[0]], [x.strip() for x in rows[1]]
    for r in rows[2:]:
        found: dict[str, dict[str, float | None]] = {}
        for part, axis, x in zip(parts[1:], axes[1:], r[1:], strict=False):
            found.setdefault(part, {})[axis] = _cell(x)
        for name, v in found.items():
            yield int(float(r[0])), None, name, v.get("x"), v.get("y"), v.get("z"), v.get("confidence")


def read_markers(spark: SparkSession, path: str | list[str], trc: bool = True) -> DataFrame:
    """Markers (file, frame, t, marker, x, y, z, confidence) of .trc files, or of CSV files with two header lines."""
    return _parsed(_whole(spark, path), _trc if trc else _two_headers, "file string, frame int, t double, marker string, x double, y double, z double, confidence double")


def parse_contacts(lines: DataFrame, keys: Sequence[str] = ("file", "frame"), column: str = "value") -> DataFrame:
    """Cells ``row.col:segment:dist`` of each line as rows."""
    cell = lines.select(*keys, F.explode(F.split(column, ",")).alias("c")).where(F.trim("c") != "")
    p, rc = F.split(F.trim("c"), ":"), F.split(F.get(F.split(F.trim("c"), ":"), F.lit(0)), r"\.")
    return cell.select(*keys, F.get(rc, F.lit(0)).try_cast("int").alias("row"), F.get(rc, F.lit(1)).try_cast("int").alias("col"), F.get(p, F.lit(1)).alias("segment"), F.get(p, F.lit(2)).try_cast("double").alias("dist"))


def read_contacts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    whole = _whole(spark, path).select("file", F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("frame", "value"))
    return parse_contacts(whole)


def read_session_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Session structure JSON with the defaults filled in."""
    schema = "session string, fps double, hand string, experiment_type string, ps_dic map<string,string>, skip_trials array<int>"
    f = spark.read.schema(schema).option("multiLine", True).json(path)
    return f.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in SESSION_DEFAULTS.items()} | {"skip_trials": F.coalesce("skip_trials", F.array().cast("array<int>"))})


def explode_ragged_units(units: DataFrame, keys: Sequence[str] = ("session",), order: str = "unit_idx", stop: str = "stop", flat: str = "flat") -> DataFrame:
    """Spikes (keys, order, t) from a flat array and the stop offset of each unit."""
    start = F.coalesce(F.lag(stop).over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))
    f = units.withColumn("_n", F.col(stop) - start).withColumn("_start", F.col(stop) - F.col("_n"))
    return f.where("_n > 0").select(*keys, order, F.explode(F.slice(flat, (F.col("_start") + 1).cast("int"), F.col("_n").cast("int"))).alias("t"))


def read_cluster_depths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """cluster_id and depth of a TSV; rows that aren't numbers are skipped."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.select(F.col("cluster_id").try_cast("int").alias("cluster_id"), F.col("depth").try_cast("double").alias("depth")).where("cluster_id IS NOT NULL AND depth IS NOT NULL")


def for_json(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, NaN as null."""
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), places) for c, kind in df.dtypes if kind in ("double", "float")})


def write_table(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = (), places: int = 4) -> None:
    """Write as parquet, csv or json (rounded, NaN as null), in folders of ``by``."""
    out = for_json(df, places) if form == "json" else df
    w = out.write.mode("overwrite").partitionBy(*by)
    (w.option("header", True) if form == "csv" else w).format(form).save(path)


def _dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by a hash of ``keys`` over all shuffle partitions: many small files are few bytes and much work, which adaptive execution must not join."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def _moves(path: str) -> dict[str, str]:
    """Options for writing many small files to ``path``: tasks move them to their places themselves.

    In a local folder a move is a system call, but without Hadoop's native
    library each file, checksum and folder that is made starts a shell to set
    its permissions; so whole folders are moved, and no checksums are written.
    """
    if not path.startswith("file:"):
        return {COMMITTER: "2"}
    return {COMMITTER: "1", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_timed_csv(samples: DataFrame, path: str, channels: Sequence[str], keys: Sequence[str] = ("session", "trial")) -> None:
    """Wide CSV, time first, then ``channels`` in their order; one folder per key."""
    wide = samples.groupBy(*keys, F.col("t").alias("time")).pivot("channel", list(channels)).agg(F.first("value"))
    packed = _dealt(wide, keys).sortWithinPartitions(*keys, "time")
    packed.write.mode("overwrite").options(**_moves(path)).partitionBy(*keys).option("header", True).csv(path)


def frame_lines(frames: DataFrame, keys: Sequence[str] = ("file",)) -> DataFrame:
    """Lines of a matrix CSV: ``line`` in the order of ``pos``, the header at 0."""
    rows = frames.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).alias("pos"), F.concat_ws(",", F.col("t").cast("string"), F.array_join(F.transform("sensels", lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")).alias("line"))
    size = frames.groupBy(*keys).agg(F.max("n_rows").alias("_r"), F.max("n_cols").alias("_c"))
    cell = F.transform(F.sequence(F.lit(0), F.col("_r") * F.col("_c") - 1), lambda i: F.format_string("r%dc%d", i % F.col("_r") + 1, F.floor(i / F.col("_r")) + 1))
    head = size.select(*keys, F.lit(0).alias("pos"), F.concat_ws(",", F.lit("time"), F.array_join(cell, ",")).alias("line"))
    return head.unionByName(rows)


def motion_lines(samples: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("file",), name: str = "motion") -> DataFrame:
    """Lines of a .mot file: a short header, then tab-separated columns."""
    wide = samples.groupBy(*keys, "t").pivot("channel", list(channels)).agg(F.first("value"))
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    body = wide.select(*keys, (pos + 6).cast("int").alias("pos"), F.concat_ws("\t", F.col("t").cast("string"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NaN")) for c in channels]).alias("line"))
    n = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    head = n.select(*keys, F.posexplode(F.array(F.lit(name), F.lit("version=1"), F.concat(F.lit("nRows="), F.col("_n")), F.lit(f"nColumns={len(channels) + 1}"), F.lit("inDegrees=yes"), F.lit("endheader"), F.lit("\t".join(["time", *channels])))).alias("pos", "line"))
    return head.unionByName(body)


def marker_lines(markers: DataFrame, names: Sequence[str], rate: float, keys: Sequence[str] = ("file",), units: str = "mm") -> DataFrame:
    """Lines of a .trc file: five header lines, then frame, time and x, y, z of each marker."""
    xyz = F.first(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in "xyz"]))
    wide = markers.groupBy(*keys, "frame", "t").pivot("marker", list(names)).agg(xyz)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    cells = [F.array_join(F.coalesce(F.col(f"`{m}`"), F.array(*[F.lit("")] * 3)), "\t") for m in names]
    body = wide.select(*keys, (pos + 4).cast("int").alias("pos"), F.concat_ws("\t", F.col("frame").cast("string"), F.col("t").cast("string"), *cells).alias("line"))
    n = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = "DataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames"
    values = F.concat_ws("\t", F.lit(str(rate)), F.lit(str(rate)), F.col("_n").cast("string"), F.lit(str(len(names))), F.lit(units), F.lit(str(rate)), F.lit("1"), F.col("_n").cast("string"))
    axes = "\t\t" + "\t".join(f"X{i}\tY{i}\tZ{i}" for i in range(1, len(names) + 1))
    head = n.select(*keys, F.posexplode(F.array(F.lit("PathFileType\t4\t(X/Y/Z)\tmarkers.trc"), F.lit(top), values, F.lit("Frame#\tTime\t" + "\t\t\t".join(names)), F.lit(axes))).alias("pos", "line"))
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str, keys: Sequence[str] = ("file",)) -> None:
    """Write ``line`` in the order of ``pos``: one folder for each key, one file in it.

    The shuffle is by a hash of the keys: Spark leaves out one by the keys
    themselves where head and body are dealt by them already, and adaptive
    execution may then put the two into different tasks, so different files.
    """
    packed = _dealt(lines, keys).sortWithinPartitions(*keys, "pos")
    # Files are moved by the tasks, not one by one by the driver; readers come after the job.
    packed.select(*keys, "line").write.mode("overwrite").option(COMMITTER, "2").partitionBy(*keys).text(path)


def parse_meta(text: str) -> dict:
    return SESSION_DEFAULTS | json.loads(text)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, modified and length of every file under ``folder``, whatever its depth; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length")
