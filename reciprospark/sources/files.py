"""Readers and writers of frames, logs and scan text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_frames(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """A frame table (partitioned by scan, entry, frame_band where written so), a range of frames first; negative counts are 0."""
    rows = spark.read.parquet(path)
    if frames is not None:
        rows = rows.filter((F.col("frame") >= frames[0]) & (F.col("frame") < frames[1]))
        if "frame_band" in rows.columns:
            rows = rows.filter((F.col("frame_band") >= frames[0] // 100) & (F.col("frame_band") <= (frames[1] - 1) // 100))
    return rows.withColumn("counts", F.greatest("counts", F.lit(0)))


def write_frames(frames: DataFrame, path: str) -> None:
    keys = [c for c in ("scan", "entry") if c in frames.columns]
    banded = frames.withColumn("frame_band", F.floor(F.col("frame") / 100).cast("int"))
    banded.repartition(*keys, "frame_band").write.mode("overwrite").partitionBy(*keys, "frame_band").parquet(path)


def write_bands(bands: DataFrame, path: str) -> None:
    """Frames in bands, by scan, entry and hundred frames; within a file by frame, so that a range of frames reads few row groups."""
    keys = [c for c in ("scan", "entry") if c in bands.columns]
    rows = bands.withColumn("frame_band", F.floor(F.col("frame") / 100).cast("int"))
    rows.repartition(*keys, "frame_band").sortWithinPartitions(*keys, "frame_band", "frame", "y0").write.mode("overwrite").partitionBy(*keys, "frame_band").parquet(path)


def read_bands(spark: SparkSession, path: str, frames: tuple[int, int] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """What ``write_bands`` wrote: frames of [first, last) and bands that meet the detector rows of [first, last), both by filters that reach the scan."""
    bands = spark.read.parquet(path)
    if frames is not None:
        bands = bands.filter((F.col("frame_band") >= frames[0] // 100) & (F.col("frame_band") <= (frames[1] - 1) // 100) & (F.col("frame") >= frames[0]) & (F.col("frame") < frames[1]))
    if rows is not None:
        bands = bands.filter((F.col("y0") < rows[1]) & (F.col("y0") + F.col("ny") > rows[0]))
    return bands.drop("frame_band")


def write_result(result: DataFrame, path: str, overwrite: bool = False, keys: tuple[str, ...] = ("scan", "entry", "subentry")) -> None:
    """Adds a result by its key partitions; keys that are there already stay as they are, or are replaced with ``overwrite``."""
    spark = result.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if there and not overwrite:
        result = result.join(spark.read.parquet(path).select(*[F.col(k).cast(result.schema[k].dataType).alias(k) for k in keys]).distinct(), list(keys), "left_anti")
    writer = result.write.partitionBy(*keys)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else writer.mode("append")).parquet(path)


def raw_exists(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``expected`` (entry) with ``exists``: whether a file of that name lies below ``path``. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("entry")).distinct()
    return expected.join(files.withColumn("exists", F.lit(True)), "entry", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def read_scan_logs(spark: SparkSession, head: str, meta: str) -> tuple[DataFrame, DataFrame]:
    """(key, value, number) of head files of ``key, value`` lines; (frame, name, value) of meta files, CSV with a header, a row per frame in file order."""
    lines = spark.read.text(head)
    pair = F.split("value", ",", 2)
    heads = lines.filter(F.col("value").contains(",")).select(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value")).withColumn("number", F.expr("try_cast(value AS double)"))
    whole = spark.read.text(meta, wholetext=True).select(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n").alias("lines"))
    rows = whole.select(F.split(F.col("lines")[0], ",").alias("names"), F.posexplode(F.filter("lines", lambda line, i: i > 0)).alias("frame", "line"))
    pairs = F.zip_with("names", F.split("line", ","), lambda n, v: F.struct(F.trim(n).alias("name"), F.trim(v).alias("value")))
    cells = rows.select("frame", F.explode(pairs).alias("c"))
    return heads, cells.select("frame", "c.name", "c.value")



def read_spec_scans(spark: SparkSession, path: str) -> DataFrame:
    """(path, scan, command, columns, row, values, motors, mca, preset_time, preset_monitor, start) of text scan files: ``#S`` opens a scan, ``#L`` names its columns, ``#P`` lists positions,
    ``@A`` a spectrum, ``#T`` and ``#M`` hold what each point was counted to, ``#Q`` the hkl of the start. ``scans.scan_table`` and ``scans.scan_values`` make finished tables of them.

    A file is split into numbered lines; the scan a line belongs to is a running count of headers within its file.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    by = Window.partitionBy("path").orderBy("n")
    lines = whole.withColumn("scan_no", F.sum(F.col("line").startswith("#S ").cast("int")).over(by)).filter("scan_no > 0")
    pick = lambda mark: F.max(F.when(F.col("line").startswith(mark), F.trim(F.expr(f"substring(line, {len(mark) + 1})"))))
    floats = lambda c: F.transform(F.split(F.trim(c), r"\s+"), lambda s: s.try_cast("double"))
    preset = lambda mark: F.split(pick(mark), r"\s+")[0].try_cast("double")
    motors = F.array_sort(F.collect_list(F.when(F.col("line").rlike(r"^#P\d+ "), F.col("line"))))
    heads = lines.groupBy("path", "scan_no").agg(pick("#S ").alias("command"), F.split(pick("#L "), r"\s{2,}").alias("columns"), motors.alias("motors"), preset("#T ").alias("preset_time"), preset("#M ").alias("preset_monitor"), floats(pick("#Q ")).alias("start"))
    data = lines.filter(F.col("line").rlike(r"^\s*[-+.\d]")).withColumn("row", F.row_number().over(Window.partitionBy("path", "scan_no").orderBy("n")) - 1)
    spectra = lines.filter(F.col("line").startswith("@A ")).withColumn("row", F.row_number().over(Window.partitionBy("path", "scan_no").orderBy("n")) - 1).select("path", "scan_no", "row", floats(F.expr("substring(line, 4)")).alias("mca"))
    rows = data.select("path", "scan_no", "row", floats(F.col("line")).alias("values")).join(spectra, ["path", "scan_no", "row"], "left")
    return heads.join(rows, ["path", "scan_no"], "left").select("path", F.split("command", r"\s+")[0].cast("int").alias("scan"), "command", "columns", "row", "values", "motors", "mca", "preset_time", "preset_monitor", "start")


def promote_logs(log: DataFrame, names: dict[str, str]) -> DataFrame:
    """Named log values (entry, frame, name, value) as columns: ``names`` maps a log name to its column."""
    kept = log.filter(F.col("name").isin(*names))
    return kept.groupBy("entry", "frame").agg(*[F.max(F.when(F.col("name") == n, F.col("value").cast("double"))).alias(c) for n, c in names.items()])


_BEAMLINES: dict = {}


def beamline(name: str):
    """Registers ``reader(spark, path) -> dict of DataFrames`` under a beamline's name."""

    def add(reader):
        _BEAMLINES[name] = reader
        return reader

    return add


def read_beamline(name: str, spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if name not in _BEAMLINES:
        raise KeyError(f"no beamline {name!r}; known: {', '.join(sorted(_BEAMLINES)) or 'none'}")
    return _BEAMLINES[name](spark, path)
