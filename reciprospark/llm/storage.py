"""Tables that cut lineage, in the folder every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset a master on this machine (tests) gets a folder; a cluster must name one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="reciprospark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later stages depend on the files only."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` made, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of 10,000: a task and its Python worker then hold a few megabytes of texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


class Scratch:
    """Tables that a single computation stores, all deleted together when its result doesn't need them any more."""

    def __init__(self):
        self.kept: list[DataFrame] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(stored(df, name))
        return self.kept[-1]

    def clear(self) -> None:
        for df in self.kept:
            dropped(df)
        self.kept = []
