"""Frame sums of frame files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "scan int, entry string, frame long, y int, x int, counts long"


def stream_frame_sums(spark: SparkSession, path: str, schema: str = FRAMES) -> DataFrame:
    """A streaming (entry, frame, counts, n): sums of all files that have appeared below ``path``; to be written in update or complete mode."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.groupBy("entry", "frame").agg(F.sum(F.greatest("counts", F.lit(0))).alias("counts"), F.count("*").alias("n"))
