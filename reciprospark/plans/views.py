"""Stand-in tables: detector frames, hits, task records and logs made from the star-schema tables.

The library takes any DataFrame with these columns; only the registered queries and tests use these views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reciprospark.functions.geometry import Geometry

#: The geometry of the stand-in detector of ``hits``: 64 x 64 pixels, one frame per degree.
HITS_GEOMETRY = Geometry(wavelength=0.5, distance=100.0, pixel_size=0.5, xc=31.5, yc=31.5, phi=-180.0, phi_step=1.0, nx=64, ny=64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan, entry, frame, y, x, counts): an 8 x 8 detector from ``embeddings``; scan is the label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), F.lit("f1").alias("entry"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "v"))
    counts = F.floor(F.abs(F.col("v").cast("double")) * 1000).cast("long")
    return rows.select("scan", "entry", "frame", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), counts.alias("counts"))


def hits(spark: SparkSession, sf_dir: str, with_entry: bool = False) -> DataFrame:
    """(entry, frame, y, x, counts): 360 sparse frames of a 64 x 64 detector from ``lineitem``; three entries if asked for."""
    entry = (F.col("l_linenumber") % 3) if with_entry else F.lit(0)
    keys = [entry.cast("int").alias("entry"), (F.col("l_orderkey") % 360).alias("frame"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("counts"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file, task, entry, subentry, status) from ``orders``."""
    status = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(-1)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("task"), (F.col("o_orderkey") % 3).alias("entry"), F.lit("").alias("subentry"), status.alias("status"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, frame, monitor, n): a value per hour from ``events``."""
    frame = F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz)) as int)")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy(frame.alias("frame")).agg(cents.alias("monitor"), F.count("*").alias("n")).select(F.lit("f1").alias("entry"), "frame", "monitor", "n")


FRAMES_SQL = """frames AS (SELECT label AS scan, vec_id AS frame, cast(floor((i - 1) / 8) AS INT) AS y, cast((i - 1) % 8 AS INT) AS x,
    cast(floor(abs(cast(embedding[i] AS DOUBLE)) * 1000) AS BIGINT) AS counts FROM embeddings, range(1, 65) t(i))"""
HITS_SQL = """hits AS (SELECT 0 AS entry, l_orderkey % 360 AS frame, l_partkey % 64 AS y, l_suppkey % 64 AS x, cast(sum(l_quantity) AS BIGINT) AS counts
    FROM lineitem GROUP BY 1, 2, 3, 4)"""
HITS3_SQL = HITS_SQL.replace("0 AS entry", "cast(l_linenumber % 3 AS INT) AS entry")
TASKS_SQL = """tasks AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderpriority AS task, o_orderkey % 3 AS entry, '' AS subentry,
    CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE -1 END AS status FROM orders)"""
LOG_SQL = """log AS (SELECT cast(date_diff('hour', timestamp '2024-01-01', ts) AS INT) AS frame,
    cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS monitor, count(*) AS n FROM events GROUP BY 1)"""
