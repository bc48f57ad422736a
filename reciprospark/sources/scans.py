"""Text scans as finished tables: what kind of scan a command is, its axes, its signal, and every value with its place on the axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESHES, HKL_LINES = ("mesh", "hklmesh"), ("hscan", "kscan", "lscan", "hklscan")


def scan_table(rows: DataFrame) -> DataFrame:
    """One row per scan of ``files.read_spec_scans``: path, scan, kind (mesh, hkl, line, empty), axes (slow one first), shape, held (an hkl mesh's third index), signal, counting, preset, start.

    A mesh names two axes and their intervals; where a name isn't a column, the first or second column stands for it. A mesh that stopped before its
    first row was full is a line. An hkl scan runs along the first of H, K, L whose start and end differ, or H; other scans along their first
    column. The last column is the signal. counting: time or monitor, whichever the scan's preset is of.
    """
    sizes = rows.groupBy("path", "scan").agg(
        F.first("command").alias("command"), F.first("columns").alias("columns"), F.count("values").cast("int").alias("n"), F.first("preset_time").alias("t"), F.first("preset_monitor").alias("m"), F.first("start").alias("start"),
    )
    word = lambda i: F.get(F.split("command", r"\s+"), F.lit(i))
    named = lambda i, k: F.when(F.array_contains("columns", word(i)), word(i)).otherwise(F.get("columns", F.lit(k)))
    fast = word(5).try_cast("int") + 1
    full = word(1).isin(*MESHES) & (F.col("n") >= fast - 1) & word(9).try_cast("int").isNotNull()
    kind = F.when(F.col("n") == 0, "empty").when(full, "mesh").when(word(1).isin(*HKL_LINES), "hkl").otherwise("line")
    along = F.when(word(2) != word(3), "H").when(word(4) != word(5), "K").when(word(6) != word(7), "L").otherwise("H")
    out = sizes.withColumn("kind", kind).withColumn("fast_axis", named(2, 0)).withColumn("slow_axis", named(6, 1))
    held = F.when((F.col("kind") == "mesh") & (word(1) == "hklmesh"), F.get(F.filter(F.array(*map(F.lit, "HKL")), lambda a: (a != F.col("fast_axis")) & (a != F.col("slow_axis"))), F.lit(0)))
    axes = F.when(F.col("kind") == "mesh", F.array("slow_axis", "fast_axis")).when(F.col("kind") == "hkl", F.array(along)).when(F.col("kind") == "line", F.array(F.col("columns")[0])).otherwise(F.array().cast("array<string>"))
    shape = F.when(F.col("kind") == "mesh", F.array(F.ceil(F.col("n") / fast).cast("int"), F.least(fast, F.col("n")))).when(F.col("kind") == "empty", F.array().cast("array<int>")).otherwise(F.array("n"))
    return out.select(
        "path", "scan", "kind", axes.alias("axes"), shape.alias("shape"), held.alias("held"), F.when(F.col("kind") != "empty", F.element_at("columns", -1)).alias("signal"),
        F.when(F.col("t").isNotNull(), "time").when(F.col("m").isNotNull(), "monitor").alias("counting"), F.coalesce("t", "m").alias("preset"), "start",
    )


def scan_values(rows: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """(path, scan, name, place array<int>, value) of every column of every scan: place has a number for each axis, slow first. Axes of a mesh stand once for each of their places, a held index once."""
    scans = scan_table(rows) if scans is None else scans
    pairs = F.explode(F.arrays_zip(F.col("columns").alias("name"), F.col("values").alias("value"))).alias("c")
    each = rows.filter("values IS NOT NULL").select("path", "scan", "row", pairs).select("path", "scan", "row", "c.name", "c.value").join(scans.select("path", "scan", "kind", "axes", "shape", "held"), ["path", "scan"])
    fast = F.try_element_at("shape", F.lit(2))
    at = F.array(F.floor(F.col("row") / fast).cast("int"), (F.col("row") % fast).cast("int"))
    mesh = F.col("kind") == "mesh"
    slow_axis, fast_axis = mesh & (F.col("name") == F.col("axes")[0]), mesh & (F.col("name") == F.try_element_at("axes", F.lit(2)))
    keep = ~mesh | F.when(slow_axis, at[1] == 0).when(fast_axis, at[0] == 0).when(F.col("name") == F.col("held"), F.col("row") == 0).otherwise(True)
    place = F.when(slow_axis, F.array(at[0])).when(fast_axis, F.array(at[1])).when(mesh & (F.col("name") == F.col("held")), F.array().cast("array<int>")).when(mesh, at).otherwise(F.array(F.col("row").cast("int")))
    return each.filter(keep).select("path", "scan", "name", place.alias("place"), "value")
