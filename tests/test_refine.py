"""Refinement of the cell, the detector and the goniometer from synthetic peaks."""

import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.operators import lattice, orient


@pytest.fixture(scope="module")
def spots(spark):
    u = g.rotmat("x", 20) @ g.rotmat("y", 35) @ g.rotmat("z", 50)
    geo = g.Geometry(xc=32.0, yc=32.0, pixel_size=6.0, nx=64, ny=64, cell=(4.0, 4.0, 5.0, 90.0, 90.0, 90.0), u=tuple(map(tuple, u)), yaw=0.4, pitch=-0.3)
    rows = spark.createDataFrame([(h, k, l) for h in range(-4, 5) for k in range(-4, 5) for l in range(-5, 6) if (h, k, l) != (0, 0, 0)], "h int, k int, l int")
    found = g.hkl_to_pixels(rows, geo).filter(g.on_detector(geo, F.col("x"), F.col("y"), F.col("z"))).orderBy(F.xxhash64("h", "k", "l", "z")).limit(120)
    return geo, spark.createDataFrame(found.toPandas()).coalesce(2).cache()


def test_detector_tilts_distance_and_centre_are_found(spots):
    geo, rows = spots
    start = geo.with_(distance=501.0, yaw=0.0, pitch=0.0, xc=32.05, yc=31.96)
    # the cell is held, for with the distance it only fixes a scale
    names = ("distance", "yaw", "pitch", "xc", "yc")
    better = orient.refine_orientation(rows, start.with_(cell=geo.cell), "cell held", angles=names, rounds=5)
    for n in names:
        assert getattr(better, n) == pytest.approx(getattr(geo, n), abs=2e-2), n


def test_cell_and_centre_from_polar_angles(spark, spots):
    geo, rows = spots
    geo = geo.with_(yaw=0.0, pitch=0.0)
    h = spark.createDataFrame([(h, k, l) for h in range(3) for k in range(h + 1) for l in range(3) if h + k + l], "h int, k int, l int")
    exact = h.select("h", "k", "l", g.two_theta_hkl(geo.cell, geo.wavelength, F.col("h"), F.col("k"), F.col("l")).alias("two_theta")).toPandas()
    table = lattice.ring_table(spark.createDataFrame(exact).withColumn("lattice", F.lit(0)).withColumn("multiplicity", F.lit(1)), 0.001)
    rings = table.groupBy("ring").agg(F.first("ring_angle").alias("ring_angle"), *[F.min_by(c, F.struct("h", "k", "l")).alias(c) for c in "hkl"])
    import math

    points = []
    for k, t in enumerate(exact["two_theta"]):
        r = math.tan(math.radians(t)) * geo.distance / geo.pixel_size
        points += [(geo.xc + r * math.cos(a), geo.yc + r * math.sin(a)) for a in (k, k + 2.1, k + 4.2)]
    peaks = spark.createDataFrame(points, "x double, y double").coalesce(1)
    start = geo.with_(cell=(4.002, 4.002, 4.997, 90.0, 90.0, 90.0), xc=32.01, yc=31.99)
    better = orient.refine_polar(peaks, start, "tetragonal", rings, names=("xc", "yc"), rounds=4)
    assert better.cell[0] == pytest.approx(4.0, abs=1e-3) and better.cell[2] == pytest.approx(5.0, abs=1e-3)
    assert (better.xc, better.yc) == (pytest.approx(32.0, abs=5e-3), pytest.approx(32.0, abs=5e-3))
    held = orient.refine_polar(peaks, start.with_(cell=geo.cell, distance=500.2), "tetragonal", rings, cell=False, rounds=4)
    assert held.distance == pytest.approx(500.0, abs=2e-2) and held.cell == geo.cell
