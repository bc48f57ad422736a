"""Frames in bands against the operators on long frames, with missing pixels, several scans and masks; round trips through files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.operators import bands, frames, masks, volume
from reciprospark.sources import files

NY, NX = 20, 13


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(4)
    rows = []
    for scan in ("a", "b"):
        for f in range(24):
            image = rng.integers(0, 6, (NY, NX)) + (90 * ((np.indices((NY, NX)) - np.array([8, 6])[:, None, None]) ** 2).sum(0) < 90 * 5) * 40 * (f == 11)
            rows += [(scan, "f1", f, y, x, int(image[y, x]) - (y == 3 and x == 4)) for y in range(NY) for x in range(NX) if rng.random() < 0.97 and not (scan == "b" and f == 7)]
    return spark.createDataFrame(rows, "scan string, entry string, frame long, y int, x int, counts long").cache()


def rows_of(df, *columns):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_bands_and_back(spark, long, tmp_path):
    own = bands.to_bands(long, NY, NX, 6)
    kept = long.withColumn("counts", F.col("counts"))
    assert rows_of(bands.to_frames(own), "scan", "frame", "y", "x", "counts") == rows_of(kept, "scan", "frame", "y", "x", "counts")
    files.write_bands(own, str(tmp_path / "b"))
    back = files.read_bands(spark, str(tmp_path / "b"), frames=(5, 12), rows=(7, 13))
    assert rows_of(bands.to_frames(back), "scan", "frame", "y", "x", "counts") == rows_of(kept.filter("frame >= 5 AND frame < 12 AND y >= 6 AND y < 18"), "scan", "frame", "y", "x", "counts")
    assert "PartitionFilters: [isnotnull(frame_band" in back._jdf.queryExecution().toString()


def test_pixels_outside_and_repeated_and_empty_tables(spark):
    rows = spark.createDataFrame([("e", 0, 0, 0, 5), ("e", 0, 0, 0, 6), ("e", 0, NY, 0, 1), ("e", 0, 2, -1, 1), ("e", 1, 19, 12, -3)], "entry string, frame long, y int, x int, counts long")
    own = bands.to_bands(rows, NY, NX, 6)
    assert rows_of(bands.to_frames(own), "frame", "y", "x", "counts") == [(0, 0, 0, 11), (1, 19, 12, -3)]
    none = bands.to_bands(rows.filter("false"), NY, NX)
    assert [f(none).count() for f in (bands.summed_data, bands.summed_frames, bands.frame_diff)] == [0, 0, 0] and bands.bragg_mask(none, NY, NX).count() == 0


def test_sums(spark, long):
    own = bands.to_bands(long, NY, NX, 6)
    by_scan = long.withColumn("entry", F.concat("scan", "entry"))
    assert rows_of(bands.to_frames(bands.summed_data(own)).withColumn("entry", F.concat("scan", "entry")), "entry", "y", "x", "counts") == rows_of(frames.summed_data(by_scan), "entry", "y", "x", "counts")
    mask = spark.createDataFrame([(y, x) for y in range(NY) for x in range(NX) if (y + x) % 3 == 0 or y == 5], "y int, x int")
    found = bands.summed_frames(own, bands.mask_bits(mask, NY, NX), (NY, NX)).withColumn("entry", F.concat("scan", "entry"))
    assert rows_of(found, "entry", "frame", "counts") == rows_of(frames.summed_frames(masks.apply_pixel_mask(by_scan, mask)), "entry", "frame", "counts")
    assert bands.mask_bits(None, NY, NX) is None


def direct_bragg(image, dead, t1, h1, t2, h2):
    """By the rule: a mask for each frame of the cube."""

    def step(f):
        return masks.box_mean(masks.fill_gaps((np.abs(masks.box_mean(image[f + 1] - image[f], h1)) >= t1).astype(float), dead), h2) > t2

    steps = [step(f) for f in range(len(image) - 1)]
    return [np.logical_or.reduce([steps[s] for s in (f - 1, f) if 0 <= s < len(steps)]) for f in range(len(image))]


def test_bragg_mask(spark, long):
    own = long.filter("scan = 'a'").drop("scan")
    dead = spark.createDataFrame([(y, 6) for y in range(NY)] + [(2, 2), (99, 99)], "y int, x int")
    image = np.zeros((24, NY, NX))
    for r in own.collect():
        image[r.frame, r.y, r.x] = max(0, r.counts)
    bits = np.zeros((NY, NX), bool)
    bits[:, 6] = bits[2, 2] = True
    want = [(f, int(y), int(x)) for f, m in enumerate(direct_bragg(image, bits, 2.0, 3, 0.5, 5)) for y, x in zip(*np.nonzero(m))]
    found = masks.bragg_mask(own, NY, NX, 2.0, 3, 0.5, 5, dead, slab=7)
    assert want and rows_of(found, "frame", "y", "x") == sorted(want)


@pytest.mark.parametrize("corrected", [False, True])
def test_histogram(spark, long, corrected):
    geo = g.Geometry(wavelength=0.5, distance=100.0, pixel_size=2.0, xc=6.2, yc=9.7, yaw=1.0, pitch=-2.0, roll=0.5, theta=3.0, omega=10.0, chi=-20.0, phi=-5.0, phi_step=15.0, xs=0.3, ys=-0.2, zs=0.1, nx=NX, ny=NY)
    grid = volume.Grid(-3.0, -3.0, -3.0, (3, 4, 5), (19, 25, 31))
    own = long.filter("scan = 'a'").drop("scan").withColumn("counts", F.greatest("counts", F.lit(0)))
    weights = spark.createDataFrame([("f1", f, 0.5 + f % 4 - (f == 3) * 9) for f in range(22)], "entry string, frame long, weight double")
    dead = spark.createDataFrame([(y, 6) for y in range(NY)], "y int, x int")
    banded = bands.to_bands(own, NY, NX, 6)
    peaks = bands.bragg_mask(banded, NY, NX, 2.0, 3, 0.5, 5)
    want = volume.hkl_histogram(own, geo, grid, weights, dead, bands.mask_rows(peaks), corrected)
    found = bands.hkl_histogram(banded, geo, grid, weights, bands.mask_bits(dead, NY, NX), peaks, corrected)
    a, b = rows_of(want, "il", "ik", "ih", "v", "n"), rows_of(found, "il", "ik", "ih", "v", "n")
    assert len(a) > 100 and [r[:4] for r in a] == [r[:4] for r in b] and np.allclose([r[4] for r in a], [r[4] for r in b])
