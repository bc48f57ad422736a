"""Geometry against an independent numpy model, and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.functions import scalars

CELLS = [(4.0, 4.0, 4.0, 90.0, 90.0, 90.0), (4.0, 4.0, 6.0, 90.0, 90.0, 120.0), (4.0, 5.0, 6.0, 90.0, 103.0, 90.0), (4.1, 5.2, 6.3, 81.0, 95.0, 104.0)]


@pytest.mark.parametrize("cell", CELLS)
def test_b_matrix_gives_inverse_spacing(cell):
    inverse = np.linalg.inv(g.metric(*cell))
    for h in [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, -2, 3)]:
        assert np.linalg.norm(g.b_matrix(*cell) @ h) == pytest.approx(math.sqrt(np.array(h) @ inverse @ h), rel=1e-12)


def model_gvec(geo, x, y, z):
    o, d = g.orientation_matrix(geo.orientation), geo.detector
    phi = geo.phi + geo.phi_step * z
    gm = g.rotmat("y", geo.theta) @ g.rotmat("z", geo.omega) @ g.rotmat("x", geo.chi) @ g.rotmat("z", phi)
    v2 = np.linalg.inv(o) @ (geo.pixel_size * np.array([x - geo.xc, y - geo.yc, 0.0]))
    v3 = d @ v2 - (gm @ np.array([geo.xs, geo.ys, geo.zs]) - np.array([geo.distance, 0, 0]))
    return np.linalg.inv(gm) @ (v3 / np.linalg.norm(v3) / geo.wavelength - np.array([1 / geo.wavelength, 0, 0]))


@pytest.fixture
def geometry():
    u = g.rotmat("x", 20) @ g.rotmat("y", 35) @ g.rotmat("z", 50)
    return g.Geometry(xc=30.0, yc=33.0, pixel_size=2.0, nx=64, ny=64, yaw=1.0, pitch=-2.0, roll=0.5, theta=1.0, omega=-3.0, chi=2.0, cell=CELLS[3], u=tuple(map(tuple, u)))


def test_gvec_matches_numpy(spark, geometry):
    moved = geometry.with_(xs=0.3, ys=-0.2, zs=0.1)
    rows = spark.createDataFrame([(3.0, 4.0, 100.0), (50.0, 10.0, 2000.0)], "x double, y double, z double")
    for r in rows.select("*", *[c.alias(n) for c, n in zip(g.gvec(moved, F.col("x"), F.col("y"), F.col("z")), "abc")]).collect():
        assert np.allclose([r.a, r.b, r.c], model_gvec(moved, r.x, r.y, r.z), atol=1e-12)


def test_round_trip_of_reflections(spark, geometry):
    rows = spark.createDataFrame([(h, k, l) for h in range(-2, 3) for k in range(-2, 3) for l in range(-2, 3) if (h, k, l) != (0, 0, 0)], "h int, k int, l int")
    spots = g.hkl_to_pixels(rows, geometry)
    back = g.pixel_to_hkl(geometry, F.col("x"), F.col("y"), F.col("z"))
    found = spots.select("h", "k", "l", *[c.alias(n) for c, n in zip(back, "abc")]).collect()
    assert len(found) > 100
    assert all(np.allclose([r.a, r.b, r.c], [r.h, r.k, r.l], atol=1e-8) for r in found)


def test_no_orientation_gives_zeros(spark, geometry):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(g.pixel_to_hkl(geometry.with_(u=None), F.lit(1.0), F.lit(2.0), F.lit(3.0)), "abc")]).first()
    assert tuple(row) == (0.0, 0.0, 0.0)


def test_orientation_strings():
    assert np.array_equal(g.orientation_matrix("-y +z -x"), [[0, -1, 0], [0, 0, 1], [-1, 0, 0]])
    assert np.array_equal(g.orientation_matrix(np.eye(3)), np.eye(3))
    for bad in ("x y", "x x z", "++x y z"):
        with pytest.raises(ValueError):
            g.orientation_matrix(bad)


def test_two_peaks_give_u(geometry):
    b, u = geometry.b, np.asarray(geometry.u)
    found = g.ub_from_two_peaks(b, (1, 0, 1), (0, 1, 2), u @ b @ [1, 0, 1], u @ b @ [0, 1, 2])
    assert np.allclose(found, u) and np.allclose(g.unitarity(found), np.eye(3))


def test_far_corner_and_auto_q():
    geo = g.Geometry(nx=10, ny=20, xc=2.0, yc=15.0, pixel_size=1.0, distance=100.0)
    assert g.two_theta_max(geo) == pytest.approx(math.degrees(math.atan(math.hypot(7, 15) / 100)))
    assert g.auto_q(geo.with_(xc=None)) is None
    assert g.auto_q(geo)[1] / g.auto_q(geo)[0] == pytest.approx(0.95 / 0.3)


def test_scalars(spark):
    kinds = spark.createDataFrame([(v,) for v in (None, "None", "True", "3", "-4.5e2", "abc")], "v string").select(scalars.coerce_setting(F.col("v")).alias("s")).collect()
    assert [r.s.kind for r in kinds] == ["none", "none", "bool", "int", "float", "str"]
    labels = spark.createDataFrame([(100.0,), (-3.5,)], "v double").select(scalars.scan_label("s_", F.col("v")).alias("s")).collect()
    assert [r.s for r in labels] == ["s_100K", "s_m3p5K"]
    assert scalars.guess_symmetry(CELLS[1]) == "hexagonal" and scalars.guess_symmetry(CELLS[2]) == "monoclinic"
    assert scalars.constrain_cell("cubic", CELLS[3]) == (4.1, 4.1, 4.1, 90.0, 90.0, 90.0)
    (stop, step, n), *_ = scalars.default_grid(10.0, (1.5, 1.5, 1.5))
    assert stop == 6.0 and step == 0.01 and n == 1201
    assert spark.range(1).select(scalars.fix_epoch(F.lit("1994-05-01 10:00:00").cast("timestamp"))).first()[0] == "2014-05-01T10:00:00"
