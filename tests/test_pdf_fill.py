"""Hole and Matern fills against dense systems written out by their definition; clipped holes, lattices, the branches of the PDF sequence."""

import time
from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reciprospark.operators import pdf, volume


def laplacian(shape, aspect):
    """By its definition: a cell's differences to its neighbours inside the box, over the square of the grid step."""
    at = {c: i for i, c in enumerate(product(*map(range, shape)))}
    out = np.zeros((len(at), len(at)))
    for c, i in at.items():
        for axis, step in enumerate(aspect):
            for d in (-1, 1):
                j = at.get(tuple(v + d * (k == axis) for k, v in enumerate(c)))
                if j is not None:
                    out[i, i] += 1 / step**2
                    out[i, j] -= 1 / step**2
    return out


def by_definition(values, gap, order, eps, aspect):
    """Known values stay; in the rows of the gap the power of the operator is 0."""
    a = np.linalg.matrix_power(laplacian(values.shape, aspect) + eps**2 * np.eye(values.size), order)
    keep = np.diag((~gap).ravel().astype(float))
    return np.linalg.solve(keep - (np.eye(values.size) - keep) @ a, np.where(gap, 0.0, values).ravel()).reshape(values.shape)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("shape,aspect", [((30,), (1.0,)), ((9, 8), (1.0, 2.0)), ((5, 6, 7), (1.0, 0.5, 2.0)), ((3, 4, 3, 4), (1.0, 1.0, 1.5, 2.0))])
def test_matern_by_definition(order, shape, aspect):
    rng = np.random.default_rng(order)
    values = sum(np.sin(0.9 * x + k) * (10 + x) for k, x in enumerate(np.indices(shape)))
    for gap in (rng.random(shape) < 0.2, np.add.reduce([(x - n // 2) ** 2 for x, n in zip(np.indices(shape), shape)]) <= 2):
        for eps in (0.0, 0.1):
            assert np.allclose(pdf.matern(values, gap, order, eps, aspect), by_definition(values, gap, order, eps, aspect), atol=1e-6)


def test_matern_groups(spark):
    """Groups of one table: an image with a gap, one without, one that is all gap, a place without a row."""
    rng = np.random.default_rng(9)
    image = rng.random((6, 7)) * 20
    gap = np.zeros((6, 7), bool)
    gap[2:4, 3:5] = gap[0, 0] = True
    rows = [(1, y, x, None if gap[y, x] else float(image[y, x])) for y in range(6) for x in range(7) if (y, x) != (0, 0)]
    rows += [(2, 0, 0, 1.0), (2, 0, 1, 2.0), (3, 0, 0, None), (None, 5, 5, None), (None, 5, 6, 3.0)]
    found = pdf.matern_fill(spark.createDataFrame(rows, "group int, y int, x int, value double"), 2, 0.2, (1.0, 2.0), ("y", "x")).collect()
    want = by_definition(image, gap, 2, 0.2, (1.0, 2.0))
    assert all(r.value == pytest.approx(want[r.y, r.x], abs=1e-6) for r in found if r.group == 1) and sum(r.group == 1 for r in found) == 41
    assert sorted((r.x, r.value) for r in found if r.group == 2) == [(0, 1.0), (1, 2.0)] and [r.value for r in found if r.group == 3] == [None]
    assert len(found) == 46 and {r.value for r in found if r.group is None and r.x == 6} == {3.0}


@pytest.mark.parametrize("half", [1, 2, 3, 5])
def test_harmonic_fill_by_definition(half):
    """Whole and clipped holes of several sizes, and boxes that lie partly outside the grid."""
    n = 2 * half + 3
    rng = np.random.default_rng(half)
    hole = (np.add.reduce([((x - half - 1) / half) ** 2 for x in np.indices((n, n, n))]) <= 1) if half < 3 else np.add.reduce([np.abs(x - half - 1) for x in np.indices((n, n, n))]) <= half
    values, inside = rng.random((2, n, n, n)), np.ones((2, n, n, n), bool)
    inside[1, : half + 1] = inside[1, :, : half // 2] = False
    found = pdf.harmonic_fill(values, np.stack([hole, hole]) & inside, inside)
    for v, f, cut in zip(values, found, (0, half + 1)):
        own = (slice(cut, None), slice(half // 2 if cut else 0, None))
        if v[own].size < 2000:
            assert np.allclose(f[own], by_definition(v[own], hole[own], 1, 0.0, (1.0, 1.0, 1.0)), atol=1e-8)
        held = np.pad(f[own], 1, mode="edge")
        mean = sum(held[1 + a : held.shape[0] - 1 + a, 1 + b : held.shape[1] - 1 + b, 1 + c : held.shape[2] - 1 + c] - f[own] for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
        assert np.abs(mean[hole[own]]).max() < 1e-8


def dense(spark, a):
    l, k, h = np.indices(a.shape)  # noqa: E741
    return spark.createDataFrame(pd.DataFrame({"il": l.ravel(), "ik": k.ravel(), "ih": h.ravel(), "value": a.ravel()}))


def cube(df, shape, value="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.il, r.ik, r.ih] = r[value]
    return out


def test_punch_lattice_at_the_border(spark):
    """Holes at every whole number: at the corners and faces clipped, around h = -1, which lies one voxel outside, with what reaches in. Bodies of a centred lattice only where asked."""
    grid = volume.Grid(-0.75, -1.0, -1.0, (4, 4, 4), (9, 9, 9))
    a = np.random.default_rng(2).random((9, 9, 9)) + 1
    l, k, h = np.indices(a.shape)  # noqa: E741
    for centring in ("P", "I"):
        hole = np.zeros(a.shape, bool)
        for cl, ck, ch in product((-1, 0, 1), repeat=3):
            if centring == "P" or (cl + ck + ch) % 2 == 0:
                hole |= (l - 4 - 4 * cl) ** 2 + (k - 4 - 4 * ck) ** 2 + (h - 3 - 4 * ch) ** 2 <= 1
        found = cube(pdf.punch_lattice(dense(spark, a), grid, 0.25, (1.0, 1.0, 1.0), centring), a.shape)
        assert hole[:, :, 0].any() and np.allclose(found, by_definition(a, hole, 1, 0.0, (1.0, 1.0, 1.0)))


def test_many_large_holes(spark):
    """A hundred holes of half width 10 within a minute: 1,118 shell rows each, not one for each pair of hole and shell."""
    offsets = pdf.hole_offsets(10.0, (1, 1, 1), (1.0, 1.0, 1.0))
    n = 128
    voxels = spark.range(n**3).select(F.floor(F.col("id") / n**2).cast("int").alias("il"), (F.floor(F.col("id") / n) % n).cast("int").alias("ik"), (F.col("id") % n).cast("int").alias("ih"))
    voxels = voxels.withColumn("value", 5.0 + F.col("ih") + 2 * F.col("ik") - 0.5 * F.col("il"))
    centres = spark.createDataFrame([(12 + 25 * a, 12 + 25 * b, 12 + 25 * c) for a in range(5) for b in range(5) for c in range(4)], "ih int, ik int, il int")
    began = time.time()
    fills = pdf.hole_fills(voxels, centres, offsets)
    worst = fills.agg(F.max(F.abs(F.col("fill") - (5.0 + F.col("ih") + 2 * F.col("ik") - 0.5 * F.col("il")))).alias("d"), F.count("*").alias("n")).first()
    assert worst.n == 100 * len(offsets) and worst.d < 1e-6 and time.time() - began < 60


@pytest.mark.parametrize("laue", ["mmm", "-3m"])
def test_fill_of_representatives(spark, laue):
    """A symmetric volume: filling one of each set of equivalents and symmetrizing gives what filling each would; trigonal classes fill all."""
    grid = volume.Grid(-2.0, -2.0, -2.0, (4, 4, 4), (17, 17, 17))
    l, k, h = np.indices((17, 17, 17)) - 8  # noqa: E741
    smooth = 20.0 + np.abs(h) + 0.5 * np.abs(k) + 0.1 * l**2
    peaks = 500.0 * ((h % 4 == 0) & (k % 4 == 0) & (l % 4 == 0))
    a = smooth + peaks
    found = cube(pdf.bragg_fill(dense(spark, a).withColumnRenamed("value", "signal"), grid, laue, 0.25, (1.0, 1.0, 1.0)), a.shape)
    each = pdf.fill_holes(dense(spark, a), pdf.lattice_centres(dense(spark, a), grid, 2), pdf.hole_offsets(0.25, grid.steps, (1.0, 1.0, 1.0)))
    assert np.allclose(found, cube(each, a.shape)) and found[8, 8, 8] < 30 and found[0, 0, 0] > 500


def test_sequence_with_and_without_symmetrization(spark):
    grid = volume.Grid(-2.0, -2.0, -2.0, (4, 4, 4), (17, 17, 17))
    a = np.random.default_rng(6).random((17, 17, 17)) * 10
    rows = dense(spark, a).withColumnRenamed("value", "v").withColumn("n", F.when(F.col("ih") == 3, float("nan")).when(F.col("ih") == 4, 0.0).otherwise(2.0)).withColumn("v", F.when(F.col("ik") == 5, float("inf")).otherwise(F.col("v")))
    b = np.nan_to_num(a / 2)
    b[:, :, 3:5] = 0
    b[:, 5] = 0
    total, delta = pdf.pdf_pipeline(rows, grid, "mmm", (1.0, 1.0, 1.0), 3.0, 0.25, symmetric=False)
    want = pdf.total_pdf(dense(spark, b).withColumnRenamed("value", "signal"), grid, (1.0, 1.0, 1.0), 3.0)
    key = lambda df: {(r.iz, r.iy, r.ix): r.pdf for r in df.collect()}
    found, direct = key(total), key(want)
    assert found.keys() == direct.keys() and all(abs(found[k] - direct[k]) < 1e-9 for k in found)
    assert len(key(delta)) == 16**3
    even, _ = pdf.pdf_pipeline(dense(spark, a).select("il", "ik", "ih", F.col("value").alias("v"), F.lit(1.0).alias("n")), grid, "mmm", (1.0, 1.0, 1.0), 3.0, 0.25)
    c = sum(a[::x, ::y, ::z] for x in (1, -1) for y in (1, -1) for z in (1, -1)) / 8
    direct = key(pdf.total_pdf(dense(spark, c).withColumnRenamed("value", "signal"), grid, (1.0, 1.0, 1.0), 3.0))
    assert all(abs(v - direct[k]) < 1e-9 for k, v in key(even).items())


def test_symmetrization_shuffles_a_row_a_voxel(spark):
    grid = volume.Grid(-2.0, -2.0, -2.0, (1, 1, 1), (5, 5, 5))
    v = spark.createDataFrame([(i, j, k, float(i + 2 * j + 5 * k), 1.0) for i in range(5) for j in range(5) for k in range(5)], "il int, ik int, ih int, v double, n double")
    plan = volume.symmetrize(v, grid, "m-3m")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
