"""Reduced cells of lattices with a long axis and of rows without a cell."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reciprospark.operators import orient

SKEW = np.array([[1, 0, 0], [1, 1, 0], [0, 2, 1]])


def test_long_axes_and_singular_rows(spark):
    cells = {1: (3.0, 3.1, 22.0), 2: (3.0, 3.1, 60.0), 3: (4.0, 4.5, 5.0)}
    rows = [(i, np.linalg.inv(SKEW @ np.diag(c)).ravel().tolist()) for i, c in cells.items()] + [(4, [0.0] * 9), (5, None), (6, [1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
    found = {r.id: r for r in orient.niggli_cells(spark.createDataFrame(rows, "id long, ub array<double>")).collect()}
    for i, cell in cells.items():
        assert sorted((found[i].a, found[i].b, found[i].c)) == pytest.approx(cell)
        assert (found[i].alpha, found[i].beta, found[i].gamma) == pytest.approx((90, 90, 90))
    assert [(found[i].a, found[i].gamma) for i in (4, 5, 6)] == [(None, None)] * 3


def test_shortest_of_all_combinations():
    rng = np.random.default_rng(12)
    reach = 2
    n = np.array([c for c in np.ndindex(5, 5, 5) if c > (2, 2, 2)]) - 2
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.arange(len(n))] * 3, indexing="ij"))
    i, j, k = (x[(i < j) & (j < k)] for x in (i, j, k))
    unit = np.abs(np.einsum("ij,ij->i", np.cross(n[i], n[j]), n[k])) == 1
    i, j, k = i[unit], j[unit], k[unit]
    for _ in range(20):
        axes = np.diag(rng.uniform(3, 40, 3)) + rng.uniform(-2, 2, (3, 3))
        size = np.linalg.norm(n @ axes, axis=1)
        cell = np.linalg.inv(orient.reduced_cell(np.linalg.inv(axes), reach))
        assert np.linalg.det(cell) == pytest.approx(abs(np.linalg.det(axes)))
        assert np.linalg.norm(cell, axis=1).sum() <= 1.001 * (size[i] + size[j] + size[k]).min()


def test_a_long_axis_takes_milliseconds():
    """All pairs of short combinations were tried with every third one before, some 40 ms a lattice."""
    rng = np.random.default_rng(3)
    began = time.thread_time()
    for _ in range(200):
        cell = np.array([3.0, 3.1, 60.0]) * rng.uniform(0.98, 1.02, 3)
        found = np.linalg.inv(orient.reduced_cell(np.linalg.inv(SKEW @ np.diag(cell))))
        assert sorted(np.linalg.norm(found, axis=1)) == pytest.approx(sorted(cell))
    assert time.thread_time() - began < 2.5


def test_a_cell_is_the_same_among_others():
    rng = np.random.default_rng(4)
    axes = np.concatenate([rng.standard_normal((30, 3, 3)), SKEW @ np.diag((3.0, 3.1, 60.0))[None], np.full((1, 3, 3), np.nan), np.eye(3)[None]])
    found = orient.reduced_axes(axes)
    assert np.isnan(found[-2]).all() and np.isfinite(np.delete(found, -2, 0)).all()
    for k in range(len(axes)):
        assert np.array_equal(found[k], orient.reduced_axes(axes[k][None])[0], equal_nan=True)


def test_lattices_of_one_file_are_dealt_to_all_cores(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.when(F.col("id") != 7, F.array(*[F.lit(0.25 if i % 4 == 0 else 0.0) for i in range(9)])).alias("ub"))
    found = orient.niggli_cells(rows)
    assert found.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    assert {r.id: r.a and round(r.a, 9) for r in found.collect()} == {i: None if i == 7 else 4.0 for i in range(40)}


def test_any_unit_of_length(spark):
    rows = [(i, (np.linalg.inv(SKEW @ np.diag((3.0, 4.0, 5.0))) / unit).ravel().tolist()) for i, unit in enumerate((1e-160, 1.0, 1e160))]
    for r in orient.niggli_cells(spark.createDataFrame(rows, "id long, ub array<double>")).collect():
        assert sorted(x / (1e-160, 1.0, 1e160)[r.id] for x in (r.a, r.b, r.c)) == pytest.approx([3, 4, 5])
        assert (r.alpha, r.beta, r.gamma) == pytest.approx((90, 90, 90))
