"""Lattice indexing: the threshold of spectra, periods, all triples against brute force, a noisy crystal with many short vectors."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from reciprospark.functions import geometry as g
from reciprospark.operators import orient


def qs_of(spark, q):
    return spark.createDataFrame(pd.DataFrame(q, columns=["qx", "qy", "qz"]))


def test_threshold_of_heights():
    few = np.array([10.0, 9.0, 7.0, 5.0, 4.9, 1.0])
    assert orient.height_threshold(few, 3) == 7.0  # the least of the top, at least half of the greatest
    assert orient.height_threshold(few, 4) == 5.0
    assert orient.height_threshold(few, 5) == 4.9  # the greatest below half
    assert orient.height_threshold(few, 500) == 4.9
    many = np.concatenate([np.full(600, 8.0), [10.0]])
    assert orient.height_threshold(many) == 8.0 and (many >= orient.height_threshold(many)).sum() == 601  # more than the top are kept


def test_first_period():
    power = np.array([50.0, 30, 6, 4, 9, 3, 5, 20, 40, 22, 4, 60, 2])
    assert orient.first_period(power, 10) == pytest.approx((6 * 5 + 7 * 20 + 8 * 40 + 9 * 22 + 10 * 4) / 91)
    assert orient.first_period(power, 45) == pytest.approx((9 * 22 + 10 * 4 + 11 * 60 + 12 * 2) / 88)
    assert orient.first_period(power, 100) == 0 and orient.first_period(np.arange(9.0), 3) == 0


@pytest.mark.parametrize("seed", range(3))
def test_all_triples_count(spark, seed):
    """The pruned search gives what trying every triple in order gives."""
    rng = np.random.default_rng(seed)
    axes = np.array([[4.0, 0.3, 0], [0.2, 5.0, 0.4], [0, 0.5, 6.0]])
    hkl = rng.integers(-3, 4, (150, 3))
    q = np.concatenate([hkl @ np.linalg.inv(axes).T, rng.normal(size=(40, 3)) / 2, np.zeros((2, 3))])
    vectors = np.array(sorted([*axes, *(rng.integers(-1, 2, (6, 3)) @ axes), *(rng.normal(size=(4, 3)) * 4)], key=np.linalg.norm))
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 1]
    p = q @ vectors.T
    near, zero = np.abs(p - np.rint(p)) <= 0.12, np.round(p, 4) == 0
    best, most = None, 0
    for t in combinations(range(len(vectors)), 3):
        if abs(np.linalg.det(vectors[list(t)])) > 20:
            n = (near[:, t].all(1) & ~zero[:, t].all(1)).sum()
            if best is None or n > 1.2 * most:
                best, most = t, n
    found = orient.best_triple(qs_of(spark, q), vectors, 0.12, 20.0)
    assert np.allclose(np.abs(found), np.abs(vectors[list(best)])) and np.linalg.det(found) > 0
    assert orient.best_triple(qs_of(spark, q), vectors[:2], 0.12, 20.0) is None


def test_a_long_axis_behind_many_short_vectors(spark):
    """Well over a dozen vectors of the a-b plane index every peak and are shorter than the third axis; a sixth of the peaks are noise."""
    rng = np.random.default_rng(5)
    cell = (3.1, 3.3, 13.0, 90.0, 90.0, 90.0)
    ub = g.rotmat("x", 20) @ g.rotmat("y", 35) @ g.rotmat("z", 50) @ g.b_matrix(*cell)
    hkl = np.array([(h, k, l) for h in range(-4, 5) for k in range(-4, 5) for l in range(-6, 7) if (h, k, l) != (0, 0, 0) and rng.random() < 0.4])
    q = hkl @ ub.T
    q = np.concatenate([q, rng.uniform(-1, 1, (len(q) // 6, 3))])
    found = orient.index_lattice(qs_of(spark, q), 3.0, 13.5)
    p = q @ np.linalg.inv(found).T
    assert (np.abs(p - np.rint(p)) <= 0.12).all(1).mean() > 0.82 and abs(np.linalg.det(np.linalg.inv(found))) == pytest.approx(3.1 * 3.3 * 13.0, rel=1e-3)


def test_too_few_peaks(spark):
    assert orient.index_lattice(qs_of(spark, np.eye(3)), 3.0, 5.0) is None
