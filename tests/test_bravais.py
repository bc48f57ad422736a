"""Conventional cells found again from reduced cells of known lattices."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.operators import bravais, orient

HALF = {"P": np.eye(3), "I": np.array([[-1, 1, 1], [1, -1, 1], [1, 1, -1]]) / 2, "F": np.array([[0, 1, 1], [1, 0, 1], [1, 1, 0]]) / 2, "C": np.array([[1, 1, 0], [-1, 1, 0], [0, 0, 2]]) / 2, "R": np.array([[2, 1, 1], [-1, 1, 1], [-1, -2, 1]]) / 3}
LATTICES = [
    ("cubic", "P", (4.0, 4.0, 4.0, 90, 90, 90)), ("cubic", "I", (4.0, 4.0, 4.0, 90, 90, 90)), ("cubic", "F", (5.0, 5.0, 5.0, 90, 90, 90)),
    ("tetragonal", "P", (4.0, 4.0, 7.0, 90, 90, 90)), ("tetragonal", "I", (4.0, 4.0, 6.5, 90, 90, 90)), ("hexagonal", "P", (4.0, 4.0, 6.1, 90, 90, 120)), ("rhombohedral", "R", (4.5, 4.5, 9.0, 90, 90, 120)),
    ("orthorhombic", "P", (3.0, 4.1, 5.3, 90, 90, 90)), ("orthorhombic", "C", (3.1, 7.0, 5.3, 90, 90, 90)), ("orthorhombic", "I", (3.0, 4.1, 5.3, 90, 90, 90)), ("orthorhombic", "F", (4.0, 5.1, 6.3, 90, 90, 90)),
    ("monoclinic", "P", (3.0, 4.1, 5.3, 90, 103, 90)), ("monoclinic", "C", (6.0, 4.1, 5.3, 90, 103, 90)), ("triclinic", "P", (3.0, 4.1, 5.3, 81, 77, 68)),
]


def test_known_lattices_are_found(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, (_, centring, cell) in enumerate(LATTICES):
        axes = HALF[centring] @ np.linalg.inv(g.b_matrix(*cell))
        turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))
        reduced = orient.reduced_cell(np.linalg.inv(axes @ turn.T), 3)
        rows.append((k, reduced.ravel().tolist()))
    rows += [(90, None), (91, [0.0] * 9)]
    found = bravais.lattice_forms(spark.createDataFrame(rows, "id long, ub array<double>"))
    best = {r.id: r for r in bravais.best_cells(found, 1e-4).collect()}
    assert sorted(best) == list(range(len(LATTICES)))
    for k, (system, centring, cell) in enumerate(LATTICES):
        assert (best[k].cell_type, best[k].centring) == (system, centring), k
        got = np.array([best[k][c] for c in ("a", "b", "c", "alpha", "beta", "gamma")])
        volume = lambda c: np.sqrt(np.linalg.det(g.metric(*c)))
        assert volume(got) == pytest.approx(volume(cell), rel=1e-6)
        if system in ("cubic", "tetragonal", "hexagonal", "rhombohedral"):
            assert got == pytest.approx(cell, abs=1e-4)
        elif system == "orthorhombic":
            assert sorted(got) == pytest.approx(sorted(cell), abs=1e-4)


def test_settings_keep_volume_and_hand():
    m = np.array([[1, 0, 0], [0, 1, 0], [1, 1, 2]])
    assert len(bravais.settings_of(m)) == 6 and all(round(np.linalg.det(s)) == 2 for s in bravais.settings_of(m))


def every_form(ub):
    """The best cell of each form by all ordered triples of combinations, and their number."""
    axes = np.linalg.inv(ub)
    n = np.array([x for x in np.ndindex(7, 7, 7)]) - 3
    n = n[np.gcd.reduce(n, axis=1) == 1]
    size = np.linalg.norm(n @ axes, axis=1)
    n = n[(order := np.argsort(size, kind="stable"))[size[order] <= 3.5 * np.linalg.norm(axes, axis=1).max()]]
    v, half = n @ axes, np.array([tuple(x) > (0, 0, 0) for x in n.tolist()])
    size = np.linalg.norm(v, axis=1)
    angle = np.arccos(np.clip(v @ v.T / np.outer(size, size), -1, 1))
    alike = np.abs(size[:, None] - size) <= 0.1 * np.maximum(size[:, None], size)
    near = lambda want: angle >= math.pi / 2 - 1e-6 if want is None else np.abs(angle - math.radians(want)) <= 0.1
    found = {}
    for system, (edges, angles) in bravais.SYSTEMS.items():
        if system == "triclinic":
            continue
        ab, bc = near(angles[2]) & (alike if (0, 1) in edges else True), near(angles[0]) & (alike if (1, 2) in edges else True)
        i, j = np.nonzero(ab & half[:, None])
        pair, k = np.nonzero(bc[j] & near(angles[1])[i])
        m = np.stack([n[i[pair]], n[j[pair]], n[k]], 1)
        volume = np.rint(np.linalg.det(m) * np.sign(np.linalg.det(axes))).astype(int)
        small = (np.abs(volume) >= 1) & (np.abs(volume) <= 4)
        m, volume = (m * np.sign(volume)[:, None, None])[small], volume[small]
        error, cell = bravais._fit(m @ axes, edges, angles)
        for c in bravais.CENTRINGS[system]:
            held = (np.abs(volume) == len(bravais.POINTS[c]) + 1) & (error <= 0.05)
            for p in bravais.POINTS[c]:
                held &= ((np.array(p) @ m) % 6 == 0).all(1)
            if own := np.flatnonzero(held).tolist():
                k = min(own, key=lambda q: (round(error[q], 6), round(cell[q, :3].sum(), 6)))
                found[system, c] = (error[k], *cell[k], *m[k].ravel())
    return found


def test_best_of_all_triples():
    rng = np.random.default_rng(5)
    for place, (_, centring, cell) in enumerate(LATTICES):
        axes = HALF[centring] @ np.linalg.inv(g.b_matrix(*cell))
        ub = (-1) ** place * orient.reduced_cell(np.linalg.inv(axes @ np.linalg.qr(rng.standard_normal((3, 3)))[0] + 0.01 * rng.standard_normal((3, 3))), 3)
        got, want = {f[:2]: (f[2], *f[3], *f[4].ravel()) for f in bravais.forms(ub)}, every_form(ub)
        assert got.pop(("triclinic", "P"))[7:] == tuple((-1) ** place * np.eye(3, dtype=int).ravel())
        assert sorted(got) == sorted(want)
        for form in want:
            assert got[form] == pytest.approx(want[form], abs=1e-9), form


def test_a_lattice_takes_milliseconds():
    """The search by all triples took 40 ms and more a lattice."""
    rng = np.random.default_rng(6)
    began = time.thread_time()
    for _ in range(300):
        assert bravais.forms(np.linalg.inv(np.diag(rng.uniform(3, 9, 3)) + rng.uniform(-0.5, 0.5, (3, 3))))
    assert time.thread_time() - began < 6


def test_lattices_of_one_file_are_dealt_to_all_cores(spark):
    rows = spark.range(0, 40, 1, 1).select("id", F.array(*[F.lit(0.25 if i % 4 == 0 else 0.0) for i in range(9)]).alias("ub"))
    found = bravais.lattice_forms(rows)
    assert found.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in bravais.best_cells(found).collect()) == list(range(40))


@pytest.mark.parametrize("unit", [1e-160, 1e160])
def test_any_unit_of_length(unit):
    ub = np.diag([0.25, 0.2, 0.125])
    found = {f[:2]: f[3] for f in bravais.forms(ub / unit)}
    assert list(found) == [f[:2] for f in bravais.forms(ub)]
    assert sorted(found["orthorhombic", "P"][:3] / unit) == pytest.approx([4, 5, 8]) and found["orthorhombic", "P"][3:] == pytest.approx([90] * 3)
