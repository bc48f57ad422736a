"""Syncing of task records, and what had no test of its own: files, stacks, exports, pair angles, three-dimensional counts, calibration, titles, beamlines."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.functions import scalars
from reciprospark.operators import catalog, lattice, orient, peaks
from reciprospark.sources import files

TASKS = "id long, file string, task string, entry string, subentry string, status int, queue_time string"
FOUND = "file string, entry string, subentry string, task string, workflow boolean, queue_time string, start_time string, end_time string, pid int"
QUEUED, STARTED, ENDED = "2026-05-13T09:59:00", "2026-05-13T10:00:00", "2026-05-13T10:05:00"


def synced(spark, tasks, found):
    rows = catalog.sync_tasks(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(found, FOUND)).collect()
    return sorted((r.file, r.task, r.entry, r.subentry or "", r.status) for r in rows), rows


def test_records_of_entries_and_subentries(spark):
    found = [("w", "f1", "", "max", True, QUEUED, STARTED, ENDED, 42), ("w", "f1", "mysub", "max", True, None, None, None, None), ("w", "f1", "mysub", "find", True, None, None, None, None), ("w", "entry", None, "combine", False, QUEUED, None, ENDED, 7)]
    keys, rows = synced(spark, [], found)
    assert keys == [("w", "combine", "entry", "", 3), ("w", "find", "f1", "mysub", 3), ("w", "max", "f1", "", 3), ("w", "max", "f1", "mysub", 3)]
    by = {(r.task, r.subentry): r for r in rows}
    assert tuple(by["max", ""][c] for c in ("queue_time", "start_time", "end_time", "pid")) == (QUEUED, STARTED, ENDED, 42)
    assert tuple(by["max", "mysub"][c] for c in ("queue_time", "start_time", "end_time", "pid")) == (None,) * 4
    assert (by["combine", ""].start_time, by["combine", ""].pid) == (None, 7) and sorted(r.id for r in rows) == [1, 2, 3, 4]


def test_done_records_are_left_alone(spark):
    found = [("w", "f1", "mysub", "max", True, None, None, None, None), ("w", "f1", "", "max", True, None, None, None, None), ("w", "f1", "", "find", True, None, None, None, None)]
    there = [(5, "w", "max", "f1", "mysub", 3, None), (6, "w", "max", "f1", None, 3, None), (7, "w", "find", "f1", "", -1, None), (8, "w", "find", "f1", "", 2, None)]
    keys, rows = synced(spark, there, found)
    assert len(rows) == 5 and [r.id for r in rows if r.status == 3 and r.task == "find"] == [9]
    tasks = spark.createDataFrame(there, TASKS)
    once = catalog.sync_tasks(tasks, spark.createDataFrame(found, FOUND))
    assert catalog.sync_tasks(once.select(*tasks.columns), spark.createDataFrame(found, FOUND)).count() == 5  # syncing again adds nothing
    assert synced(spark, there, [])[0] == sorted((f, t, e, s or "", k) for _, f, t, e, s, k, _ in there)


def test_workflow_records_before_others(spark):
    rows = [("w", "f1", "", "max", False, None, None, ENDED, 1), ("w", "f1", "", "max", True, None, None, None, 2), ("w", "f1", None, "max", True, None, None, STARTED, 3), ("w", "f2", "", "link", False, None, None, None, 4), (None, "f1", "", "max", True, None, None, None, 5)]
    got = {(r.entry, r.task): r.pid for r in catalog.finished_tasks(spark.createDataFrame(rows, FOUND)).collect()}
    assert got == {("f1", "max"): 3, ("f2", "link"): 4}


def test_status_from_files(spark):
    found = spark.createDataFrame([("w", "f1", "", "max", True), ("w", "f2", "", "max", True), ("w", "f1", "", "find", True), ("w", "f2", "sub", "find", True), ("w", "entry", "", "combine", True), ("v", "f1", "", "combine", True)], "file string, entry string, subentry string, task string, workflow boolean")
    entries = spark.createDataFrame([("w", "f1"), ("w", "f2"), ("v", "f1")], "file string, entry string")
    got = {(r.file, r.task): r.status for r in catalog.sync_status(found, entries, ["max", "find"], ["combine"]).collect()}
    assert got == {("w", "max"): 3, ("w", "find"): 2, ("w", "combine"): 3, ("v", "max"): 0, ("v", "find"): 0, ("v", "combine"): 0}


def test_frames_in_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", "f1", f, 0, x, f * 10 + x - 5) for f in range(0, 450, 50) for x in range(3)], "scan string, entry string, frame long, y int, x int, counts long")
    files.write_frames(rows, str(tmp_path / "frames"))
    got = sorted((r.frame, r.x, r.counts) for r in files.read_frames(spark, str(tmp_path / "frames"), (100, 300)).collect())
    assert got == [(f, x, max(0, f * 10 + x - 5)) for f in (100, 150, 200, 250) for x in range(3)]
    assert files.read_frames(spark, str(tmp_path / "frames")).agg(F.min("counts")).first()[0] == 0
    raw = tmp_path / "raw"
    (raw / "deep").mkdir(parents=True)
    (raw / "f1.h5").write_text("x")
    (raw / "deep" / "f2.nxs").write_text("y")
    names = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "entry string")
    assert {r.entry: r["exists"] for r in files.raw_exists(spark, str(raw), names).collect()} == {"f1": True, "f2": True, "f3": False}


def test_scan_files_and_stacks(spark):
    paths = spark.createDataFrame([("/a/lab/sample_300K.nxs",), ("/a/lab/sample_scans.nxs",), ("/a/lab/x_mask.nxs",), ("/a/lab/sample_parent.nxs",), ("/a/lab/f1.h5",)], "path string")
    assert [(r.scan, r.parent) for r in catalog.scan_files(paths).collect()] == [("sample_300K", "lab")]
    scans = spark.createDataFrame([("a", True, 30.0), ("b", True, 10.0), ("c", False, 1.0)], "scan string, selected boolean, scan_value double")
    data = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "scan string, v int")
    assert [(r.scan, r.v, r.scan_value) for r in catalog.scan_stack(scans, data).collect()] == [("b", 2, 10.0), ("a", 1, 30.0)]


def test_exported_peaks(spark):
    rows = spark.createDataFrame([(1.4, 2.6, 10.0, 0.01), (5.0, 5.0, 8.0, 0.01), (1.0, 1.0, 1.0, 0.5)], "x double, y double, intensity double, diff double")
    image = spark.createDataFrame([(3, 1, 0.5)], "y int, x int, polarization double")
    assert sorted((r.x, r.intensity) for r in peaks.export_peaks(rows, image, 0.1).collect()) == [(1.4, 20.0), (5.0, 8.0)]


def test_pair_angles_by_brute_force(spark):
    cell = (3.0, 4.0, 5.5, 90.0, 100.0, 90.0)
    members = [(1, 0, 0), (0, 1, 1), (-1, 1, 0), (0, 0, 2)]
    angles = [(i, a) for i, a in enumerate((0.0, 31.0, 47.3, 63.8, 90.0, 120.5))]
    ring = spark.createDataFrame(members, "h int, k int, l int")
    found = {r.pair_id: (r.between, (r.ah, r.ak, r.al), (r.bh, r.bk, r.bl)) for r in lattice.match_pair_angles(spark.createDataFrame(angles, "pair_id int, angle double"), ring, ring, cell, 5.0).collect()}
    b = g.b_matrix(*cell)
    between = {(p, q): math.degrees(math.acos(np.clip((b @ p) @ (b @ q) / np.linalg.norm(b @ p) / np.linalg.norm(b @ q), -1, 1))) for p in members for q in members}
    for i, a in angles:
        best = min(abs(v - a) for v in between.values())
        assert (i in found) == (best < 5.0)
        if i in found:
            assert abs(found[i][0] - a) == pytest.approx(best, abs=2e-3) and between[found[i][1:]] == pytest.approx(found[i][0], abs=2e-3)


def test_three_dimensional_counts(spark):
    rng = np.random.default_rng(2)
    ub = g.rotmat("x", 12) @ g.b_matrix(4.0, 5.0, 6.0, 90.0, 95.0, 100.0)
    q = np.concatenate([rng.integers(-3, 4, (60, 3)) @ ub.T, rng.normal(size=(40, 3)) / 3, np.zeros((1, 3))])
    p = q @ np.linalg.inv(ub).T
    want = ((np.abs(p - np.rint(p)) <= 0.1).all(1) & ~(np.round(p, 4) == 0).all(1)).sum()
    assert orient.index_count_3d(spark.createDataFrame(pd.DataFrame(q, columns=["qx", "qy", "qz"])), ub, 0.1) == want


def test_geometry_from_ring_points(spark):
    true = g.Geometry(wavelength=0.5, distance=103.0, pixel_size=0.5, xc=30.2, yc=33.1, nx=64, ny=64)
    at = np.linspace(0, 2 * math.pi, 24, endpoint=False)
    rows = [(true.xc + r * math.cos(a), true.yc + r * math.sin(a), math.degrees(math.atan(r * 0.5 / 103.0))) for r in (10.0, 20.0, 28.0) for a in at]
    found = orient.refine_geometry(spark.createDataFrame(rows, "x double, y double, ring_angle double"), true.with_(distance=100.0, xc=31.5, yc=31.5))
    assert (found.distance, found.xc, found.yc) == pytest.approx((103.0, 30.2, 33.1), abs=1e-3)


def test_energies_titles_and_valid_peaks(spark):
    r = spark.createDataFrame([("s1", None, 300.0), ("s2", "NaCl", None)], "name string, formula string, t double")
    got = r.select(scalars.title(F.col("name"), F.col("formula"), F.col("t"), "K", "masked_pdf").alias("title"), g.photon_energy(F.lit(1.0)).alias("e")).collect()
    assert [x.title for x in got] == ["s1 300.0K masked pdf", "NaCl masked pdf"] and got[0].e == pytest.approx(12.39842, abs=1e-5)


def test_beamlines_and_promoted_logs(spark):
    @files.beamline("test-line")
    def reader(spark, path):
        return {"log": spark.createDataFrame([("f1", 0, "ic1", "5"), ("f1", 0, "temp", "300.5"), ("f1", 1, "ic1", "x"), ("f1", 1, "other", "1")], "entry string, frame int, name string, value string")}

    log = files.read_beamline("test-line", spark, "/nowhere")["log"]
    with pytest.raises(KeyError, match="test-line"):
        files.read_beamline("unknown", spark, "/nowhere")
    rows = {r.frame: (r.monitor, r.temperature) for r in files.promote_logs(log.filter("value <> 'x'"), {"ic1": "monitor", "temp": "temperature"}).collect()}
    assert rows == {0: (5.0, 300.5)}
