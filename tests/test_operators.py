"""Operators against small numpy models and the behaviours of task records and settings."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.operators import catalog, frames, lattice, masks, orient, pdf, peaks, volume
from reciprospark.sources import files
from reciprospark.streaming import sums


def cube(spark, a, entry="f1"):
    z, y, x = np.indices(a.shape)
    return spark.createDataFrame(pd.DataFrame({"entry": entry, "frame": z.ravel(), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "counts": a.ravel()}))


def test_box_mean_and_gaps():
    a = np.random.default_rng(0).integers(0, 9, (7, 9)).astype(float)
    padded = np.pad(a, 1, mode="edge")
    slow = np.array([[padded[y : y + 3, x : x + 3].mean() for x in range(9)] for y in range(7)])
    assert np.allclose(masks.box_mean(a, 3), slow)
    dead = np.zeros((7, 9), bool)
    assert np.array_equal(masks.fill_gaps(a, dead), a)
    dead[:, 3:5] = True
    assert np.array_equal(masks.fill_gaps(a, dead)[:, 3], np.maximum(a[:, 2], a[:, 5]))


def test_bragg_mask_is_the_same_for_any_slab(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (23, 12, 12))
    a[11, 5:7, 5:7] += 400
    f = cube(spark, a)
    both = [{tuple(r) for r in masks.bragg_mask(f, 12, 12, 5.0, 3, 0.5, 3, slab=s).select("frame", "y", "x").collect()} for s in (10, 100)]
    assert both[0] == both[1] and {r[0] for r in both[0]} >= {10, 11, 12} - {12}


def test_median_filter_of_a_short_series(spark):
    s = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate([5, 1, 4])], "entry string, frame long, v double")
    got = [r.v for r in frames.median_filter(s, "v", 5).orderBy("frame").collect()]
    reflect = lambda j: [5, 1, 4][j % 6 if j % 6 < 3 else 5 - j % 6]
    assert got == [sorted(reflect(i + d) for d in range(-2, 3))[2] for i in range(3)]


def test_smooth_monitor_keeps_a_parabola(spark):
    v = [float(3 + i + 0.5 * i * i) for i in range(11)]
    s = spark.createDataFrame([("e", i, x) for i, x in enumerate(v)], "entry string, frame long, monitor double")
    got = [r.monitor for r in frames.smooth_monitor(s).orderBy("frame").collect()]
    inner = v.copy()
    inner[0], inner[-1] = v[1], v[-2]
    t = np.arange(11)
    assert np.allclose(got, np.polyval(np.polyfit(t, inner, 2), t))


def test_window_rules():
    assert frames.window_bounds(None, None, 100) == (10, 90)
    assert frames.window_bounds(-1, 200, 100) == (10, 90)
    assert frames.window_bounds(0, 50, 100) == (0, 50)


def test_peaks_of_a_synthetic_cube(spark):
    z, y, x = np.indices((70, 40, 40))
    a = np.zeros(z.shape)
    spots = [(20, 12, 15), (59, 25, 28), (61, 10, 30)]
    for s in spots:
        a += 1000 * np.exp(-((z - s[0]) ** 2 + (y - s[1]) ** 2 + (x - s[2]) ** 2) / 8)
    f = cube(spark, np.rint(a).astype(int)).filter("counts > 0")
    found = peaks.find_peaks(f, 300, 5, 0, 70, 40, 40).collect()
    assert [(r.pz, r.py, r.px) for r in found] == spots
    assert all(1.0 < r.sigx < 2.5 for r in found)


def test_histogram_matches_numpy(spark):
    geo = g.Geometry(xc=4.0, yc=4.0, pixel_size=20.0, nx=9, ny=9, phi=0.0, phi_step=10.0)
    grid = volume.Grid(-2.0, -2.0, -2.0, (4, 4, 4), (17, 17, 17))
    a = np.random.default_rng(2).integers(0, 50, (6, 9, 9))
    got = {(r.il, r.ik, r.ih): (r.v, r.n) for r in volume.hkl_histogram(cube(spark, a), geo, grid).collect()}
    want: dict = {}
    inv = np.linalg.inv(geo.ub)
    from tests.test_geometry import model_gvec

    for z, y, x in itertools.product(range(6), range(9), range(9)):
        h = inv @ model_gvec(geo, x, y, z)
        i = np.floor((h + 2) * 4 + 0.5).astype(int)
        if (i >= 0).all() and (i < 17).all():
            v, n = want.get(tuple(i[::-1]), (0, 0))
            want[tuple(i[::-1])] = (v + a[z, y, x], n + 1)
    assert got == {k: (float(v), float(n)) for k, (v, n) in want.items()}


@pytest.mark.parametrize("laue,count,total", [("-1", 2, 2), ("2/m", 4, 4), ("mmm", 8, 8), ("4/m", 8, 8), ("4/mmm", 16, 16), ("6/m", 4, 4), ("m-3", 3, 4), ("m-3m", 48, 64)])
def test_laue_images(laue, count, total):
    images = volume.laue_images(laue)
    assert len({i[:2] for i in images}) == count and sum(i[2] for i in images) == total


def test_symmetrized_volume_keeps_its_group(spark):
    grid = volume.Grid(-2.0, -2.0, -2.0, (1, 1, 1), (5, 5, 5))
    v = spark.createDataFrame([(i, j, k, float(i + 2 * j + 5 * k), 1.0) for i in range(5) for j in range(5) for k in range(5)], "il int, ik int, ih int, v double, n double")
    once = volume.symmetrize(v, grid, "m-3m", group=True)
    values = {(r.ih - 2, r.ik - 2, r.il - 2): r.signal for r in once.collect()}
    assert all(values[a, b, c] == pytest.approx(values[tuple(sorted(map(abs, (a, b, c))))]) for a, b, c in values)


def test_fft_matches_numpy(spark):
    a = np.random.default_rng(3).random((6, 5, 7))
    l, k, h = np.indices(a.shape)  # noqa: E741
    rows = spark.createDataFrame(pd.DataFrame({"il": l.ravel(), "ik": k.ravel(), "ih": h.ravel(), "value": a.ravel()}))
    got = np.zeros((6, 4, 6))
    for r in pdf.fft3(rows, a.shape).collect():
        got[r.iz, r.iy, r.ix] = r.pdf
    b = a[:6, :4, :6]
    assert np.allclose(got, np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(b))).real / b.size)


def test_fill_is_harmonic(spark):
    hole = pdf.hole_offsets(2.0, (1, 1, 1), (1.0, 1.0, 1.0))
    shell, kernel = pdf.laplace_kernel(hole)
    assert np.allclose(kernel.sum(1), 1)
    linear = lambda v: 3.0 + v[0] - 2 * v[1] + 0.5 * v[2]
    assert np.allclose(kernel @ [linear(v) for v in shell], [linear(v) for v in hole])


def test_matern_fill_of_a_line(spark):
    rows = spark.createDataFrame([(1, i, 0, 0, None if i in (3, 4) else float(2 * i + 1)) for i in range(8)], "group int, i int, j int, k int, value double")
    got = [r.value for r in pdf.matern_fill(rows, order=1).orderBy("i").collect()]
    assert np.allclose(got, [2 * i + 1 for i in range(8)])


def test_reflections(spark):
    cell = (4.0, 4.0, 4.0, 90.0, 90.0, 90.0)
    found = [(r.h, r.k, r.l) for r in lattice.miller_indices(spark, cell, 1.9, "I").collect()]
    assert found and all((h + k + l) % 2 == 0 and 16 / (h * h + k * k + l * l) >= 1.9**2 for h, k, l in found)
    d = [r.d for r in lattice.miller_indices(spark, cell, 1.9).collect()]
    assert d == sorted(d, reverse=True)
    screw = {**lattice.identity()[0], "r11": -1, "r22": -1, "t3": 0.5}
    r = spark.range(1).select(lattice.absent_by_symmetry(F.lit(0), F.lit(0), F.lit(1), [screw]).alias("a"), lattice.absent_by_symmetry(F.lit(0), F.lit(0), F.lit(2), [screw]).alias("b")).first()
    assert (r.a, r.b) == (True, False)


def test_index_and_refine(spark):
    u = g.rotmat("x", 20) @ g.rotmat("y", 35) @ g.rotmat("z", 50)
    geo = g.Geometry(xc=32.0, yc=32.0, pixel_size=6.0, nx=64, ny=64, cell=(4.0, 4.0, 4.0, 90.0, 90.0, 90.0), u=tuple(map(tuple, u)))
    rows = spark.createDataFrame([(h, k, l) for h in range(-4, 5) for k in range(-4, 5) for l in range(-4, 5) if (h, k, l) != (0, 0, 0)], "h int, k int, l int")
    spots = g.hkl_to_pixels(rows, geo).filter(g.on_detector(geo, F.col("x"), F.col("y"), F.col("z"))).orderBy(F.xxhash64("h", "k", "l", "z")).limit(200).cache()
    q = spots.select(*[c.alias(n) for c, n in zip(g.gvec(geo, F.col("x"), F.col("y"), F.col("z")), ("qx", "qy", "qz"))]).cache()
    ub = orient.index_lattice(q, 3.0, 5.0)
    edges = np.linalg.norm(np.linalg.inv(orient.reduced_cell(ub, 2)), axis=1)
    assert np.allclose(edges, 4.0, atol=0.05)
    start = geo.with_(cell=(4.03, 4.03, 4.03, 90.0, 90.0, 90.0), chi=0.3)
    better = orient.refine_orientation(spots, start, "cubic", angles=(), rounds=4)
    assert better.cell[0] == pytest.approx(4.0, abs=1e-4)


TASKS = "id long, file string, task string, entry string, subentry string, status int"


def test_task_status(spark):
    rows = [(1, "a", "find", "f1", "", 3), (2, "a", "find", "f2", "", 3), (3, "b", "find", "f1", "", -1), (4, "b", "find", "f2", "", 3), (5, "c", "find", "f1", "", 1), (6, "c", "find", "f2", "", 3), (7, "d", "find", "f1", "", 1), (8, "d", "find", "f1", "", 3)]
    t = spark.createDataFrame(rows, TASKS)
    assert {r.file: r.status for r in catalog.task_status(t).collect()} == {"a": 3, "b": -1, "c": 2, "d": 3}
    expected = spark.createDataFrame([("a", "find", "f1"), ("a", "find", "f2"), ("a", "find", "f3"), ("e", "find", "f1")], "file string, task string, entry string")
    assert {r.file: r.status for r in catalog.task_status(t, expected).collect()} == {"a": 2, "e": 0}


def test_records_are_not_repeated(spark):
    t = spark.createDataFrame([(5, "a", "find", "f1", "", "10:00")], "id long, file string, task string, entry string, subentry string, queue_time string")
    new = t.drop("id").unionByName(t.drop("id").withColumn("task", F.lit("refine")))
    after = catalog.record_task(t, new).orderBy("id").collect()
    assert [(r.id, r.task) for r in after] == [(5, "find"), (6, "refine")]
    assert catalog.record_task(catalog.record_task(t, new), new).count() == 2


def test_settings_precedence(spark):
    rows = [("explicit", "a", "", "first", "20"), ("parent", "a", "", "threshold", "12345"), ("local", "a", "", "threshold", "99999"), ("local", "a", "", "last", "7"), ("default", None, "", "threshold", "50000"), ("default", None, "", "last", "3"), ("local", "b", "", "threshold", "33333"), ("parent", "b2", "", "first", None)]
    settings = spark.createDataFrame(rows, "scope string, file string, subentry string, name string, value string")
    wanted = spark.createDataFrame([(f, "", n) for f in ("a", "b", "c") for n in ("first", "threshold", "last")], "file string, subentry string, name string")
    got = {(r.file, r.name): r.value for r in catalog.resolve_settings(wanted, settings).collect()}
    assert got == {("a", "first"): "20", ("a", "threshold"): "12345", ("a", "last"): "3", ("b", "first"): None, ("b", "threshold"): "33333", ("b", "last"): "3", ("c", "first"): None, ("c", "threshold"): "50000", ("c", "last"): "3"}


def test_pending_needs_all_entries(spark):
    t = spark.createDataFrame([(1, "a", "find", "f1", "", 3), (2, "a", "find", "f2", "", 0)], TASKS)
    wanted = spark.createDataFrame([("a", t_, e) for t_ in ("find", "refine") for e in ("f1", "f2")], "file string, task string, entry string")
    assert [(r.task, r.entry) for r in catalog.pending_tasks(wanted, t).collect()] == [("find", "f2")]


def test_sources(spark, tmp_path):
    (tmp_path / "x.head").write_text("energy, 87.1\nsample, NaCl\n")
    (tmp_path / "x.meta").write_text("time,monitor\n0.1,5\n0.2,6\n")
    head, meta = files.read_scan_logs(spark, str(tmp_path / "x.head"), str(tmp_path / "x.meta"))
    assert {(r.key, r.value, r.number) for r in head.collect()} == {("energy", "87.1", 87.1), ("sample", "NaCl", None)}
    assert {(r.frame, r.name, r.value) for r in meta.collect()} == {(0, "time", "0.1"), (0, "monitor", "5"), (1, "time", "0.2"), (1, "monitor", "6")}
    (tmp_path / "s.spec").write_text("#F x\n#S 1 ascan th 0 1 2\n#P0 1 2\n#L th  det\n0 5\n1 6\n@A 1 2 3\n#S 2 mesh a 0 1 1 b 0 1 1\n#L a  b\n0 0\n1 0\n")
    rows = files.read_spec_scans(spark, str(tmp_path / "s.spec")).orderBy("scan", "row").collect()
    assert [(r.scan, r.row, r["values"]) for r in rows] == [(1, 0, [0.0, 5.0]), (1, 1, [1.0, 6.0]), (2, 0, [0.0, 0.0]), (2, 1, [1.0, 0.0])]
    assert rows[0].columns == ["th", "det"] and rows[0].mca == [1.0, 2.0, 3.0]


def test_results_are_written_once(spark, tmp_path):
    path = str(tmp_path / "r")
    row = lambda v: spark.createDataFrame([("s", "f1", "x", v)], "scan string, entry string, subentry string, v int")
    files.write_result(row(1), path)
    files.write_result(row(2), path)
    assert [r.v for r in spark.read.parquet(path).collect()] == [1]
    files.write_result(row(3), path, overwrite=True)
    assert [r.v for r in spark.read.parquet(path).collect()] == [3]


def test_stream_of_frames(spark, tmp_path):
    f = cube(spark, np.arange(8).reshape(2, 2, 2)).select(F.lit(0).alias("scan"), "entry", "frame", "y", "x", "counts")
    f.write.parquet(str(tmp_path / "in"))
    q = sums.stream_frame_sums(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("frame_sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.frame, r.counts) for r in spark.sql("select * from frame_sums").collect()} == {(0, 6), (1, 22)}
