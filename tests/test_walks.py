"""Peak linking, taper, sorting, task records and settings on small hand-made cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.operators import catalog, frames, pdf, peaks, volume
from reciprospark.plans import queries

HITS = "entry string, frame long, y long, x long, counts long"


def plain_walk(hits, first, last, distance=10):
    """All frames of one slab, every pair compared."""
    live, done = [], []
    for z in range(first, last):
        now = [[z, y, x, c] for c, y, x in sorted(((c, y, x) for f, y, x, c in hits if f == z), key=lambda h: (-h[0], h[1], h[2]))]
        for p in live:
            near = [b for b in now if sum((p[i] - b[i]) ** 2 for i in range(3)) < distance**2 or None]
            met = False
            for b in now:
                if (p[0] - b[0]) ** 2 + (p[1] - b[1]) ** 2 + (p[2] - b[2]) ** 2 < distance**2:
                    met = True
                    if p[3] > b[3]:
                        b[:] = p
            assert met == bool(near)
            if not met:
                done.append(tuple(p))
        live = now
    return sorted(set(done))


def linked(spark, hits, first, last):
    rows = spark.createDataFrame([("e", *h) for h in hits], HITS)
    return sorted((r.z, r.y, r.x, r.counts) for r in peaks.link_peaks(rows, first, last).collect())


def test_a_peak_stays_where_it_was_brightest(spark):
    hits = [(0, 5, 0, 100), (1, 5, 3, 50), (2, 5, 6, 40), (3, 5, 9, 30), (4, 5, 12, 20)]
    # the last hit is 4 frames and 12 pixels from the bright one, too far: a peak of its own
    assert linked(spark, hits, 0, 20) == [(0, 5, 0, 100), (4, 5, 12, 20)]


def test_peaks_of_the_last_frame_are_left_out(spark):
    hits = [(3, 5, 5, 9), (9, 5, 5, 9), (7, 30, 30, 8)]
    assert linked(spark, hits, 0, 10) == [(3, 5, 5, 9), (7, 30, 30, 8)]


def test_walks_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    for _ in range(3):
        hits = sorted({(int(f), int(y), int(x)) for f, y, x in rng.integers(0, 40, (260, 3))})
        hits = [(*h, int(rng.integers(1, 50))) for h in hits]
        assert linked(spark, hits, 0, 40) == plain_walk(hits, 0, 40)


def test_slabs_report_their_own_peaks(spark):
    hits = [(f, 5, 5, 100 - abs(f - 50)) for f in range(47, 54)] + [(99, 9, 9, 7), (100, 9, 9, 9), (101, 9, 9, 8)]
    assert linked(spark, hits, 0, 150) == [(50, 5, 5, 100), (100, 9, 9, 9)]


def test_taper_floor_is_the_least_value_on_the_slope(spark):
    grid, reciprocal = volume.Grid(-3.0, -2.0, -4.0, (2, 1, 1), (13, 5, 9)), (0.9, 1.7, 1.1)
    h, k, l = np.meshgrid(*[(np.arange(n) / s + o) * r for n, s, o, r in zip(grid.n, grid.steps, (grid.h0, grid.k0, grid.l0), reciprocal)], indexing="ij")  # noqa: E741
    for q_max in (3.0, 5.0, 100.0):
        r = 2 * np.sqrt(h**2 + k**2 + l**2) / q_max
        slope = r[(r > 1) & (r < 2)]
        want = 0.5 * (1 - np.cos(slope * math.pi)).min() if len(slope) else 1.0
        assert pdf.taper_floor(grid, reciprocal, q_max) == pytest.approx(want)


def test_names_sort_by_text_and_number(spark):
    names = ["b2", "a10", "a9", "a9b", "a", "10", "9", "a09x", "", "x2y10", "x2y9"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(catalog.natural_key(F.col("n"))).collect()]
    split = lambda s: [(t, int(d) if d else -1) for t, d in __import__("re").findall(r"(\D*)(\d*)", s)]
    assert got == sorted(names, key=split)


TASKS = "id long, file string, task string, entry string, subentry string, status int, queue_time string, start_time string, end_time string, machine string, pid int"


def test_a_task_from_queue_to_end(spark):
    empty = spark.createDataFrame([], TASKS)
    new = spark.createDataFrame([("f", "find", "f1", "", 1, "09:59"), ("f", "find", "f2", "", 1, "09:59"), ("g", "find", "f1", "", 1, None)], "file string, task string, entry string, subentry string, status int, queue_time string")
    queued = catalog.record_task(empty, new)
    assert sorted(r.id for r in queued.collect()) == [1, 2, 3]
    assert catalog.record_task(queued, new).count() == 3
    running = catalog.task_start(queued, F.col("file") == "f", F.lit("10:00"), F.lit("host"), F.lit(99999))
    done = catalog.task_end(running, F.col("entry") == "f1", F.lit("10:05"))
    got = {(r.file, r.entry): (r.status, r.queue_time, r.start_time, r.end_time, r.machine, r.pid) for r in done.collect()}
    assert got == {
        ("f", "f1"): (catalog.DONE, "09:59", "10:00", "10:05", "host", 99999),
        ("f", "f2"): (catalog.RUNNING, "09:59", "10:00", None, "host", 99999),
        ("g", "f1"): (catalog.QUEUED, None, None, None, None, None),
    }
    failed = catalog.task_end(running, F.lit(True), F.lit("10:06"), failed=F.col("entry") == "f2")
    assert {(r.file, r.entry): r.status for r in failed.collect()} == {("f", "f1"): catalog.DONE, ("f", "f2"): catalog.FAILED, ("g", "f1"): catalog.QUEUED}


def test_settings_are_written_over(spark):
    kind = "scope string, file string, subentry string, name string, value string"
    now = spark.createDataFrame([("local", "f", "", "threshold", "50000"), ("local", "f", "", "monitor", "ic1"), ("default", None, "", "threshold", "1")], kind)
    new = spark.createDataFrame([("local", "f", "", "threshold", "12345"), ("local", "f", "", "monitor", None), ("explicit", "f", "", "first", "20"), ("default", None, "", "threshold", "2")], kind)
    got = {(r.scope, r.file, r.name): r.value for r in catalog.update_settings(now, new).collect()}
    assert got == {("local", "f", "threshold"): "12345", ("local", "f", "monitor"): "ic1", ("explicit", "f", "first"): "20", ("default", None, "threshold"): "2"}


def test_partial_frames_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(frames, "SUBSAMPLE", 5)
    rng = np.random.default_rng(3)
    a = rng.integers(-2, 6, (4, 6, 7))
    rows = spark.createDataFrame([("e", z, y, x, int(a[z, y, x])) for z in range(4) for y in range(6) for x in range(7)], HITS)
    inside = [(y, x) for y in range(6) for x in range(7) if (y + 2 * x) % 4]
    got = {r.frame: r.partial for r in frames.partial_frames(rows, spark.createDataFrame(inside, "y long, x long")).collect()}
    stride = max(1, len(inside) // 5)
    for z in range(4):
        own = sorted(max(0, a[z, y, x]) for y, x in sorted(inside)[::stride])
        keep = max(1, len(own) * 9 // 10)
        assert got[z] == pytest.approx(sum(own[:keep]) * len(inside) / keep)


def test_peak_tables_and_defaults(spark):
    geometry = g.Geometry(xc=32.0, yc=32.0, pixel_size=6.0, nx=64, ny=64)
    rows = spark.createDataFrame([(float(x), float(y), float(z)) for x in (10, 30, 50) for y in (12, 33) for z in (0, 700)], "x double, y double, z double")
    every = peaks.peak_table(rows, geometry).collect()
    assert len(every) == 12 and {"polar", "azimuth", "h", "k", "l", "diff"} <= set(every[0].asDict())
    limit = sorted(r.polar for r in every)[5]
    assert peaks.peak_table(rows, geometry, polar_max=limit).count() == sum(r.polar <= limit for r in every)
    assert peaks.peak_table(rows, geometry, tolerance=0.05).count() == sum(r["diff"] <= 0.05 for r in every)
    own = spark.createDataFrame([("a", float(i)) for i in range(300)] + [("b", float(i)) for i in range(5)], "entry string, polar double")
    assert {r.entry: r.polar_max for r in peaks.polar_default(own).collect()} == {"a": pytest.approx(200.1), "b": 4.0}


def test_symmetry_images_agree_with_those_written_out():
    for laue in ("-1", "2/m", "mmm", "4/m", "4/mmm", "6/m", "m-3", "m-3m"):
        mine = sorted("".join(("hkl" if s > 0 else "HKL")[p] for p, s in zip(perm, signs)) for perm, signs, m in volume.laue_images(laue) for _ in range(m))
        inverse = sorted("".join(("hkl" if signs[perm.index(i)] > 0 else "HKL")[perm.index(i)] for i in range(3)) for perm, signs, m in volume.laue_images(laue) for _ in range(m))
        assert sorted(queries._images(laue)) in (mine, inverse)
