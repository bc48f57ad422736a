"""Finished scan tables, beamline metadata, the two-ring orientation search, roots and boxes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reciprospark.functions import geometry as g
from reciprospark.operators import orient, peaks
from reciprospark.sources import files, hooks, scans

TEXT = """#F x
#S 1 ascan th 0 1 2 5
#T 5  (Seconds)
#L th  Epoch  det
0 1 5
1 2 6
@A 1 2 3
#S 2 mesh a 0 1 2 b 0 1 1 1
#M 1000  (mon)
#L a  b  det
0 0 1
0.5 0 2
1 0 3
0 1 4
0.5 1 5
#S 3 hklmesh H 1 2 1 K 0 1 1 -800
#Q 1 0 2
#L H  K  L  det
1 0 2 7
2 0 2 8
1 1 2 9
2 1 2 10
#S 4 hklscan 1 1 0 0 2.5 3.5 2 -400
#L H  K  L  det
1 0 2.5 3
1 0 3.5 4
#S 5 hscan 1 1 0 0 2 2 1 1
#L H  K  L  det
1 0 2 3
#S 6 mesh motor1 0 1 9 motor2 0 1 1 1
#L m1  m2  det
0 0 1
#S 7 mesh motor1 0 1 1 motor2 0 1 1 1
#L m1  m2  det
0 0 1
1 0 2
#S 8 ascan th 0 1 2 5
#L th  det
"""


def test_finished_scans(spark, tmp_path):
    (tmp_path / "s.spec").write_text(TEXT)
    rows = files.read_spec_scans(spark, str(tmp_path / "s.spec")).cache()
    table = {r.scan: r for r in scans.scan_table(rows).collect()}
    assert {k: (r.kind, r.axes, r["shape"], r.held, r.signal) for k, r in table.items()} == {
        1: ("line", ["th"], [2], None, "det"), 2: ("mesh", ["b", "a"], [2, 3], None, "det"), 3: ("mesh", ["K", "H"], [2, 2], "L", "det"), 4: ("hkl", ["L"], [2], None, "det"),
        5: ("hkl", ["H"], [1], None, "det"), 6: ("line", ["m1"], [1], None, "det"), 7: ("mesh", ["m2", "m1"], [1, 2], None, "det"), 8: ("empty", [], [], None, None),
    }
    assert (table[1].counting, table[1].preset, table[2].counting, table[2].preset, table[3].counting, table[3].start) == ("time", 5.0, "monitor", 1000.0, None, [1.0, 0.0, 2.0])
    values = {}
    for r in scans.scan_values(rows).collect():
        values.setdefault((r.scan, r.name), {})[tuple(r.place)] = r.value
    assert values[2, "a"] == {(0,): 0, (1,): 0.5, (2,): 1} and values[2, "b"] == {(0,): 0, (1,): 1}
    assert values[2, "det"] == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): 5}  # a last row that was cut off
    assert values[3, "L"] == {(): 2} and values[3, "K"] == {(0,): 0, (1,): 1} and values[3, "det"][1, 0] == 9
    assert values[1, "Epoch"] == {(0,): 1, (1,): 2} and values[4, "L"] == {(0,): 2.5, (1,): 3.5} and (8, "th") not in values


CURRENT = [
    ("a", "f1", "instrument/logs", "x", "1"), ("a", "f1", "instrument/logs", "y", "2"), ("a", "f1", "monitor", "m", "3"), ("a", "f1", "monitor1", "old", "4"), ("a", "f1", "instrument/goniometer", "phi", "5"),
    ("a", "f1", "instrument/goniometer", "chi", "6"), ("a", "entry", "sample", "name", "s"), ("a", "entry", "sample", "temperature", "300"), ("a", "f1", "data/frame_time", "units", "s"), ("a", "f1", "instrument/filter", "material", "Pt"),
    ("a", "f2", "monitor1", "old", "7"), ("b", "f1", "monitor2", "old", "8"),
]


def metadata(spark, current, supplied):
    got = hooks.read_logs(spark.createDataFrame(current, "file string, entry string, path string, field string, value string"), spark.createDataFrame(supplied, "file string, entry string, group string, field string, value string"))
    rows = got.collect()
    found = {tuple(r[c] for c in ("file", "entry", "path", "field")): r["value"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_groups_are_replaced_or_merged(spark):
    supplied = [("a", "f1", "logs", "z", "10"), ("a", "f1", "goniometer", "phi", "11"), ("a", "f1", "goniometer", "omega", "12"), ("a", "f1", "sample", "temperature", "295"), ("a", "f1", "sample", "label", "q"),
                ("a", "f1", "filter_transmission", "transmission", "0.5"), ("a", "f1", "filter_transmission", "material", "Au"), ("a", "f1", "start_time", "start_time", "2024-01-01"), ("a", "f1", "monitor", "m", None), ("a", "f1", "other", "o", "p")]
    found = metadata(spark, CURRENT, supplied)
    want = {(f, e, p, n): v for f, e, p, n, v in CURRENT if p not in ("instrument/logs", "monitor1") or (f, e) == ("a", "f2")}
    want |= {("a", "f1", "instrument/logs", "z"): "10", ("a", "f1", "instrument/goniometer", "phi"): "11", ("a", "f1", "instrument/goniometer", "omega"): "12", ("a", "entry", "sample", "temperature"): "295", ("a", "entry", "sample", "label"): "q"}
    want |= {("a", "f1", "instrument/filter", "transmission"): "0.5", ("a", "f1", "", "start_time"): "2024-01-01", ("a", "f1", "data/frame_time", "start"): "2024-01-01", ("a", "f1", "sample", "@target"): "entry/sample"}
    assert found == want
    assert metadata(spark, CURRENT, [])  == {tuple(r[:4]): r[4] for r in CURRENT}
    again = metadata(spark, [(*k, v) for k, v in found.items()], supplied)
    assert again == found  # reading again changes nothing
    assert metadata(spark, [], [("c", "f1", "monitor", "m", "1"), ("c", "f1", "monitor", "m", "2")]) == {("c", "f1", "monitor", "m"): "2"}


def test_orientation_from_two_rings(spark):
    cell, wavelength = (4.0, 4.4, 5.1, 90.0, 90.0, 90.0), 0.5
    u = g.rotmat("x", 25) @ g.rotmat("y", -40) @ g.rotmat("z", 70)
    rng = np.random.default_rng(1)
    hkl = np.array([v for v in np.ndindex(7, 7, 7)]) - 3
    hkl = hkl[np.any(hkl != 0, axis=1)]
    hkl = hkl[rng.random(len(hkl)) < 0.4]
    q = hkl @ (u @ g.b_matrix(*cell)).T
    noise = rng.normal(size=(30, 3)) / 4
    every = np.concatenate([q, noise])
    polar = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(every, axis=1) * wavelength / 2, 0, 1)))
    intensity = np.concatenate([rng.random(len(q)) + 1, rng.random(30)])
    intensity[len(q)] = 9  # the brightest is no reflection at all
    table = spark.createDataFrame(pd.DataFrame({"qx": every[:, 0], "qy": every[:, 1], "qz": every[:, 2], "polar": polar, "intensity": intensity}))
    votes = orient.orientation_votes(table, cell, wavelength).cache()
    best = orient.best_orientation(votes)
    p = q @ np.linalg.inv(best @ g.b_matrix(*cell)).T
    assert np.abs(p - np.rint(p)).max() < 1e-6
    inverse = {tuple(r[:8]): np.linalg.inv(np.array(r.u).reshape(3, 3) @ g.b_matrix(*cell)) for r in votes.collect()}
    for r in votes.collect()[::17]:
        own = every @ inverse[tuple(r[:8])].T
        assert r.votes == ((np.abs(own - np.rint(own)) <= 0.1).all(1) & (np.rint(own) != 0).any(1)).sum()
    for few in (table.limit(1), table.filter("false")):
        assert orient.orientation_votes(few, cell, wavelength).count() == 0 and orient.best_orientation(orient.orientation_votes(few, cell, wavelength)) is None


def test_roots_and_boxes(spark):
    r = spark.range(1).select(g.unique_roots(F.array(*[F.lit(v) for v in (1.00001, 1.00002, -0.00001, float("nan"), 3.0)], F.lit(None).cast("double"))).alias("r")).first().r
    assert r == [0.0, 1.0, 3.0] and str(r[0]) == "0.0"
    rng = np.random.default_rng(3)
    image = rng.integers(0, 40, (150, 90))
    frames = spark.createDataFrame([(f, int(y), int(x), int(image[y, x]) - f) for f in (0, 1) for y in range(150) for x in range(90)], "frame int, y int, x int, counts long")
    boxes = [(0, 3, 80, 10, 70), (1, 60, 66, 60, 66), (2, 149, 400, 0, 89), (3, 200, 210, 0, 5)]
    found = {r.box: (r.y, r.x, r.counts) for r in peaks.brightest_in_boxes(frames, spark.createDataFrame(boxes, "box int, y0 int, y1 int, x0 int, x1 int")).collect()}
    for b, y0, y1, x0, x1 in boxes[:3]:
        part = image[y0 : y1 + 1, x0 : x1 + 1]
        y, x = np.unravel_index(part.argmax(), part.shape)
        assert found[b] == (y0 + y, x0 + x, part.max())
    assert 3 not in found


@pytest.mark.parametrize("name", ["orientation_votes"])
def test_queries_without_sql_run(spark, name):
    from reciprospark.plans.queries import QUERIES

    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
