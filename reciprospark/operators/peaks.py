"""Peak search on sparse frames: local maxima, linking over frames, moments."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reciprospark.functions import geometry as geo
from reciprospark.functions.geometry import Geometry

SLAB, HALO, LINK = 50, 5, 10


def _near(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """Each row once for its own and the eight neighbour tiles of ``size`` pixels: an equi-join on tiles then finds all rows within ``size``."""
    tiles = F.explode(F.array(*[F.struct((F.floor(F.col("y") / size) + a).alias("ty"), (F.floor(F.col("x") / size) + b).alias("tx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return rows.withColumn("tile", tiles).select(*keep, "tile.ty", "tile.tx")


def local_maxima(frames: DataFrame, threshold: int, min_pixels: int, ny: int, nx: int) -> DataFrame:
    """Pixels above ``threshold`` with no larger one within ``min_pixels`` on either axis; of equals the smallest (y, x) stays; the border of that width is left out."""
    m = min_pixels
    above = frames.filter(F.col("counts") > threshold)
    inner = above.filter((F.col("y") >= m) & (F.col("y") < ny - m) & (F.col("x") >= m) & (F.col("x") < nx - m))
    other = _near(above.select("entry", "frame", "y", "x", "counts"), max(1, m), "entry", "frame", F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("counts").alias("oc"))
    mine = inner.withColumn("ty", F.floor(F.col("y") / max(1, m))).withColumn("tx", F.floor(F.col("x") / max(1, m)))
    beaten = (
        (F.abs(F.col("oy") - F.col("y")) <= m) & (F.abs(F.col("ox") - F.col("x")) <= m)
        & ((F.col("oc") > F.col("counts")) | ((F.col("oc") == F.col("counts")) & ((F.col("oy") < F.col("y")) | ((F.col("oy") == F.col("y")) & (F.col("ox") < F.col("x"))))))
    )
    on = [mine["entry"] == other["entry"], mine["frame"] == other["frame"], mine["ty"] == other["ty"], mine["tx"] == other["tx"]]
    cond = on[0] & on[1] & on[2] & on[3] & beaten
    return mine.join(other, cond, "left_anti").drop("ty", "tx")


def followed(frames: list[int], places: list[list[tuple[int, int, int]]], distance: int) -> list[tuple[int, int, int, int]]:
    """(z, y, x, counts) of the peaks that end before the last frame. ``places``: (counts, y, x) of each frame's hits, the brightest first.

    A hit that is nearer than ``distance`` in three dimensions to a peak of the frame before goes on with it: it takes the peak's place and frame if the peak is brighter.
    """
    done: list[tuple[int, int, int, int]] = []
    last: list[list[int]] = []
    for k, z in enumerate(frames):
        if k and z != frames[k - 1] + 1:  # a frame without hits ends all
            done += [tuple(p) for p in last]
            last = []
        now = [[z, y, x, c] for c, y, x in places[k]]
        # hits by column; one may have moved by ``distance`` since, so twice that is looked at
        order = sorted(range(len(now)), key=lambda i: now[i][2])
        columns = [now[i][2] for i in order]
        for p in last:
            near = sorted(order[bisect_left(columns, p[2] - 2 * distance) : bisect_right(columns, p[2] + 2 * distance)])
            met = False
            for i in near:
                own = now[i]
                if (p[0] - own[0]) ** 2 + (p[1] - own[1]) ** 2 + (p[2] - own[2]) ** 2 < distance**2:
                    met = True
                    if p[3] > own[3]:
                        own[:] = p
            if not met:
                done.append(tuple(p))
        last = now
    return done


def link_peaks(hits: DataFrame, first: int, last: int, distance: int = LINK) -> DataFrame:
    """(entry, z, y, x, counts): hits followed from frame to frame, one row per peak, where its brightest hit stands.

    Frames go in slabs of 50 with a halo of 5 at both ends, walked frame by frame; a slab reports the peaks that stand in its own frames. A peak that is
    still followed in the last frame that a slab sees isn't reported by it, so peaks of the very last frame are left out. Peaks that end up in one place are one.
    """
    slabs = F.array_distinct(F.transform(F.array(F.lit(-HALO), F.lit(0), F.lit(HALO)), lambda d: F.floor((F.col("frame") - first + d) / SLAB)))
    dealt = hits.filter((F.col("frame") >= first) & (F.col("frame") < last)).withColumn("slab", F.explode(slabs)).filter("slab >= 0")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "counts", "y", "x"], ascending=[True, False, True, True])
        start = first + int(pdf["slab"].iloc[0]) * SLAB
        seen = min(start + SLAB + HALO, last) - 1
        by = {int(f): list(zip(g["counts"].tolist(), g["y"].tolist(), g["x"].tolist())) for f, g in pdf.groupby("frame")}
        frames = sorted(by)
        found = followed([*frames, seen + 1], [*(by[f] for f in frames), []], distance) if frames[-1] < seen else followed(frames, [by[f] for f in frames], distance)
        own = sorted({p for p in found if start <= p[0] < min(start + SLAB, last)})
        return pd.DataFrame([(pdf["entry"].iloc[0], *p) for p in own], columns=["entry", "z", "y", "x", "counts"])

    kind = hits.schema["entry"].dataType.simpleString()
    return dealt.select("entry", "slab", "frame", "y", "x", "counts").groupBy("entry", "slab").applyInPandas(follow, f"entry {kind}, z long, y long, x long, counts long")


def peak_moments(peaks: DataFrame, frames: DataFrame, min_pixels: int) -> DataFrame:
    """Total counts, centroid and spread of the half-open box of ``min_pixels`` on each side of a peak (entry, z, y, x)."""
    m = max(1, min_pixels)
    cell = lambda z, y, x: [F.floor(z / m).alias("cz"), F.floor(y / m).alias("cy"), F.floor(x / m).alias("cx")]
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    cells = F.explode(F.array(*[F.struct((F.floor(F.col("z") / m) + a).alias("cz"), (F.floor(F.col("y") / m) + b).alias("cy"), (F.floor(F.col("x") / m) + c).alias("cx")) for a, b, c in steps]))
    wide = peaks.select("entry", F.col("z").alias("pz"), F.col("y").alias("py"), F.col("x").alias("px"), cells.alias("cell")).select("entry", "pz", "py", "px", "cell.*")
    pixels = frames.select("entry", F.col("frame").alias("z"), "y", "x", "counts", *cell(F.col("frame"), F.col("y"), F.col("x")))
    inside = lambda v, p: (F.col(v) >= F.col(p) - min_pixels) & (F.col(v) < F.col(p) + min_pixels)
    near = wide.join(pixels, ["entry", "cz", "cy", "cx"]).filter(inside("z", "pz") & inside("y", "py") & inside("x", "px"))
    first = lambda v: F.sum(F.col("counts") * F.col(v)).alias(f"s{v}")
    second = lambda v: F.sum(F.col("counts") * F.col(v) * F.col(v)).alias(f"q{v}")
    sums = near.groupBy("entry", "pz", "py", "px").agg(F.sum("counts").alias("intensity"), *[f(v) for v in ("z", "y", "x") for f in (first, second)]).filter("intensity > 0")
    mean = lambda v: F.col(f"s{v}") / F.col("intensity")
    spread = lambda v: F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{v}") / F.col("intensity") - mean(v) * mean(v)))
    return sums.select("entry", "pz", "py", "px", "intensity", *[mean(v).alias(v) for v in ("x", "y", "z")], *[spread(v).alias(f"sig{v}") for v in ("x", "y", "z")])


def peak_valid(peaks: DataFrame, least: float = 0.5) -> DataFrame:
    return peaks.filter((F.col("sigx") >= least) & (F.col("sigy") >= least))


def find_peaks(frames: DataFrame, threshold: int, min_pixels: int, first: int, last: int, ny: int, nx: int) -> DataFrame:
    """Maxima, linked over frames, measured and filtered, by z."""
    hits = local_maxima(frames, threshold, min_pixels, ny, nx)
    found = link_peaks(hits, first, last)
    return peak_valid(peak_moments(found, frames, min_pixels)).orderBy("entry", "pz", "py", "px")


def polar_default(peaks: DataFrame, rank: int = 201) -> DataFrame:
    """The largest polar angle used by default: the 201st smallest plus 0.1, else the largest."""
    order = Window.partitionBy("entry").orderBy("polar")
    least = peaks.select("entry", "polar", F.row_number().over(order).alias("k")).filter(F.col("k") <= rank)  # Spark keeps the first of each task
    return least.groupBy("entry").agg((F.max("polar") + F.when(F.count("*") == rank, 0.1).otherwise(0.0)).alias("polar_max"))


def polar_filter(peaks: DataFrame, limit: float | Column) -> DataFrame:
    return peaks.filter(F.col("polar") <= limit)


def hkl_tolerance_filter(peaks: DataFrame, tolerance: float) -> DataFrame:
    """Peaks whose hkl lies within the tolerance (``diff``, 1/angstrom)."""
    return peaks.filter(F.col("diff") <= tolerance)


def peak_table(peaks: DataFrame, geometry: Geometry, polar_max: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Peaks (x, y, z, ...) with polar, azimuth, h, k, l and diff, below a polar angle and within a tolerance where given."""
    x, y, z = (F.col(c) for c in "xyz")
    rows = peaks.select("*", geo.polar(geometry, x, y).alias("polar"), geo.azimuth(geometry, x, y).alias("azimuth"))
    rows = rows if polar_max is None else polar_filter(rows, polar_max)
    rows = rows.select("*", *[c.alias(n) for c, n in zip(geo.pixel_to_hkl(geometry, x, y, z), "hkl")])
    rows = rows.withColumn("diff", geo.hkl_diff(geometry, [F.col(c) for c in "hkl"]))
    return rows if tolerance is None else hkl_tolerance_filter(rows, tolerance)


def export_peaks(peaks: DataFrame, correction: DataFrame, tolerance: float) -> DataFrame:
    """Peaks whose hkl lies within the tolerance, the intensity over the polarization at the rounded pixel."""
    at = peaks.filter(F.col("diff") < tolerance).withColumn("iy", F.rint("y").cast("int")).withColumn("ix", F.rint("x").cast("int"))
    image = correction.select(F.col("y").cast("int").alias("iy"), F.col("x").cast("int").alias("ix"), "polarization")
    return at.join(image, ["iy", "ix"], "left").withColumn("intensity", F.col("intensity") / F.coalesce("polarization", F.lit(1.0))).drop("iy", "ix", "polarization")


def brightest_in_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box, y, x, counts) of the brightest pixel in each box (box, y0, y1, x0, x1; borders belong to it), of equals the first by y and x. A box without pixels has no row.

    ``frames`` (y, x, counts) may hold many frames; the greatest value of a pixel counts. Boxes meet pixels by tiles of 64 by 64.
    """
    tile = lambda c: F.floor(F.col(c) / 64)
    spread = boxes.withColumn("ty", F.explode(F.sequence(tile("y0"), tile("y1")))).withColumn("tx", F.explode(F.sequence(tile("x0"), tile("x1"))))
    pixels = frames.groupBy("y", "x").agg(F.max("counts").alias("counts")).withColumn("ty", tile("y")).withColumn("tx", tile("x"))
    inside = pixels.join(spread, ["ty", "tx"]).filter(F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    return inside.groupBy("box").agg(F.max_by(F.struct("y", "x", "counts"), F.struct("counts", -F.col("y"), -F.col("x"))).alias("p")).select("box", "p.*")
