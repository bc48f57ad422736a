"""Reciprocal-space volumes as sparse voxel tables (entry, il, ik, ih, v, n)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reciprospark.functions.geometry import Geometry, azimuth, pixel_to_hkl, polar, polarization


@dataclass(frozen=True)
class Grid:
    """Origin, steps per unit and number of voxels along h, k and l."""

    h0: float
    k0: float
    l0: float
    steps: tuple[int, int, int]
    n: tuple[int, int, int]

    def index(self, axis: int, value: Column) -> Column:
        return F.floor((value - (self.h0, self.k0, self.l0)[axis]) * self.steps[axis] + 0.5).cast("int")


def hkl_histogram(frames: DataFrame, geo: Geometry, grid: Grid, weights: DataFrame | None = None, pixel_mask: DataFrame | None = None, voxel_mask: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """Every pixel of every frame to its nearest voxel: v is the sum of counts, n of frame weight times polarization.

    Masked pixels drop out; frames with weight 0 drop out of both sums. Partial aggregation before the one shuffle.
    """
    if pixel_mask is not None:
        frames = frames.join(pixel_mask.select("y", "x").distinct(), ["y", "x"], "left_anti")
    if voxel_mask is not None:
        frames = frames.join(voxel_mask.select("entry", "frame", "y", "x"), ["entry", "frame", "y", "x"], "left_anti")
    if weights is not None:
        frames = frames.join(weights.filter("weight > 0").select("entry", "frame", "weight"), ["entry", "frame"])
    h, k, l = pixel_to_hkl(geo, F.col("x"), F.col("y"), F.col("frame"))  # noqa: E741
    weight = (F.col("weight") if weights is not None else F.lit(1.0)) * (polarization(geo, F.col("x"), F.col("y")) if corrected else F.lit(1.0))
    index = [grid.index(axis, value).alias(name) for axis, value, name in ((2, l, "il"), (1, k, "ik"), (0, h, "ih"))]
    placed = frames.select("entry", *index, "counts", weight.alias("w"))
    inside = F.col("ih").between(0, grid.n[0] - 1) & F.col("ik").between(0, grid.n[1] - 1) & F.col("il").between(0, grid.n[2] - 1)
    # pixels outside make one group of their own, dropped after the sums: a filter on the voxel would be moved below the projection and evaluate all its terms again
    keys = [F.when(inside, F.col(c)).alias(c) for c in ("il", "ik", "ih")]
    sums = placed.groupBy("entry", *keys).agg(F.sum("counts").cast("double").alias("v"), F.sum("w").alias("n"), F.count(F.when(inside, 1)).alias("inside"))
    return sums.filter("inside > 0").drop("inside")


def combine(voxels: DataFrame) -> DataFrame:
    """Rotations merged: sum of v over sum of n, 0 where n is 0."""
    sums = voxels.groupBy("il", "ik", "ih").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return sums.withColumn("signal", F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0))


def _apply(first, then):
    """The signed permutation that does ``first``, then ``then``: axis i of the result comes from axis p[i] with sign s[i]."""
    (p, s), (q, t) = first, then
    return tuple(p[q[i]] for i in range(3)), tuple(s[q[i]] * t[i] for i in range(3))


def laue_images(laue: str, group: bool = False) -> list[tuple[tuple[int, int, int], tuple[int, int, int], int]]:
    """(permutation, signs, multiplicity) of the images of (h, k, l) that are added up.

    By default the images and multiplicities in use for the named classes: trigonal classes have the inversion only,
    hexagonal ones the two-fold about l, m-3 the identity twice and two cyclic images, m-3m 64 images
    in all over the 48 of the class. ``group``: all operations of the class once each (those that permute axes; cubic grids).
    """
    e = (0, 1, 2)
    signs = list(product((1, -1), repeat=3))
    swap = (1, 0, 2)
    if laue in ("-1", "-3", "-3m"):
        return [(e, (1, 1, 1), 1), (e, (-1, -1, -1), 1)]
    if laue == "2/m":
        return [(e, s, 1) for s in signs if s[0] == s[2]]
    if laue == "mmm":
        return [(e, s, 1) for s in signs]
    if laue == "4/m":
        turn = [(e, (1, 1, 1)), (swap, (1, -1, 1)), (e, (-1, -1, 1)), (swap, (-1, 1, 1))]
        return [(p, (s[0], s[1], s[2] * m), 1) for p, s in turn for m in (1, -1)]
    if laue == "4/mmm":
        return [(p, s, 1) for p in (e, swap) for s in signs]
    if laue in ("6/m", "6/mmm"):
        return [(e, s, 1) for s in signs if s[0] == s[1]]
    cyclic = [(0, 1, 2), (1, 2, 0), (2, 0, 1)]
    if laue == "m-3":
        if group:
            return [(p, s, 1) for p in cyclic for s in signs]
        return [(p, (1, 1, 1), 2 if p == e else 1) for p in cyclic]
    if laue == "m-3m":
        every = [(p, s) for p in permutations(range(3)) for s in signs]
        if group:
            return [(p, s, 1) for p, s in every]
        # cyclic sums of the 16 images of 4/mmm, the uncycled ones twice
        count: dict = {}
        for c in [e, e, *cyclic[1:]]:
            for p in (e, swap):
                for s in signs:
                    image = _apply((c, (1, 1, 1)), (p, s))
                    count[image] = count.get(image, 0) + 1
        return [(p, s, m) for (p, s), m in sorted(count.items())]
    raise ValueError(f"unknown Laue class {laue!r}")


def symmetrize(voxels: DataFrame, grid: Grid, laue: str, group: bool = False) -> DataFrame:
    """v and n summed over the images of a voxel, and their ratio; an image outside the grid is lost. A missing or NaN n counts as 1 where v > 0.

    The grid must be centred on the origin; cubic classes need equal axes.
    """
    clean = lambda c: F.when(F.isnan(c) | F.col(c).isNull(), 0.0).otherwise(F.col(c))
    weight = F.when(F.col("n").isNull() | F.isnan("n"), F.when(F.col("v") > 0, 1.0).otherwise(0.0)).otherwise(F.col("n"))
    centre = [(m - 1) // 2 for m in grid.n]
    old = [F.col(c) - centre[i] for i, c in enumerate(("ih", "ik", "il"))]
    at = lambda p, s: [(s[i] * old[p[i]] + centre[i]).cast("int").alias(c) for i, c in enumerate(("ih", "ik", "il"))]
    images = F.array(*[F.struct(*at(p, s), F.lit(float(m)).alias("m")) for p, s, m in laue_images(laue, group)])
    # voxels of one orbit meet in one task, and images are formed and added up there: one row a voxel is shuffled, whatever the class
    orbit = F.array_max(F.array(*[F.struct(*at(p, s)) for p, s, _ in laue_images(laue, group=True)]))
    dealt = voxels.select(clean("v").alias("v"), weight.alias("n"), "ih", "ik", "il", orbit.alias("orbit")).repartition("orbit")
    spread = dealt.select("orbit", F.explode(images).alias("to"), "v", "n").select("orbit", "to.*", "v", "n")
    inside = spread.filter(F.col("ih").between(0, grid.n[0] - 1) & F.col("ik").between(0, grid.n[1] - 1) & F.col("il").between(0, grid.n[2] - 1))
    sums = inside.groupBy("orbit", "il", "ik", "ih").agg(F.sum(F.col("v") * F.col("m")).alias("v"), F.sum(F.col("n") * F.col("m")).alias("n")).drop("orbit")
    return sums.withColumn("signal", F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.0))


def radial_sum(frames: DataFrame, geo: Geometry, top: float, bins: int = 2048) -> DataFrame:
    """(entry, bin, two_theta, q, intensity): counts over polarization per solid angle in equal steps of two-theta up to ``top`` degrees."""
    x, y = F.col("x"), F.col("y")
    tt = polar(geo, x, y)
    solid = F.pow(F.cos(F.radians(tt)), F.lit(3.0))
    rows = frames.select("entry", F.floor(tt / (top / bins)).cast("int").alias("bin"), (F.col("counts") / polarization(geo, x, y)).alias("c"), solid.alias("s")).filter(F.col("bin") < bins)
    mid = (F.col("bin") + 0.5) * (top / bins)
    q = F.sin(F.radians(mid) / 2) * (4 * 3.141592653589793 / geo.wavelength)
    return rows.groupBy("entry", "bin").agg((F.sum("c") / F.sum("s")).alias("intensity")).select("entry", "bin", mid.alias("two_theta"), q.alias("q"), "intensity")


def cake(frames: DataFrame, geo: Geometry, top: float, bins: int = 1024, sectors: int = 1024) -> DataFrame:
    """Mean counts over equal bins of two-theta and azimuth."""
    x, y = F.col("x"), F.col("y")
    rows = frames.select("entry", F.floor(polar(geo, x, y) / (top / bins)).cast("int").alias("ring"), F.floor((azimuth(geo, x, y) + 180) / (360.0 / sectors)).cast("int").alias("sector"), "counts")
    return rows.filter(F.col("ring") < bins).groupBy("entry", "ring", "sector").agg(F.avg("counts").alias("intensity"))


def reflections_on_grid(reflections: DataFrame, grid: Grid, voxels: DataFrame, edge: int, tolerance: float = 1e-6) -> DataFrame:
    """Each reflection (h, k, l) with its voxel and what becomes of it: off_grid, edge, no_signal or punched."""
    at = {a: (F.col(a) - o) * s for a, o, s in zip("hkl", (grid.h0, grid.k0, grid.l0), grid.steps)}
    near = F.lit(True)
    inner = F.lit(True)
    rows = reflections
    for i, a in enumerate("hkl"):
        rows = rows.withColumn(f"i{a}", F.rint(at[a]).cast("int"))
        near = near & (F.abs(at[a] - F.rint(at[a])) <= tolerance) & F.col(f"i{a}").between(0, grid.n[i] - 1)
        inner = inner & F.col(f"i{a}").between(edge, grid.n[i] - 1 - edge)
    signal = voxels.groupBy("il", "ik", "ih").agg(F.sum("v").alias("signal"))
    rows = rows.join(signal, ["il", "ik", "ih"], "left")
    outcome = F.when(~near, "off_grid").when(~inner, "edge").when(F.coalesce("signal", F.lit(0.0)) <= 0, "no_signal").otherwise("punched")
    return rows.select("h", "k", "l", "il", "ik", "ih", outcome.alias("outcome"))


def punch_outcomes(placed: DataFrame, examples: int = 3) -> DataFrame:
    """Number of reflections per outcome and the first few, in order of (h, k, l)."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("outcome").orderBy("h", "k", "l")
    first = placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= examples)  # Spark keeps the first few of each task
    few = first.groupBy("outcome").agg(F.sort_array(F.collect_list(F.struct("h", "k", "l"))).alias("examples"))
    return placed.groupBy("outcome").agg(F.count("*").alias("n")).join(few, "outcome")
