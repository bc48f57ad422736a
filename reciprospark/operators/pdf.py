"""From a symmetrized volume to the pair distribution function.

Volumes are sparse tables (il, ik, ih, value). A three-dimensional transform is two passes over planes of voxels: two axes within a plane, then the
third within planes across it, so no task holds more than a plane at a time. Holes around Bragg peaks are filled by Laplace interpolation: the
shell around each hole travels to a group of holes, which are solved together on the stencil, without a matrix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .volume import Grid

#: Holes that one Arrow group fills together.
HOLES_AT_ONCE = 64
#: Conjugate gradients end when the squared residual is below this part of its start.
SETTLED = 1e-24


def _square(grid: Grid, axis: int, reciprocal: tuple[float, float, float], at):
    """The square of Q along one axis (h, k, l) at a voxel number."""
    q = (at / float(grid.steps[axis]) + (grid.h0, grid.k0, grid.l0)[axis]) * reciprocal[axis]
    return q * q


def taper_floor(grid: Grid, reciprocal: tuple[float, float, float], q_max: float) -> float:
    """The least value that the taper has on the grid within ``q_max``, which all voxels beyond get: that of the largest Q below it. 1 where no voxel lies on the slope."""
    h, k, l = (_square(grid, i, reciprocal, np.arange(n)) for i, n in enumerate(grid.n))  # noqa: E741
    h, top, best = np.sort(h), q_max * q_max, 0.0
    for b in np.unique(l):  # a plane at a time
        rest = np.unique(k) + b
        place = np.searchsorted(h, top - rest) - 1
        own = (h[place] + rest)[place >= 0]
        best = max(best, float(own[own < top].max(initial=0.0)))
    r = 2 * math.sqrt(best) / q_max
    return 0.5 * (1 - math.cos(r * math.pi)) if r > 1 else 1.0


def taper(grid: Grid, reciprocal: tuple[float, float, float], q_max: float) -> Column:
    """1 up to half of ``q_max``, then a cosine down to the full ``q_max``, as a function of the voxel columns; Q from the axes as if orthogonal."""
    square = sum((_square(grid, i, reciprocal, F.col(c)) for i, c in enumerate(("ih", "ik", "il"))), F.lit(0.0))
    r = F.sqrt(square) * (2.0 / q_max)
    return F.when(r <= 1, 1.0).when(r >= 2, taper_floor(grid, reciprocal, q_max)).otherwise(0.5 * (1 - F.cos(r * math.pi)))


def tapered(volume: DataFrame, grid: Grid, reciprocal: tuple[float, float, float], q_max: float, value: str = "signal") -> DataFrame:
    return volume.select("il", "ik", "ih", (F.col(value) * taper(grid, reciprocal, q_max)).alias("value"))


def _planes(volume: DataFrame, fixed: str, over: tuple[str, str], shape: tuple[int, int], axes: tuple[int, ...]) -> DataFrame:
    """The centred transform of each plane (one value of ``fixed``, ``over`` in rows and columns) along the given of its axes."""

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros(shape, complex)
        plane[pdf[over[0]].to_numpy(), pdf[over[1]].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        out = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(plane, axes), axes=axes), axes)
        rows, columns = np.indices(shape)
        return pd.DataFrame({fixed: pdf[fixed].iloc[0], over[0]: rows.ravel(), over[1]: columns.ravel(), "re": out.real.ravel(), "im": out.imag.ravel()})

    return volume.groupBy(fixed).applyInPandas(transform, f"{fixed} int, {over[0]} int, {over[1]} int, re double, im double")


def fft3(volume: DataFrame, shape: tuple[int, int, int], value: str = "value") -> DataFrame:
    """(iz, iy, ix, pdf): the centred transform of a volume (il, ik, ih, value) of ``shape`` (l, k, h), real part over the number of voxels.

    The last plane of each axis is dropped where the axis is odd, so that the zero is in the middle. Voxels not given are 0. A task holds a plane at a time.
    """
    nl, nk, nh = (n - n % 2 for n in shape)
    rows = volume.filter((F.col("il") < nl) & (F.col("ik") < nk) & (F.col("ih") < nh)).select(*[F.col(c).cast("int").alias(c) for c in ("il", "ik", "ih")], F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    flat = _planes(rows, "il", ("ik", "ih"), (nk, nh), (0, 1))
    full = _planes(flat, "ik", ("il", "ih"), (nl, nh), (0,))
    return full.select(F.col("il").alias("iz"), F.col("ik").alias("iy"), F.col("ih").alias("ix"), (F.col("re") / float(nl * nk * nh)).alias("pdf"))


def hole_offsets(radius: float, steps: tuple[int, int, int], reciprocal: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Voxel offsets (h, k, l) of an ellipsoid of ``radius`` (1/angstrom with 2 pi): half widths in whole voxels."""
    half = [max(1, round(radius * s / a)) for s, a in zip(steps, reciprocal)]
    box = [range(-2 * h, 2 * h + 1) for h in half]
    return [(a, b, c) for a in box[0] for b in box[1] for c in box[2] if (a / half[0]) ** 2 + (b / half[1]) ** 2 + (c / half[2]) ** 2 <= 1]


def _shell(hole: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The face neighbours of a hole outside it."""
    inside = set(hole)
    near = {(a + d, b + e, c + f) for a, b, c in hole for d, e, f in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))}
    return sorted(near - inside)


def laplace_kernel(hole: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(shell, K): the harmonic fill of the hole is K times the shell's values; the rows of K sum to 1."""
    shell = _shell(hole)
    at, rim = {v: i for i, v in enumerate(hole)}, {v: i for i, v in enumerate(shell)}
    inner, outer = np.zeros((len(hole), len(hole))), np.zeros((len(hole), len(shell)))
    for (a, b, c), i in at.items():
        inner[i, i] = 6
        for n in ((a + 1, b, c), (a - 1, b, c), (a, b + 1, c), (a, b - 1, c), (a, b, c + 1), (a, b, c - 1)):
            if n in at:
                inner[i, at[n]] -= 1
            else:
                outer[i, rim[n]] += 1
    return shell, np.linalg.solve(inner, outer)


def _solved(apply, b: np.ndarray) -> np.ndarray:
    """x of apply(x) = b by conjugate gradients, for a batch (first axis) of symmetric systems without negative eigenvalues."""
    axes = tuple(range(1, b.ndim))
    dot = lambda u, v: (u * v).sum(axes, keepdims=True)
    x, r = np.zeros_like(b), b.copy()
    p, rs = r.copy(), dot(r, r)
    end = rs * SETTLED
    for _ in range(10 * int(np.prod(b.shape[1:])) + 10):
        if (rs <= end).all():
            break
        ap = apply(p)
        down = dot(p, ap)
        alpha = np.where((rs > end) & (down > 0), rs / np.where(down > 0, down, 1.0), 0.0)
        x += alpha * p
        r -= alpha * ap
        new = dot(r, r)
        p = r + np.where(rs > 0, new / np.where(rs > 0, rs, 1.0), 0.0) * p
        rs = np.where(down > 0, new, 0.0)
    return x


def _neighbour_sum(v: np.ndarray, first: int, weights: tuple[float, ...]) -> np.ndarray:
    """The weighted sum of the face neighbours of each cell, over the axes from ``first`` on; there is nothing beyond the border."""
    out = np.zeros_like(v)
    for axis, w in enumerate(weights, first):
        low, high = [slice(None)] * v.ndim, [slice(None)] * v.ndim
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        out[tuple(low)] += w * v[tuple(high)]
        out[tuple(high)] += w * v[tuple(low)]
    return out


def harmonic_fill(values: np.ndarray, hole: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Values of a batch of boxes (first axis) with the voxels of ``hole`` harmonic: each the mean of those face neighbours that are ``inside`` the grid.

    No matrix is formed, so a hole of any size takes a few arrays of its box. A hole without anything around it gets 0.
    """
    one = (1.0, 1.0, 1.0)
    degree = _neighbour_sum(inside.astype(float), 1, one)
    known = _neighbour_sum(np.where(hole, 0.0, values) * inside, 1, one)
    x = _solved(lambda p: np.where(hole, degree * p - _neighbour_sum(p, 1, one), 0.0), np.where(hole, known, 0.0))
    return np.where(hole, x, values)


def _around(centres: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(centre, s, ih, ik, il) of each offset's voxel around each centre (ih, ik, il)."""
    o = np.array(offsets, np.int32).reshape(-1, 3)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 + 200_000 // len(o)):
                c = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)[lo : lo + 1 + 200_000 // len(o)].astype(np.int32)
                own = np.repeat(c, len(o), 0)
                at = own + np.tile(o, (len(c), 1))
                yield pa.RecordBatch.from_arrays([*[pa.array(own[:, i]) for i in range(3)], pa.array(np.tile(np.arange(len(o), dtype=np.int32), len(c))), *[pa.array(at[:, i]) for i in range(3)]], ["ch", "ck", "cl", "s", "ih", "ik", "il"])

    if not len(o):
        raise ValueError("a hole needs a voxel")
    whole = centres.select(*[F.col(c).cast("int").alias(c) for c in ("ih", "ik", "il")]).distinct()
    return whole.mapInArrow(run, "ch int, ck int, cl int, s int, ih int, ik int, il int")


def punch(volume: DataFrame, centres: DataFrame, offsets: list[tuple[int, int, int]], value: str = "value") -> DataFrame:
    """The volume with the voxels of every hole set to 0. ``centres``: (ih, ik, il). Holes may reach over the border."""
    gone = _around(centres, offsets).select("il", "ik", "ih").distinct().withColumn("gone", F.lit(True))
    return volume.join(gone, ["il", "ik", "ih"], "left").withColumn(value, F.when(F.col("gone"), 0.0).otherwise(F.col(value))).drop("gone")


def hole_fills(volume: DataFrame, centres: DataFrame, offsets: list[tuple[int, int, int]], value: str = "value", grid: Grid | None = None) -> DataFrame:
    """(ih, ik, il, fill) of the voxels of each hole, filled from the voxels around it; overlapping fills add up.

    Voxels not given count as 0. With ``grid`` a hole may reach over the border, where it has fewer neighbours, and is filled inside only; without, all centres must
    lie at least a hole and its shell inside. Each hole needs its shell alone (one row a shell voxel); the holes of an Arrow group are solved together.
    """
    shell, o = np.array(_shell(offsets)), np.array(offsets)
    low = np.minimum(shell.min(0), o.min(0))
    size = tuple(np.maximum(shell.max(0), o.max(0)) - low + 1)
    rim, hole = tuple((shell - low).T), tuple((o - low).T)
    n = grid.n if grid is not None else None

    def run(table: pa.Table) -> pa.Table:
        centre = np.stack([table.column(c).to_numpy() for c in ("ch", "ck", "cl")], 1)
        own, which = np.unique(centre, axis=0, return_inverse=True)
        s, v = table.column("s").to_numpy(), table.column("rim").to_numpy()
        out = []
        for lo in range(0, len(own), HOLES_AT_ONCE):
            part = own[lo : lo + HOLES_AT_ONCE]
            mine = (which.ravel() >= lo) & (which.ravel() < lo + len(part))
            values, holes = np.zeros((len(part), *size)), np.zeros((len(part), *size), bool)
            values[(which.ravel()[mine] - lo, *(r[s[mine]] for r in rim))] = v[mine]
            holes[(slice(None), *hole)] = True
            inside = np.ones_like(holes)
            if n is not None:
                for axis in range(3):
                    at = part[:, axis, None] + low[axis] + np.arange(size[axis])
                    inside &= np.expand_dims((at >= 0) & (at < n[axis]), [a for a in (1, 2, 3) if a != axis + 1])
            filled = harmonic_fill(values, holes & inside, inside)
            b, *at = np.nonzero(holes & inside)
            out.append([*[(part[b, axis] + low[axis] + at[axis]).astype(np.int32) for axis in range(3)], filled[(b, *at)]])
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table([pa.array(c) for c in columns], names=["ih", "ik", "il", "fill"])

    known = _around(centres, [tuple(map(int, x)) for x in shell]).join(volume.select("il", "ik", "ih", F.col(value).cast("double").alias("rim")), ["il", "ik", "ih"], "left")
    # also a hole whose shell is nowhere given is dealt to a group, of which each takes some holes
    groups = max(1, -(-centres.count() // HOLES_AT_ONCE))
    dealt = known.select("ch", "ck", "cl", "s", F.coalesce("rim", F.lit(0.0)).alias("rim"), F.pmod(F.xxhash64("ch", "ck", "cl"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(run, "ih int, ik int, il int, fill double").groupBy("ih", "ik", "il").agg(F.sum("fill").alias("fill"))


def _replaced(volume: DataFrame, fills: DataFrame, value: str) -> DataFrame:
    joined = volume.join(fills, ["il", "ik", "ih"], "full")
    return joined.withColumn(value, F.when(F.col("fill") > 0, F.col("fill")).otherwise(F.coalesce(value, F.lit(0.0)))).drop("fill")


def fill_holes(volume: DataFrame, centres: DataFrame, offsets: list[tuple[int, int, int]], value: str = "value", grid: Grid | None = None) -> DataFrame:
    """The volume with ``hole_fills`` in place of its voxels; a fill of 0 or less leaves a voxel as it was."""
    return _replaced(volume, hole_fills(volume, centres, offsets, value, grid), value)


def punch_lattice(volume: DataFrame, grid: Grid, radius: float, reciprocal: tuple[float, float, float], centring: str = "P", value: str = "value") -> DataFrame:
    """The volume with a hole around every allowed whole-number reflection, also where it reaches over the border, filled from what surrounds it. Radius as for ``hole_offsets``."""
    offsets = hole_offsets(radius, grid.steps, reciprocal)
    centres = lattice_centres(volume, grid, -max(max(map(abs, o)) for o in offsets), centring)
    return fill_holes(punch(volume, centres, offsets, value), centres, offsets, value, grid)


def matern(values: np.ndarray, gap: np.ndarray, order: int = 1, eps: float = 0.0, aspect: tuple[float, ...] | None = None) -> np.ndarray:
    """Values of a series, image, cube or more dimensions with those in ``gap`` such that the order-th power of (eps^2 - Laplacian) is 0 there.

    The Laplacian has grid steps ``aspect`` and no neighbours beyond the border; only rows of the gap are solved, and powers are applied, never formed.
    All values or none in the gap: nothing changes.
    """
    if not gap.any() or gap.all():
        return values.copy()
    weights = tuple(1.0 / a**2 for a in (aspect or (1.0,) * values.ndim))
    degree = _neighbour_sum(np.ones((1, *values.shape)), 1, weights) + eps**2

    def power(v):
        for _ in range(order):
            v = degree * v - _neighbour_sum(v, 1, weights)
        return v

    hole, known = gap[None], np.where(gap, 0.0, values)[None]
    x = _solved(lambda p: np.where(hole, power(p), 0.0), np.where(hole, -power(known), 0.0))
    return np.where(gap, x[0], values)


def matern_fill(rows: DataFrame, order: int = 1, eps: float = 0.0, steps: tuple[float, ...] = (1.0, 1.0, 1.0), axes: tuple[str, ...] = ("i", "j", "k")) -> DataFrame:
    """Fills the null values of each group of (group, *axes, value): the order-th power of (eps^2 - Laplacian), with grid steps, is 0 there.

    A group is one series, image, cube or box of more axes with a gap and what surrounds it; its box is that of its rows, and places without a row belong to the gap but have no row in the result.
    """

    def run(table: pa.Table) -> pa.Table:
        at = [table.column(a).to_numpy() for a in axes]
        at = tuple(a - a.min() for a in at)
        value = table.column("value").to_pandas().to_numpy(float)
        box = np.full(tuple(int(a.max()) + 1 for a in at), np.nan)
        box[at] = value
        filled = matern(np.nan_to_num(box), np.isnan(box), order, eps, steps[: len(axes)])[at]
        missing = np.isnan(value)
        if np.isnan(box).all():
            filled[:] = np.nan
        out = np.where(missing, filled, value)
        return table.set_column(table.schema.get_field_index("value"), "value", pa.array(out, mask=np.isnan(out)))

    kind = rows.schema["group"].dataType.simpleString()
    own = rows.select("group", *[F.col(c).cast("int").alias(c) for c in axes], F.col("value").cast("double").alias("value"))
    return own.groupBy("group").applyInArrow(run, f"group {kind}, {', '.join(f'{a} int' for a in axes)}, value double")


def lattice_centres(volume: DataFrame, grid: Grid, edge: int, centring: str = "P") -> DataFrame:
    """(h, k, l, ih, ik, il) of the allowed integer reflections inside the grid, ``edge`` voxels from its border; below 0, also those up to so many voxels outside."""
    from .lattice import absent

    out = volume.sparkSession.range(1)
    for name, origin, steps, n in zip("hkl", (grid.h0, grid.k0, grid.l0), grid.steps, grid.n):
        values = [(v, round((v - origin) * steps)) for v in range(math.ceil(origin + min(edge, 0) / steps), math.floor(origin + (n - 1 - min(edge, 0)) / steps) + 1)]
        own = [F.struct(F.lit(v).alias(name), F.lit(i).alias(f"i{name}")) for v, i in values if edge <= i < n - edge]
        out = out.withColumn(f"_{name}", F.explode(F.array(*own) if own else F.array().cast(f"array<struct<{name}:int,i{name}:int>>")))
    out = out.select("_h.*", "_k.*", "_l.*")
    return out.filter(~absent(F.col("h"), F.col("k"), F.col("l"), centring))


def total_pdf(volume: DataFrame, grid: Grid, reciprocal: tuple[float, float, float], q_max: float, value: str = "signal") -> DataFrame:
    return fft3(tapered(volume, grid, reciprocal, q_max, value), grid.n[::-1])


def bragg_fill(volume: DataFrame, grid: Grid, laue: str, radius: float, reciprocal: tuple[float, float, float], centring: str = "P", value: str = "signal") -> DataFrame:
    """The volume with what lies below the Bragg peaks in place of them; where the fill is 0 or less voxels stay as they are.

    One reflection of each set of equivalents (the greatest) is filled and the fill symmetrized, as the volume is; trigonal and hexagonal classes, whose images
    are not all whole moves of the grid, have all of their reflections filled. Reflections whose hole and shell aren't whole inside the grid are passed over.
    """
    from .volume import laue_images, symmetrize

    offsets = hole_offsets(radius, grid.steps, reciprocal)
    centres = lattice_centres(volume, grid, max(max(map(abs, o)) for o in offsets) + 1, centring)
    rows = volume.select("il", "ik", "ih", F.col(value).alias("value"))
    if laue in ("-3", "-3m", "6/m", "6/mmm"):
        return fill_holes(rows, centres, offsets)
    own = [F.col(c) for c in "hkl"]
    images = [F.struct(*[(s[i] * own[p[i]]).alias(c) for i, c in enumerate("hkl")]) for p, s, _ in laue_images(laue, group=True)]
    first = centres.filter(F.struct(*own) == F.array_max(F.array(*images)))
    fills = symmetrize(hole_fills(rows, first, offsets).select("il", "ik", "ih", F.col("fill").alias("v"), F.lit(None).cast("double").alias("n")), grid, laue)
    return _replaced(rows, fills.select("il", "ik", "ih", F.col("signal").alias("fill")), "value")


def delta_pdf(volume: DataFrame, grid: Grid, reciprocal: tuple[float, float, float], q_max: float, radius: float, centring: str = "P", value: str = "signal", laue: str | None = None) -> DataFrame:
    """The transform of the volume after the Bragg peaks are filled in: those of ``laue`` by ``bragg_fill``, without a class every reflection by itself."""
    if laue is not None:
        filled = bragg_fill(volume, grid, laue, radius, reciprocal, centring, value)
    else:
        offsets = hole_offsets(radius, grid.steps, reciprocal)
        centres = lattice_centres(volume, grid, max(max(map(abs, o)) for o in offsets) + 1, centring)
        filled = fill_holes(volume.select("il", "ik", "ih", F.col(value).alias("value")), centres, offsets)
    return fft3(tapered(filled, grid, reciprocal, q_max, "value"), grid.n[::-1])


def pdf_pipeline(voxels: DataFrame, grid: Grid, laue: str, reciprocal: tuple[float, float, float], q_max: float, radius: float, centring: str = "P", symmetric: bool = True) -> tuple[DataFrame, DataFrame]:
    """(total, delta): voxels (v, n) to total and difference pair distribution functions.

    The volume is symmetrized first; without ``symmetric`` it is v over n as it stands, with 0 where that is no finite number, and only the fill is symmetrized.
    """
    from .volume import symmetrize

    if symmetric:
        even = symmetrize(voxels, grid, laue).select("il", "ik", "ih", "signal")
    else:
        ratio = F.try_divide(F.sum("v"), F.sum("n"))
        even = voxels.groupBy("il", "ik", "ih").agg(ratio.alias("signal")).withColumn("signal", F.when(F.isnan("signal") | F.col("signal").isNull() | (F.abs("signal") == float("inf")), 0.0).otherwise(F.col("signal")))
    return total_pdf(even, grid, reciprocal, q_max), delta_pdf(even, grid, reciprocal, q_max, radius, centring, laue=laue)
