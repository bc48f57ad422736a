"""Pixel masks as (y, x) tables of masked pixels, and the three-dimensional Bragg mask."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_FRAMES, HOT_LEVEL = 10, 100


def hot_pixels(frames: DataFrame, n_frames: int = HOT_FRAMES, level: int = HOT_LEVEL) -> DataFrame:
    """Pixels that hold one value of at least ``level`` over the first frames."""
    first = frames.filter((F.col("frame") >= 0) & (F.col("frame") < n_frames)).groupBy("entry", "y", "x").agg(F.max("counts").alias("top"), F.sum("counts").alias("total"), F.count("*").alias("n"))
    return first.filter((F.col("top") * F.col("n") == F.col("total")) & (F.col("top") >= level)).select("entry", "y", "x")


def apply_pixel_mask(frames: DataFrame, mask: DataFrame, zero: bool = False) -> DataFrame:
    """Masked pixels dropped, or set to 0 for the peak search."""
    keys = [c for c in ("entry", "y", "x") if c in mask.columns]
    if not zero:
        return frames.join(mask.select(*keys), keys, "left_anti")
    marked = frames.join(mask.select(*keys).distinct().withColumn("masked", F.lit(True)), keys, "left")
    return marked.withColumn("counts", F.when(F.col("masked"), 0).otherwise(F.col("counts")).cast("long")).drop("masked")


def in_annulus(x: Column, y: Column, xc: float, yc: float, rmin: float, rmax: float) -> Column:
    """Both borders belong to the annulus: only pixels strictly nearer or farther are excluded."""
    square = (x - xc) * (x - xc) + (y - yc) * (y - yc)
    return (square >= rmin * rmin) & (square <= rmax * rmax)


def annulus_mask(pixels: DataFrame, xc: float, yc: float, rmin: float, rmax: float) -> DataFrame:
    return pixels.filter(~in_annulus(F.col("x"), F.col("y"), xc, yc, rmin, rmax))


def shape_mask(pixels: DataFrame, shapes: list[dict]) -> DataFrame:
    """Pixels in any rectangle [y, y + dy) x [x, x + dx) or circle (distance below r of the whole-number centre), and pixels with negative counts."""
    hit = F.lit(False)
    for s in shapes:
        x, y = int(s["x"]), int(s["y"])
        if s["kind"] == "rectangle":
            hit = hit | ((F.col("x") >= x) & (F.col("x") < int(s["x"] + s["dx"])) & (F.col("y") >= y) & (F.col("y") < int(s["y"] + s["dy"])))
        else:
            hit = hit | ((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) < s["r"] ** 2)
    if "counts" in pixels.columns:
        hit = hit | (F.col("counts") < 0)
    return pixels.filter(hit).select("y", "x").distinct()


def box_mean(image: np.ndarray, width: int) -> np.ndarray:
    """Mean over width x width pixels with the border pixels repeated outwards."""
    before, after = width // 2, width - 1 - width // 2
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before + 1, after)
        run = np.cumsum(np.pad(out, pad, mode="edge"), axis=axis)
        n = image.shape[axis]
        out = np.take(run, range(width, width + n), axis) - np.take(run, range(n), axis)
    return out / width**2  # sums of whole numbers stay exact up to here


def fill_gaps(image: np.ndarray, dead: np.ndarray) -> np.ndarray:
    """Columns, then rows, that are dead all along take the larger of the live lines on either side of their run."""
    out = image.copy()
    for axis in (0, 1):
        lines = dead.all(axis=axis)
        view = out if axis == 1 else out.T
        k, n = 0, len(lines)
        while k < n:
            if not lines[k]:
                k += 1
                continue
            end = k
            while end < n and lines[end]:
                end += 1
            sides = [view[i] for i in (k - 1, end) if 0 <= i < n]
            if sides:
                view[k:end] = np.max(sides, axis=0)
            k = end
    return out


def bragg_mask(frames: DataFrame, ny: int, nx: int, t1: float = 2.0, h1: int = 11, t2: float = 0.8, h2: int = 51, pixel_mask: DataFrame | None = None, slab: int = 10) -> DataFrame:
    """(entry, frame, y, x) of pixels near a Bragg peak.

    The difference of a frame to the next, box-averaged, is compared with t1; the resulting 0/1 image, gaps filled and
    box-averaged, with t2. A frame's mask holds the pixels of the comparison before and after it. Frames go in bands, and these in slabs
    with one frame of halo on each side, each slab in one task of bounded size.
    """
    from . import bands

    dealt = bands.to_bands(frames.select("entry", "frame", "y", "x", "counts"), ny, nx)
    found = bands.bragg_mask(dealt, ny, nx, t1, h1, t2, h2, bands.mask_bits(pixel_mask, ny, nx), slab)
    return bands.mask_rows(found).select("entry", "frame", "y", "x")
