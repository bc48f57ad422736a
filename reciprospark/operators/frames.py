"""Frame sums, per-frame series and their normalisation.

``frames`` tables are long: (scan?, entry, frame, y, x, counts). Counts stay integers until the last division, so sums don't
depend on the order of rows. Per-frame series have a few thousand rows an entry; windows run by entry, never globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIRST, MARGIN = 10, 10
SUBSAMPLE, KEPT_TENTHS = 50_000, 9


def window_bounds(first: int | None, last: int | None, n_frames: int) -> tuple[int, int]:
    """First frame 10 and last frame n - 10 where not given or out of range."""
    first = FIRST if first is None or first < 0 else first
    last = n_frames - MARGIN if last is None or last > n_frames else last
    return first, last


def frame_window(frames: DataFrame, first: int | None = None, last: int | None = None, n_frames: int | None = None) -> DataFrame:
    """Frames of [first, last); a range of the frame column reaches the scan."""
    if n_frames is None:
        n_frames = (frames.agg(F.max("frame")).first()[0] or 0) + 1
    first, last = window_bounds(first, last, n_frames)
    return frames.filter((F.col("frame") >= first) & (F.col("frame") < last))


def link_frames(frames: DataFrame, frame_time: float = 0.1) -> DataFrame:
    """Distinct frames with their time; gaps in the numbering are filled."""
    span = frames.groupBy("entry").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    every = span.select("entry", F.explode(F.sequence("lo", "hi")).alias("frame"))
    seen = frames.select("entry", "frame").distinct().withColumn("present", F.lit(True))
    return every.join(seen, ["entry", "frame"], "left").select("entry", "frame", (F.col("frame") * frame_time).alias("time"), F.coalesce("present", F.lit(False)).alias("present"))


def clipped(frames: DataFrame) -> DataFrame:
    return frames.withColumn("counts", F.greatest(F.col("counts"), F.lit(0)))


def summed_data(frames: DataFrame) -> DataFrame:
    """Counts per pixel over all given frames; negatives count as 0."""
    return clipped(frames).groupBy("entry", "y", "x").agg(F.sum("counts").alias("counts"))


def summed_frames(frames: DataFrame, scaffold: DataFrame | None = None) -> DataFrame:
    """Counts per frame; frames of ``scaffold`` (entry, frame) without rows are 0."""
    sums = clipped(frames).groupBy("entry", "frame").agg(F.sum("counts").alias("counts"))
    if scaffold is None:
        return sums
    return scaffold.select("entry", "frame").join(sums, ["entry", "frame"], "left").select("entry", "frame", F.coalesce("counts", F.lit(0)).cast("long").alias("counts"))


def partial_frames(frames: DataFrame, annulus: DataFrame) -> DataFrame:
    """Trimmed sum per frame over the annulus: every stride-th pixel in (y, x) order, the smallest nine tenths summed, scaled to the whole annulus.

    ``annulus``: (y, x) of the pixels inside, at most one detector image.
    """
    # pixels are numbered by row: a window within each row, and one over the rows of the detector, which are few
    rows = annulus.groupBy("y").agg(F.count("*").alias("own"))
    before = Window.partitionBy(F.lit(1)).orderBy("y")
    rows = rows.select("y", (F.sum("own").over(before) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy(F.lit(1))).alias("n"))
    pixels = annulus.select("y", "x", (F.row_number().over(Window.partitionBy("y").orderBy("x")) - 1).alias("k")).join(rows, "y")
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / SUBSAMPLE))
    pixels = pixels.filter((F.col("before") + F.col("k")) % stride == 0).select("y", "x", "n")
    # equal counts are one row per frame, so only distinct counts are put in order
    held = clipped(frames).join(pixels, ["y", "x"]).groupBy("entry", "frame", "counts").agg(F.count("*").alias("pixels"), F.first("n").alias("n"))
    by_frame = Window.partitionBy("entry", "frame")
    ranked = held.withColumn("taken", F.sum("pixels").over(by_frame)).withColumn("lower", F.sum("pixels").over(by_frame.orderBy("counts")) - F.col("pixels"))
    keep = F.greatest(F.lit(1), F.floor(F.col("taken") * KEPT_TENTHS / 10)).cast("long")
    kept = ranked.withColumn("keep", keep).withColumn("used", F.greatest(F.lit(0), F.least("pixels", F.col("keep") - F.col("lower"))))
    return kept.groupBy("entry", "frame").agg((F.sum(F.col("counts") * F.col("used")) * F.first("n") / F.first("keep")).alias("partial"))


def maximum(frames: DataFrame) -> DataFrame:
    return frames.groupBy("entry").agg(F.max("counts").alias("maximum"))


def median_filter(series: DataFrame, value: str, width: int = 31) -> DataFrame:
    """Running median by frame order within an entry, ends mirrored (the end sample repeats)."""
    half = width // 2
    order = Window.partitionBy("entry").orderBy("frame")
    placed = series.select("entry", "frame", value).withColumn("i", F.row_number().over(order) - 1).withColumn("size", F.count("*").over(Window.partitionBy("entry")))
    asked = placed.select("entry", "frame", "size", F.explode(F.sequence(F.col("i") - half, F.col("i") + half)).alias("j"))
    turn = F.pmod(F.col("j"), 2 * F.col("size"))
    asked = asked.select("entry", "frame", F.when(turn < F.col("size"), turn).otherwise(2 * F.col("size") - 1 - turn).alias("i"))
    near = asked.join(placed.select("entry", "i", value), ["entry", "i"])
    return near.groupBy("entry", "frame").agg(F.sort_array(F.collect_list(value))[half].alias(value))


def frame_weights(log: DataFrame, first: int, last: int, factors: tuple[str, ...] = ("monitor", "attenuator", "filter", "transmission")) -> DataFrame:
    """The product of a frame's factors, a missing one counting as 1; 0 outside [first, last], the last included."""
    product = F.lit(1.0)
    for name in factors:
        if name in log.columns:
            product = product * F.coalesce(F.col(name).cast("double"), F.lit(1.0))
    return log.select("entry", "frame", F.when((F.col("frame") < first) | (F.col("frame") > last), 0.0).otherwise(product).alias("weight"))


def transmission(partial: DataFrame, monitor: DataFrame, first: int, last: int, width: int = 31, reference_entry: str | None = None) -> DataFrame:
    """(entry, frame, transmission, median): partial / monitor with the ends held, median filtered, over its median.

    With ``reference_entry`` other entries are scaled by their median over that entry's.
    """
    ratio = partial.join(monitor.select("entry", "frame", "monitor"), ["entry", "frame"]).select("entry", "frame", (F.col("partial") / F.nullif(F.col("monitor").cast("double"), F.lit(0.0))).alias("ratio"))
    inside = (F.col("frame") >= first) & (F.col("frame") < last) & F.col("ratio").isNotNull()
    by = Window.partitionBy("entry").orderBy("frame")
    held = F.coalesce(
        F.last(F.when(inside, F.col("ratio")), True).over(by.rowsBetween(Window.unboundedPreceding, 0)),
        F.first(F.when(inside, F.col("ratio")), True).over(by.rowsBetween(0, Window.unboundedFollowing)),
    )
    smooth = median_filter(ratio.withColumn("ratio", held).filter("ratio IS NOT NULL"), "ratio", width)
    middle = smooth.groupBy("entry").agg(F.median("ratio").alias("median"))
    out = smooth.join(middle, "entry")
    scale = F.lit(1.0)
    if reference_entry is not None:
        reference = middle.filter(F.col("entry") == reference_entry).select(F.col("median").alias("reference"))
        row = reference.first()  # one number
        scale = F.col("median") / (row[0] if row else F.lit(None))
    return out.select("entry", "frame", (F.col("ratio") / F.col("median") * scale).alias("transmission"), "median")


def smoothing_width(n: int) -> int:
    """Points of the quadratic fit: 501 over 1000 frames, 101 over 200, else all (odd)."""
    return 501 if n > 1000 else 101 if n > 200 else n - 1 + n % 2


def smooth_monitor(monitor: DataFrame, norm: float = 1.0) -> DataFrame:
    """The monitor over ``norm`` under a moving quadratic fit; the end samples are replaced by their neighbours first.

    One series per entry (a few thousand frames) is handled whole, ends by the fit of the outermost window.
    """
    import numpy as np
    import pandas as pd

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame").reset_index(drop=True)
        v = pdf["monitor"].to_numpy(float).copy()
        n = len(v)
        if n >= 3:
            v[0], v[-1] = v[1], v[-2]
            v = v / norm
            width = smoothing_width(n)
            half = width // 2
            t = np.arange(-half, half + 1)
            fit = np.linalg.pinv(np.stack([t**0, t, t * t], 1).astype(float))
            out = np.convolve(v, fit[0][::-1], "same")
            for part, at in ((v[:width], np.arange(half)), (v[n - width :], np.arange(n - half, n))):
                if len(at):
                    c = fit @ part
                    s = at - (half if at[0] == 0 else n - 1 - half)
                    out[at] = c[0] + c[1] * s + c[2] * s * s
            v = out
        elif n:
            v = v / norm
        return pd.DataFrame({"entry": pdf["entry"], "frame": pdf["frame"], "monitor": v})

    rows = monitor.select(F.col("entry").cast("string").alias("entry"), F.col("frame").cast("long").alias("frame"), F.coalesce(F.col("monitor").cast("double"), F.lit(1.0)).alias("monitor"))
    return rows.groupBy("entry").applyInPandas(smooth, "entry string, frame long, monitor double")


def sum_scans(frames: DataFrame) -> DataFrame:
    """The same entry added up over scans, pixel by pixel and frame by frame, over the frames that exist."""
    return frames.groupBy("entry", "frame", "y", "x").agg(F.sum("counts").alias("counts"), F.count("*").alias("n_scans"))


def sum_monitors(log: DataFrame) -> DataFrame:
    return log.groupBy("entry", "frame").agg(F.sum("monitor").alias("monitor"))


def frame_diff(frames: DataFrame) -> DataFrame:
    """Signed difference to the next frame at each pixel; frames must follow without a gap."""
    by = Window.partitionBy("entry", "y", "x").orderBy("frame")
    nxt = frames.select("entry", "frame", "y", "x", "counts", F.lead("counts").over(by).alias("next"), F.lead("frame").over(by).alias("next_frame"))
    return nxt.filter(F.col("next_frame") == F.col("frame") + 1).select("entry", "frame", "y", "x", (F.col("next") - F.col("counts")).alias("diff"))


def score(peaks: DataFrame, weight: Column, deviation: Column) -> DataFrame:
    """Weighted mean of a deviation by entry."""
    return peaks.groupBy("entry").agg(F.try_divide(F.sum(weight * deviation), F.sum(weight)).alias("score"))
